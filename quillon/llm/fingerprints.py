"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised bit overlap.

Every window of WIDTH bytes has a collision entropy, given by the number of equal byte pairs in it. How rare
each value of it is over the whole corpus (``rarity``, at most WIDTH * (WIDTH - 1) / 2 + 1 numbers) ranks the
windows; one that ranks first among its neighbours within REACH bytes is a feature. Windows of nearly one byte
value say nothing and are left out. Features go, in text order, into filters of FILTER_BITS bits with
FILTER_MOST features each.

Defined cases: a null text is the empty text; that has the fingerprint "0:", alike only to itself. A text
without a feature (short, or of one byte value) has one feature, its whole. Null ids come last in descending
order, ties go by text, and a single document is its own next one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textvec import U, mix

WIDTH, REACH = 16, 16
FILTER_BITS, FILTER_MOST, HASHES = 2048, 160, 5
#: Equal byte pairs of a window from which on it is too uniform to be a feature.
UNIFORM = 60
_GAP = bytes(2 * WIDTH + REACH)
_NONE = U(0xFFFFFFFFFFFFFFFF)


def pair_counts(data: np.ndarray) -> np.ndarray:
    """Equal byte pairs in each window of WIDTH bytes."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    out = np.zeros(n, np.int32)
    sums = np.zeros(len(data) + 1, np.int32)
    for d in range(1, WIDTH):
        np.cumsum(data[:-d] == data[d:], dtype=np.int32, out=sums[1 : len(data) - d + 1])
        out += sums[WIDTH - d : WIDTH - d + n]
        out -= sums[:n]
    return out


def _valid(begins: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie inside a text."""
    edge = np.zeros(n + 1, np.int32)
    long = sizes >= WIDTH
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, begins[long] + sizes[long] - WIDTH + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _laid_out(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + len(_GAP))])[:-1]
    return _GAP.join(texts) + _GAP, begins, sizes


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The feature hashes of each text, each once, in text order."""
    joined, begins, sizes = _laid_out(texts)
    data = np.frombuffer(joined, np.uint8)
    counts = pair_counts(data)
    n = len(counts)
    ok = _valid(begins, sizes, n) & (counts < UNIFORM)
    low, high = (np.ndarray((n,), "<u8", joined, offset=o, strides=(1,)) for o in (0, 8))
    h = mix(low * U(0x9E3779B97F4A7C15) ^ mix(high + U(0x632BE59BD9B4E019)))
    key = np.where(ok, (ranks[np.minimum(counts, UNIFORM)] << U(48)) | (h >> U(16)), _NONE)
    least, span = np.concatenate([np.full(REACH, _NONE), key, np.full(REACH, _NONE)]), 1
    while span < 2 * REACH + 1:
        step = min(span, 2 * REACH + 1 - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    at = np.flatnonzero(ok & (key == least[:n]))
    bounds = np.searchsorted(at, np.concatenate([begins, [n]]))
    chosen, out = h[at], []
    for i, t in enumerate(texts):
        f = chosen[bounds[i] : bounds[i + 1]]
        if not len(f):
            f = np.array([xxhash.xxh64_intdigest(t)] if t else [], U)
        elif len(f) > 1:
            f = f[np.sort(np.unique(f, return_index=True)[1])]
        out.append(f)
    return out


class Digest:
    """Chained filters as rows of bits, with the number of features."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.count = len(hashes)
        filters = -(-self.count // FILTER_MOST)
        bits = np.zeros((filters, FILTER_BITS), bool)
        row = np.arange(self.count) // FILTER_MOST
        for k in range(HASHES):
            bits[row, (hashes >> U(11 * k)) & U(FILTER_BITS - 1)] = True
        self.bits = bits
        self.sums = bits.sum(1)

    def __str__(self) -> str:
        return f"{self.count}:{base64.b64encode(np.packbits(self.bits).tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        out = cls.__new__(cls)
        count, _, body = text.partition(":")
        out.count = int(count)
        out.bits = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).astype(bool).reshape(-1, FILTER_BITS)
        out.sums = out.bits.sum(1)
        return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: each filter of the shorter chain takes its best overlap beyond chance in the other chain."""
    if not a.count or not b.count:
        return float(a.count == b.count)
    if (len(a.sums), a.count) > (len(b.sums), b.count):
        a, b = b, a
    got, right = 0.0, b.bits.astype(np.float32).T
    for i in range(0, len(a.sums), 256):
        part, sums = a.bits[i : i + 256], a.sums[i : i + 256, None]
        overlap = part.astype(np.float32) @ right
        chance = sums * b.sums[None] / FILTER_BITS
        most = np.minimum(sums, b.sums[None])
        score = np.clip((overlap - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
        share = np.minimum(FILTER_MOST, a.count - FILTER_MOST * np.arange(i, i + len(part)))
        got += float((score * share).sum())
    return min(1.0, got / a.count)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(UNIFORM + 1, np.int64)
    for _, texts in common.steps(batches):
        joined, begins, sizes = _laid_out(texts)
        counts = pair_counts(np.frombuffer(joined, np.uint8))
        total += np.bincount(np.minimum(counts[_valid(begins, sizes, len(counts))], UNIFORM), minlength=UNIFORM + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(UNIFORM + 1), pa.int64()), pa.array(total)], names=["pairs", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each pair count, the rarest in the corpus first."""
    rows = common.text_of(docs).mapInArrow(common.lean(_histogram), "pairs long, n long").groupBy("pairs").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(UNIFORM + 1, np.int64)
    for r in rows:
        n[r["pairs"]] = r["n"]
    ranks = np.empty(UNIFORM + 1, U)
    ranks[np.lexsort((np.arange(UNIFORM + 1), n))] = np.arange(UNIFORM + 1, dtype=U)
    return ranks


def fingerprint(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    return [Digest(f) for f in features(texts, ranks)]


def with_next(docs: DataFrame) -> DataFrame:
    """(slice, extra, doc_id, text), partitioned by slice and sorted: within a slice each row is followed by the
    next document in descending id order; the first of the following slice comes once more, as extra.

    Ids are cut into as many ranges as there are shuffle partitions, each a partition of its own, so the driver sees
    one id a range and no partition needs another's rows.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = common.text_of(docs)
    low = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low))
    cuts = docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts if c > low})

    @F.pandas_udf("int")
    def slice_of(ids: pd.Series) -> pd.Series:  # 0 has the largest ids
        return pd.Series(len(cuts) - np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(np.int64), "left"), dtype="int32")

    rows = rows.withColumn("key", key).withColumn("slice", slice_of("key"))
    heads = sorted((r["slice"], r["head"]) for r in docs.select(key.alias("key")).withColumn("slice", slice_of("key")).groupBy("slice").agg(F.max("key").alias("head")).collect())
    before = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]  # the last slice is before the first
    known = [h for h, _ in before]
    to = F.element_at(F.map_from_arrays(F.lit(known), F.lit([s for _, s in before])), F.when(F.col("key").isin(known), F.col("key"))) if before else F.lit(None).cast("int")
    places = F.array(F.struct(F.col("slice"), F.lit(0).alias("extra")), F.struct(to.alias("slice"), F.lit(1).alias("extra")))
    rows = rows.select("key", "doc_id", "text", F.explode(F.filter(places, lambda p: p["slice"].isNotNull())).alias("p"))
    rows = rows.select("p.slice", "p.extra", "key", "doc_id", "text").repartitionById(n, "slice")
    return rows.sortWithinPartitions("slice", "extra", F.desc("key"), "text").select("slice", "extra", "doc_id", "text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ranks: np.ndarray):
    def out(rows: list[tuple[int, int, int | None, bytes]], digests: list[Digest]) -> pa.RecordBatch:
        """For each row that the next one follows."""
        texts = [r[3].decode("utf-8", "surrogatepass") for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        changed = [edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass") for i in pairs]
        other = fingerprint(changed, ranks)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([str(digests[i]) for i in pairs], pa.string()),
                pa.array([str(d) for d in other], pa.string()),
                pa.array([likeness(digests[i], d) for i, d in zip(pairs, other, strict=True)], pa.float64()),
                pa.array([likeness(digests[i], digests[i + 1]) for i in pairs], pa.float64()),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        digests: list[Digest] = []
        for part, texts in common.steps(batches):
            slices, extra, ids = (part.column(c).to_pylist() for c in ("slice", "extra", "doc_id"))
            rows += zip(slices, extra, ids, texts, strict=True)
            digests += fingerprint(texts, ranks)
            yield out(rows, digests)
            rows, digests = rows[-1:], digests[-1:]

    return run


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next document are."""
    common.prepare(docs.sparkSession)
    return with_next(docs).mapInArrow(common.lean(_compare(rarity(docs))), SCHEMA)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(common.documents(spark, sf_dir))
