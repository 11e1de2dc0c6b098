"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays
that workers map into memory.

Counting: each task counts its words and word pairs and deals sums out to shards by hash. Each shard's task
adds them up, writes its part of the vocabulary and of the pair table, and deals out what each word's pairs
add to it as history and as continuation; tasks by word add that up and write the word table. Files go to the
shared folder under a name of their own, each under a temporary name first, so a repeated task does no harm.
The driver gets one row of sums a shard.

What tasks deal out goes as one compressed block for each task and shard: the words of the block once, pairs as
places among them, counts in as few bytes as they need.

Tables hold 64-bit keys in ascending order; the leading bits name the shard. A word's key is its 64-bit hash, a
pair's a 64-bit mix of both words' whole hashes, so of P pairs about P * P / 2**65 share a key. Counts have the
width that the largest of their file needs. A worker maps the files (from a store that has no local paths it first
copies them to an unlinked temporary file), so the page cache holds one copy of the model for all workers of a
machine, and memory of its own doesn't grow with the corpus.

Model: p(w | v) = (c(v, w) - D(c) + g(v) * p(w)) / c(v, .), with p(w) from the number of different words
before w in the same way, and 1 / (V + 1) below that. Discounts come from counts of counts; where those are 0
(tiny corpora) a discount is 0.75. After an unseen history p(w | v) = p(w).

Defined cases: a null text is the empty text, whose one token is the end. Without training rows every
probability is 1. Equal texts score alike, repeated training rows count each time. Other columns are not read.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec
from .textvec import U, mix

BEGIN, END = U(0x5851F42D4C957F2D), U(0xA0761D6478BD642F)
#: Tokens that a counting task holds before it passes sums on.
HELD = 4 << 20
COLUMNS = {"vocab": ("n",), "pairs": ("n",), "words": ("total", "n1", "n2", "n3", "before")}


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the keys."""
    return ((keys >> U(40)) * U(shards) >> U(24)).astype(np.int32)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text; and offsets."""
    h, at = textvec.word_hashes(texts)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def histories(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word before each token."""
    before = np.concatenate([h[:0], [BEGIN], h[:-1]])[: len(h)]
    before[at[:-1]] = BEGIN
    return before


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before) * U(3) + h)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in as few bytes as its largest needs, compressed."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        kind = np.min_scalar_type(a.max()) if len(a) else np.dtype(np.uint8)
        planes = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), kind.itemsize).T)
        parts += [struct.pack("<BQ", kind.itemsize, len(a)), planes.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(block: bytes) -> list[np.ndarray]:
    data, out, i = zstandard.decompress(block), [], 1
    for _ in range(data[0]):
        width, n = struct.unpack_from("<BQ", data, i)
        i += 9
        planes = np.frombuffer(data, np.uint8, width * n, i).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(U))
        i += width * n
    return out


def pack_pairs(before: np.ndarray, h: np.ndarray, n: np.ndarray) -> bytes:
    words, at = np.unique(np.concatenate([before, h]), return_inverse=True)
    v, w = at[: len(h)], at[len(h) :]
    order = np.argsort(v * len(words) + w)
    return pack(np.diff(words, prepend=U(0)), np.diff(v[order], prepend=0), w[order], n[order])


def unpack_pairs(block: bytes) -> tuple[np.ndarray, ...]:
    words, v, w, n = unpack(block)
    words = np.cumsum(words, dtype=U)
    return words[np.cumsum(v).astype(np.int64)], words[w.astype(np.int64)], n.astype(np.int64)


# ---- files


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_table(base: str, table: str, shard: int, keys: np.ndarray, columns: dict[str, np.ndarray]) -> None:
    fs, path = _store(base)
    for name, values in {"key": keys, **columns}.items():
        if name != "key" and len(values):
            values = values.astype(np.min_scalar_type(values.max()))
        final, draft = f"{path}/{table}-{name}-{shard}.bin", f"{path}/.{table}-{name}-{shard}-{uuid.uuid4().hex}"
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(draft) as out:
            out.write(np.ascontiguousarray(values).tobytes())
        fs.move(draft, final)


@cache
def _mapped(base: str, table: str, name: str, shard: int) -> np.ndarray:
    fs, path = _store(base)
    file = f"{path}/{table}-{name}-{shard}.bin"
    info = fs.get_file_info(file)
    if info.type == pafs.FileType.NotFound or not info.size:
        return np.zeros(0, U)
    kind = "<u8" if name == "key" else f"<u{info.size // len(_mapped(base, table, 'key', shard))}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(file, kind, "r")
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(file) as source:
        while block := source.read(16 << 20):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, kind, "r")


def look_up(base: str, table: str, shards: int, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The table's columns for each key, 0 where it has none."""
    wanted, back = np.unique(keys, return_inverse=True)
    out = [np.zeros(len(wanted), np.int64) for _ in COLUMNS[table]]
    bounds = np.searchsorted(shard_of(wanted, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        have, part = _mapped(base, table, "key", int(s)), slice(bounds[s], bounds[s + 1])
        if len(have):
            at = np.minimum(np.searchsorted(have, wanted[part]), len(have) - 1)
            hit = have[at] == wanted[part]
            for o, name in zip(out, COLUMNS[table], strict=True):
                o[part][hit] = _mapped(base, table, name, int(s))[at[hit]]
    return tuple(o[back] for o in out)


# ---- counting


def _blocks(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= common.BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Each shard that ascending keys fall into, with its part of them."""
    bounds = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), slice(bounds[s], bounds[s + 1])


_COUNTS = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())])


def _count(shards: int):
    """A block of words and one of pairs, with counts, for each shard."""

    def sums(words: list[np.ndarray], before: list[np.ndarray]) -> Iterator[tuple]:
        h, v = np.concatenate(words), np.concatenate(before)
        key, n = np.unique(h, return_counts=True)
        for s, part in _dealt(key, shards):
            yield s, pack(np.diff(key[part], prepend=U(0)), n[part]), None
        key, at, n = np.unique(pair_keys(v, h), return_index=True, return_counts=True)
        for s, part in _dealt(key, shards):
            yield s, None, pack_pairs(v[at[part]], h[at[part]], n[part])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words: list[np.ndarray] = []
        before: list[np.ndarray] = []
        for _, texts in common.steps(batches, size=common.BATCH_BYTES):
            h, at = tokens(texts)
            words.append(h)
            before.append(histories(h, at))
            if sum(map(len, words)) >= HELD:
                yield from sums(words, before)
                words, before = [], []
        if words:
            yield from sums(words, before)

    return lambda batches: _blocks(rows(batches), _COUNTS)


def _added(key: np.ndarray, values: list[np.ndarray], same: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """Keys ascending, values summed by key, and columns that are the same in all rows of a key."""
    if not len(key):
        return key, values, same
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], [np.add.reduceat(v[order], first) for v in values], tuple(c[order[first]] for c in same)


class Sums:
    """Sums by key, added up whenever more rows wait than there are keys, so that memory follows the keys."""

    def __init__(self, values: int, same: int = 0) -> None:
        self.parts = [(np.zeros(0, U), [np.zeros(0, np.int64)] * values, (np.zeros(0, U),) * same)]
        self.kept = self.waiting = 0

    def add(self, key: np.ndarray, values: list[np.ndarray], same: tuple[np.ndarray, ...] = ()) -> None:
        self.parts.append((key, values, same))
        self.waiting += len(key)
        if self.waiting > max(HELD // 4, self.kept):
            self.total()

    def total(self) -> tuple[np.ndarray, ...]:
        keys, values, same = zip(*self.parts, strict=True)
        join = lambda columns: [np.concatenate(c) for c in zip(*columns, strict=True)]
        done = _added(np.concatenate(keys), join(values), tuple(join(same)))
        self.parts, self.kept, self.waiting = [done], len(done[0]), 0
        return done


STATS = ("total", "n1", "n2", "n3", "before")
SUMS = ("n1", "n2", "n3", "n4", "tokens", "types")
_STATS = pa.schema([("shard", pa.int32()), ("stats", pa.binary()), *((f"sum_{c}", pa.int64()) for c in SUMS)])


def _write_pairs(base: str, shards: int):
    """Write each shard's vocabulary and pairs; pass on what words get from its pairs, and the shard's sums."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words: dict[int, Sums] = {}
        pairs: dict[int, Sums] = {}
        for batch in batches:
            for s, w, p in zip(*(batch.column(c).to_pylist() for c in _COUNTS.names), strict=True):
                if w is not None:
                    key, n = unpack(w)
                    words.setdefault(s, Sums(1)).add(np.cumsum(key, dtype=U), [n.astype(np.int64)])
                if p is not None:
                    v, h, n = unpack_pairs(p)
                    pairs.setdefault(s, Sums(1, 2)).add(pair_keys(v, h), [n], (v, h))
        sums = np.zeros(len(SUMS), np.int64)
        for s in list(words):
            k, (c,), _ = words.pop(s).total()
            write_table(base, "vocab", s, k, {"n": c})
            sums[4:] += [c.sum(), len(c)]
        for s in list(pairs):
            k, (c,), (v, h) = pairs.pop(s).total()
            write_table(base, "pairs", s, k, {"n": c})
            sums[:4] += [(c == j).sum() for j in (1, 2, 3, 4)]
            history, as_history, _ = _added(v, [c, *((c == j).astype(np.int64) for j in (1, 2)), (c > 2).astype(np.int64)])
            word, (before,), _ = _added(h, [np.ones(len(k), np.int64)])
            none = np.zeros_like
            stats = [np.concatenate([x, none(before)]) for x in as_history] + [np.concatenate([none(as_history[0]), before])]
            f, stats, _ = _added(np.concatenate([history, word]), stats)
            for to, part in _dealt(f, shards):
                yield to, pack(np.diff(f[part], prepend=U(0)), *(x[part] for x in stats)), *([0] * len(SUMS))
        yield 0, None, *map(int, sums)

    return lambda batches: _blocks(rows(batches), _STATS)


def _write_words(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(SUMS), np.int64)
        words: dict[int, Sums] = {}
        for batch in batches:
            sums += [sum(batch.column(f"sum_{c}").to_pylist()) for c in SUMS]
            for s, block in zip(batch.column("shard").to_pylist(), batch.column("stats").to_pylist(), strict=True):
                if block is not None:
                    f, *stats = unpack(block)
                    words.setdefault(s, Sums(len(STATS))).add(np.cumsum(f, dtype=U), [x.astype(np.int64) for x in stats])
        seen = np.zeros(6, np.int64)
        for s in list(words):
            f, stats, _ = words.pop(s).total()
            before = stats[4]
            seen += [*((before == j).sum() for j in (1, 2, 3, 4)), before.sum(), (before > 0).sum()]
            write_table(base, "words", s, f, dict(zip(STATS, stats, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in [*sums, *seen]], names=[*SUMS, *(f"w{i}" for i in range(6))])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """0, D1, D2, D3+ from how many items have the counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.75 for k in (1, 2, 3)]
    return np.array([0.0, *(min(float(k), max(0.0, x)) for k, x in zip((1, 2, 3), d, strict=True))])


class Model:
    """Where the tables are, and the few sums that scoring needs."""

    def __init__(self, base: str, shards: int, sums: dict[str, int]) -> None:
        self.base, self.shards = base, shards
        self.tokens, self.types = sums["tokens"], sums["types"]
        self.pair_d = discounts([sums[f"n{k}"] for k in (1, 2, 3, 4)])
        w = [sums[f"w{i}"] for i in range(6)]
        self.word_d, self.pairs, self.words = discounts(w[:4]), w[4], w[5]
        self.rest = float(self.word_d[1:] @ [w[0], w[1], w[5] - w[0] - w[1]])

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, model score) of each text."""
        h, at = tokens(texts)
        (seen,) = look_up(self.base, "vocab", self.shards, h)
        base = np.log10((seen + 1) / (self.tokens + (self.types + 1)))
        history = histories(h, at)
        (c,) = look_up(self.base, "pairs", self.shards, pair_keys(history, h))
        before = look_up(self.base, "words", self.shards, h)[4]
        if self.pairs:
            p = (before - self.word_d[np.minimum(before, 3)] + self.rest / (self.words + 1)) / self.pairs
        else:
            p = np.ones(len(h))
        total, n1, n2, n3, _ = look_up(self.base, "words", self.shards, history)
        back = self.pair_d[1] * n1 + self.pair_d[2] * n2 + self.pair_d[3] * n3
        p = np.where(total > 0, (c - self.pair_d[np.minimum(c, 3)] + back * p) / np.maximum(total, 1), p)
        add = lambda x: np.add.reduceat(x, at[:-1])
        return np.diff(at), add((seen > 0).astype(np.int64)), add(base), add(np.log10(p))


def train(docs: DataFrame, where: Column | None = None) -> Model:
    """Count the (chosen) documents and write the model's tables to the shared folder."""
    spark = docs.sparkSession
    base = f"{common.shared_dir(spark)}/quillon-lm-{uuid.uuid4().hex}"
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = common.text_of(docs if where is None else docs.filter(where)).select("text")
    counts = rows.mapInArrow(common.lean(_count(shards)), "shard int, words binary, pairs binary")
    stats = counts.repartitionById(shards, F.col("shard")).mapInArrow(common.lean(_write_pairs(base, shards)), "shard int, stats binary, " + ", ".join(f"sum_{x} long" for x in SUMS))
    sums = stats.repartitionById(shards, F.col("shard")).mapInArrow(common.lean(_write_words(base)), ", ".join(f"{c} long" for c in (*SUMS, *(f"w{i}" for i in range(6)))))
    total = sums.groupBy().sum().first()
    return Model(base, shards, {c: int(total[f"sum({c})"] or 0) for c in (*SUMS, *(f"w{i}" for i in range(6)))})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each document."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.steps(batches, size=common.BATCH_BYTES):
            n, known, base, own = model.score(texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), *map(pa.array, (n, known, np.full(len(n), model.tokens), base, own, 10 ** np.minimum(300.0, -own / n)))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return common.text_of(docs).mapInArrow(common.lean(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = common.fold(F.col("doc_id"), 7) == 2
    rows = score(docs, train(docs, ~held))
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
