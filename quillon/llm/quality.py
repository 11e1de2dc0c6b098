"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network with
temperature-calibrated probabilities.

Tokens are runs of letters and digits, and runs of other marks; each also has a shape, its letters and digits
replaced by their class. Every token's index vector has four entries of +-1 among DIM, taken from its crc32.
A word's vector is the sum of the index vectors that stand within two places of it in any document, of unit length
(random indexing). All documents count, labelled or not. Words share a table of BUCKETS vectors by a hash, so every
word has one and the table's size doesn't depend on the corpus. A document is the mean index vector of its tokens and
of their shapes, its mean word vector, and two numbers: distinct tokens per token, and log length.

Each task sums its own table and passes it on in BLOCKS parts; a part's sums are added up as they come, first by
groups of tasks, then all.

The network (tanh layer, logistic output) learns from parts 0 to 7 of a bounded sample; parts 8 and 9 set the
temperature by which its logits are divided.

Defined cases: a null text is the empty text, whose vector is zero; it gets a score like any other. Without
labels of both kinds all scores are 0.5. Equal texts score alike; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

#: About so many documents of each label, at most, are learnt from.
FIT_ROWS = 6_000
DIM, HIDDEN = 64, 32
BUCKETS, BLOCKS, SALTS = 1 << 14, 64, 8
EPOCHS, BATCH, RATE, DECAY = 40, 128, 2e-3, 1e-4
TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+")
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
SIZE = 3 * DIM + 2


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(crc32 of tokens, offsets)."""
    found = [TOKEN.findall(t) for t in texts]
    at = np.cumsum([0] + [len(f) for f in found])
    return np.fromiter((c for f in found for c in map(zlib.crc32, f)), np.uint32, at[-1]), at


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of tokens, of their shapes, offsets)."""
    words, at = words_of(texts)
    memo: dict[bytes, int] = {}
    shapes = np.empty(at[-1], np.uint32)
    for i, t in enumerate(texts):  # translation keeps token bounds
        shapes[at[i] : at[i + 1]] = [memo[s] if s in memo else memo.setdefault(s, zlib.crc32(s)) for s in TOKEN.findall(t.translate(_SHAPE))]
    return words, shapes, at


def entries(crc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), four of each a token."""
    b = crc[:, None] >> np.array([0, 8, 16, 24], np.uint32)
    return (b & 63).astype(np.int64), 1.0 - 2.0 * ((b >> 7) & 1)


def pooled(crc: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n * DIM)
    for i in range(0, len(crc), 1 << 18):
        place, sign = entries(crc[i : i + (1 << 18)])
        out += np.bincount((owner[i : i + (1 << 18), None] * DIM + place).ravel(), sign.ravel(), n * DIM)
    return out.reshape(n, DIM)


def buckets(crc: np.ndarray) -> np.ndarray:
    """Places in the table of word vectors."""
    return ((crc * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int64)


def summed(table: np.ndarray, place: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the table's rows at ``place`` for each owner (ascending)."""
    out = np.zeros((n, table.shape[1]))
    for i in range(0, len(place), 1 << 15):
        o = owner[i : i + (1 << 15)]
        first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        out[o[first]] += np.add.reduceat(table[place[i : i + (1 << 15)]], first, axis=0)
    return out


def vectors(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """The pooled vector of each document. table: word vectors, a row a bucket."""
    words, shapes, at = tokens(texts)
    n, count = len(texts), np.diff(at)
    owner = np.repeat(np.arange(n), count)
    out = np.zeros((n, SIZE), np.float32)
    per = np.maximum(count, 1)[:, None]
    out[:, :DIM] = pooled(words, owner, n) / per
    out[:, DIM : 2 * DIM] = pooled(shapes, owner, n) / per
    out[:, 2 * DIM : 3 * DIM] = summed(table, buckets(words), owner, n) / per
    key = np.sort(owner.astype(np.uint64) << np.uint64(32) | words)
    distinct = np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(32)).astype(np.int64), minlength=n) if len(key) else np.zeros(n)
    out[:, -2] = distinct / per[:, 0]
    out[:, -1] = np.log1p(count) / 8
    return out


def contexts(texts: list[bytes], sums: np.ndarray) -> None:
    """Add to ``sums`` (BUCKETS * DIM) the index vectors within two places of each word, at the word's bucket."""
    words, at = words_of(texts)
    owner, place = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at)), buckets(words) * DIM
    for i in range(0, len(words), 1 << 17):
        low, high = max(0, i - 2), min(len(words), i + (1 << 17) + 2)  # two words more on both sides
        where, sign = entries(words[low:high])
        own, cell = owner[low:high], place[low:high, None]
        inside = np.zeros(high - low, bool)
        inside[i - low : i - low + (1 << 17)] = True
        cells, signs = [], []
        for d in (1, 2):
            same = own[d:] == own[:-d]
            for mid, side in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
                ok = same & inside[mid]
                cells.append((cell[mid][ok] + where[side][ok]).ravel())
                signs.append(sign[side][ok].ravel())
        sums += np.bincount(np.concatenate(cells), np.concatenate(signs), len(sums))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums, a row a block."""
    sums = np.zeros(BUCKETS * DIM)
    for _, texts in common.steps(batches, size=2 << 20):
        contexts(texts, sums)
    parts = [p.astype(np.int32).tobytes() for p in np.split(sums, BLOCKS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "sums"])


def _added(kind, to):
    """Arrow function: blocks of the type ``kind`` added up, a row each of type ``to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(data.as_buffer(), kind)
                total[block] = total[block] + x if block in total else x.astype(np.float64)
        for block, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.astype(to).tobytes()], pa.binary())], names=["block", "sums"])

    return run


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors (BUCKETS, DIM), of unit length, from all documents."""
    common.prepare(docs.sparkSession)
    kind = "block int, sums binary"
    sums = common.text_of(docs).select("text").mapInArrow(common.lean(_contexts), kind)
    sums = sums.withColumn("salt", F.spark_partition_id() % SALTS).repartition(BLOCKS, "block", "salt").select("block", "sums")
    sums = sums.mapInArrow(common.lean(_added(np.int32, np.int64)), kind).repartition(BLOCKS, "block")
    table = np.zeros((BLOCKS, BUCKETS * DIM // BLOCKS))
    for r in sums.mapInArrow(common.lean(_added(np.int64, np.int64)), kind).collect():  # BUCKETS * DIM numbers in all
        table[r["block"]] = np.frombuffer(r["sums"], np.int64)
    table = table.reshape(BUCKETS, DIM)
    return (table / (np.linalg.norm(table, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


class Network:
    """tanh layer and one logit; inputs standardised, logits divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.middle, self.spread = x.mean(0), x.std(0) + 1e-3
        self.w1, self.b1 = r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
        self.temperature = 1.0
        x = (x - self.middle) / self.spread
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                part = order[i : i + BATCH]
                h = np.tanh(x[part] @ self.w1 + self.b1)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[part]) / len(part)
                dh = g[:, None] * self.w2 * (1 - h * h)
                t += 1
                for k, grad in enumerate((x[part].T @ dh + DECAY * self.w1, dh.sum(0), h.T @ g + DECAY * self.w2, g.sum(keepdims=True))):
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    params[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss, by golden section over its logarithm."""
        z = self.logits(x)
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -z, z) / np.exp(t)).mean()
        a, b, g = -2.5, 2.5, (5**0.5 - 1) / 2
        for _ in range(50):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        self.temperature = float(np.exp((a + b) / 2))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Model:
    def __init__(self, table: np.ndarray, network: Network) -> None:
        self.table, self.network = table, network

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.network.probability(vectors(texts, self.table))


def train(docs: DataFrame, labels: DataFrame, where: Column) -> Model | None:
    """Word vectors from all documents; network and temperature from a bounded sample of the labelled rows that
    ``where`` admits."""
    rows = labelled.sample(docs, labels, "quality", where, FIT_ROWS)
    if rows.isEmpty():
        return None
    table = word_vectors(docs)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches):
            x = vectors(texts, table)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), part.column("label"), part.column("part")], names=["x", "label", "part"])

    seen = sorted(rows.mapInArrow(common.lean(measured), "x binary, label int, part int").collect(), key=lambda r: (r["part"], r["label"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in seen]).reshape(-1, SIZE)
    y, part = np.array([r["label"] for r in seen], float), np.array([r["part"] for r in seen])
    fit = part < 8
    if not 0 < y[fit].sum() < fit.sum():
        return None
    network = Network(x[fit], y[fit])
    if (~fit).any():
        network.calibrate(x[~fit], y[~fit])
    return Model(table, network)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each document."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.steps(batches):
            got = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(got.astype(np.float64))], names=["doc_id", "score"])

    return common.text_of(docs).mapInArrow(common.lean(run), "doc_id long, score double")


def learners() -> Column:
    return common.fold(F.col("doc_id"), 3) != 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), learners())
    rows = score(common.documents(spark, sf_dir), model)
    return rows.select("doc_id", (~learners()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
