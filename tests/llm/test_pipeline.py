"""The pipeline's stages with null and repeated ids against plain versions."""

import collections
import random

import corpus_pipeline
from quillon.llm import mixing, near_dedup, sentencepiece_scan, toxicity

from .data import HARD, frame


def test_mixed_takes_each_row_as_mix_decides(spark):
    r = random.Random(5)
    texts = [*HARD[:5], *("x " * r.randrange(1, 40) for _ in range(400))]
    sources = [r.choice(["a", "b", "b", "b", None]) for _ in texts]
    for hot in range(3):  # null ids, and one id that a third of the rows share
        ids = [None if i % 7 == 0 else 1000 + hot if i % 3 == 0 else i for i in range(len(texts))]
        docs = frame(spark, texts, ids=ids, sources=sources)
        want = collections.Counter()
        for x in mixing.mix(docs).collect():
            want[x["doc_id"], x["source"], x["size"]] += x["copies"]
        out = mixing.mixed(docs)
        assert out.schema == docs.schema
        got = collections.Counter((x["doc_id"], x["source"], len((x["text"] or "").split())) for x in out.collect())
        assert got == +want
        assert any(k[0] is None for k in got)


def test_mixed_splits_the_copies_of_one_id(spark):
    """All rows of one source share an id, so its remainder runs out among them."""
    texts = ["x " * 10] * 70
    sources = ["a"] * 30 + ["b"] * 40
    docs = frame(spark, texts, ids=[7] * 30 + list(range(100, 140)), sources=sources)
    target = {x["source"]: x["target"] for x in mixing.mix(docs).collect()}
    n = collections.Counter(x["source"] for x in mixing.mixed(docs).collect())
    assert all(abs(10 * n[s] - target[s]) <= 10 for s in target)
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_run_keeps_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(30)) for _ in range(40)]
    ids = [None if i % 5 == 0 else 7 if i % 3 == 0 else i for i in range(40)]
    docs = frame(spark, texts, ids=ids, sources=["a", "b"] * 20)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = near_dedup.deduplicated(toxicity.accepted(docs, None))
    assert kept.count() == 40
    want = collections.Counter()
    for x in mixing.mix(docs).collect():
        want[x["doc_id"]] += x["copies"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(x["doc_id"] for x in rows) == +want and want[None] > 0
    v = sentencepiece_scan.load(sentencepiece_scan.MODEL)
    assert {sentencepiece_scan.decode(v, x["ids"]) for x in rows} <= set(texts)


def test_deduplicated_keeps_one_row_of_each_group(spark):
    r = random.Random(9)
    text = lambda: " ".join(str(r.randrange(10**6)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = a + " more words here"
    rows = [
        (5, a), (9, near), (None, a), (5, a),  # one group: a repeated row, a near copy, a copy without id
        (9, b), (5, c),  # unlike texts under ids of that group
        (None, d), (None, d), (None, d + " tail"),  # a group without any id
        (3, e), (2, e), (2, e + " end"),  # the least id has two texts
        (4, None), (4, ""), (None, None),  # without words all stay
    ]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    out = near_dedup.deduplicated(docs)
    assert out.schema == docs.schema
    got = collections.Counter((x["doc_id"], x["text"]) for x in out.collect())
    assert got[5, a] == 1 and got[9, near] == got[None, a] == 0
    assert got[9, b] == got[5, c] == 1
    assert got[None, d] + got[None, d + " tail"] == 1
    assert got[2, e] + got[2, e + " end"] == 1 and got[3, e] == 0
    assert got[4, None] == got[4, ""] == got[None, None] == 1
    assert sum(got.values()) == 8
    found = collections.Counter((x["doc_id"], x["component_id"]) for x in near_dedup.near_duplicates(docs).collect())
    assert found[9, 5] == 1 and found[9, 9] == 1 and found[5, 5] == 3 and found[None, 5] == 1 and found[3, 2] == 1
    assert near_dedup.deduplicated(frame(spark, [])).count() == 0
