"""The scan against whole-text paths, a plain longest path, and the library's own unigram engine."""

import random
from array import array

import numpy as np
import pytest

from quillon.llm import sentencepiece_scan as sp

from .data import HARD, frame, noise


def plain(v, text):
    """Longest path over all places, ties to the longer last piece."""
    worth, last = v.best(text, 0, len(text))
    out, at = [], len(text)
    while at:
        start = last[at]
        hit = v.ids.get(text[start:at])
        out.append((hit[1],) if hit else v.fallback(text[start:at])[1])
        at = start
    return [i for ids in out[::-1] for i in ids]


def scan(v, text, chunk):
    ahead = v.reach - 1
    parts = [(text[a : a + chunk + ahead], min(chunk, len(text) - a)) for a in range(0, len(text), chunk)]
    given = sp.worths(np.array([sp.transfer(v, *p) for p in parts]))
    at = sp.chained(np.array([sp.origins(v, *p, g) for p, g in zip(parts, given, strict=True)]))
    return [i for p, b, e in zip(parts, at, at[1:], strict=False) for i in array("I", sp.backtrace(v, *p, b, e))]


@pytest.fixture(scope="module")
def vocabulary():
    return sp.load(sp.MODEL)


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_whole_text_on_small_vocabularies(seed):
    r = random.Random(seed)
    pieces = {"a", "b", sp.SPACE} | {"".join(r.choice("ab") for _ in range(r.randrange(2, 6))) for _ in range(12)}
    if seed % 2:
        pieces |= {sp.SPACE + "a", sp.SPACE + "ab"}
    v = sp.Vocabulary([(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)] + [(p, -float(r.randrange(1, 5)), "normal") for p in sorted(pieces)])
    for _ in range(60):
        text = sp.escaped("".join(r.choice("aabb c") for _ in range(r.randrange(1, 120))))
        want = plain(v, text)
        assert v.whole(text)[1] == want
        for chunk in (8, 11, 30):
            assert scan(v, text, chunk) == want, (text, chunk)
        assert sp.decode(v, want) == text[1:].replace(sp.SPACE, " ")


def test_library_unigram_engine_agrees(vocabulary):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = pb.ModelProto()
    with open(sp.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    engine = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["The quick  brown fox", "réeuxpa Êtion\n\téretion", "日本語 text \U0001f600!", *noise(3, 60)]
    for t in texts:
        assert vocabulary.whole(sp.escaped(t))[1] == engine.encode(t), t


def test_round_trip_and_chunks_in_spark(spark, tmp_path):
    texts = HARD + noise(5, 40) + ["".join(random.Random(9).choice("abcdé ") for _ in range(3000))]
    df = frame(spark, texts, ids=[*range(len(texts) - 2), 7, 7])
    whole = sp.encode(df, chunk=1 << 20).select("doc_id", "ids").collect()
    chunked = sp.decoded(sp.encode(df, chunk=256)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in whole) == sorted((r["doc_id"], r["ids"]) for r in chunked)
    assert sorted(r["decoded"] for r in chunked) == sorted(t or "" for t in texts)
    assert max(r["chunks"] for r in chunked) > 100
    assert sp.encode(frame(spark, [])).count() == 0


def test_merges_equal_the_library_on_the_file_as_it_is(spark):
    import sentencepiece

    engine = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    r = random.Random(8)
    texts = [*HARD, *noise(7, 60), "the international  evaluation\nof         wörds 日本語 \U0001f600!", "".join(r.choice("abcdé") for _ in range(4000)), " " * 3000 + "x"]
    v = sp.encoder(sp.MODEL)
    for t in texts:
        t = t or ""
        want = engine.encode(t)
        assert array("I", v.packed(sp.escaped(t))).tolist() == want, t[:50]
        assert [x for part in v.parts(sp.escaped(t), 100) for x in array("I", v.packed(part))] == want
        assert sp.decode(v.v, want) == t
    for t in texts[-3:]:
        assert v.coded(v.queued(sp.escaped(t)[:200])) == v.joined(sp.escaped(t)[:200])
        if len(sp.escaped(t)) > 1:
            short = [sp.escaped(t)[:40], sp.escaped(t)[:2]]
            assert v.joined_all(short) == [v.joined(x) for x in short]
    got = sp.encode(frame(spark, texts), chunk=256).collect()
    assert {x["doc_id"]: x["ids"] for x in got} == {i: engine.encode(t or "") for i, t in enumerate(texts)}


def test_unigram_files_still_take_the_scan(spark, tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = pb.ModelProto()
    with open(sp.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(m.SerializeToString())
    engine = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    texts = noise(6, 10) + ["international evaluation " * 40]
    got = sp.encode(frame(spark, texts), model=str(tmp_path / "unigram.model"), chunk=256).collect()
    assert {x["doc_id"]: x["ids"] for x in got} == {i: engine.encode(t) for i, t in enumerate(texts)}
    m.trainer_spec.model_type = 3
    (tmp_path / "word.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        sp.encoder(str(tmp_path / "word.model"))
