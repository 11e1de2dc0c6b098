"""The other operators against plain versions and held-out accuracy."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm import common, fingerprints, language_model, media, mixing, near_dedup, quality, textvec, toxicity

from .data import HARD, frame, noise


def plain_words(t):
    return (t or "").encode().lower().split()


def save(df, path):
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def plain_components(texts, percent):
    sets = []
    for t in texts:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at = list(range(len(texts)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                at[y] = x
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = list(HARD)
    for n in (30, 80, 200):
        base = [r.choice(vocab) for _ in range(n)]
        for k in range(9):
            copy = list(base)
            for _ in range(k * n // 120 + k % 2):
                copy[r.randrange(n)] = r.choice(vocab)
            texts.append(" ".join(copy))
            texts.append(" ".join([r.choice(vocab) for _ in range(n)] + base[: n // 3]))
    sizes, roots = plain_components(texts, 85)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(frame(spark, texts), percent=85).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(got[i]["kept"] == (roots[i] == i) for i in got)


def test_windows_are_those_of_words():
    texts = [(t or "").encode() for t in HARD[:6] + noise(8, 50)]
    h, at = textvec.word_hashes(texts)
    words = [plain_words(t.decode()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    names = {}
    for w, x in zip([x for ws in words for x in ws], h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else weight[s] * level
        if not over:
            break
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing_meets_targets(spark):
    r = random.Random(2)
    texts = [*HARD[:5], *("x " * r.randrange(1, 40) for _ in range(400))]
    sources = [r.choice(["a", "b", "b", "b", "b", "ü", None, "Z"]) for _ in texts]
    rows = mixing.mix(frame(spark, texts, sources=sources)).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(plain_words(t))
    want, taken = plain_targets(sizes), collections.Counter()
    for x in rows:
        assert x["size"] == len(plain_words(texts[x["doc_id"]])) and x["source_size"] == sizes[x["source"]]
        assert math.isclose(x["target"], want[x["source"]]) and 0 <= x["copies"] <= 3
        taken[x["source"]] += x["size"] * x["copies"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    again = {x["doc_id"]: x["copies"] for x in mixing.mix(frame(spark, texts, sources=sources)).collect()}
    assert again == {x["doc_id"]: x["copies"] for x in rows}
    assert mixing.mix(frame(spark, [])).count() == 0


def test_language_model_equals_plain_counts(spark, tmp_path):
    texts = HARD[:5] + ["a b a c", "A b d", "b a b a", "e", "a a a", "c d e a b", "zz yy"] * 3
    path = save(frame(spark, texts), tmp_path)
    got = {x["doc_id"]: x for x in language_model.op10_lm_scoring(spark, path).collect()}
    docs = [[*plain_words(t), b"</s>"] for t in texts]
    train = [d for i, d in enumerate(docs) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for d in train for w in d)
    pairs = collections.Counter(p for d in train for p in zip([b"<s>", *d], d, strict=False))
    before = collections.Counter(b for _, b in pairs)
    n, v = sum(c.values()), len(c)
    d2 = language_model.discounts([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)])
    d1 = language_model.discounts([sum(x == k for x in before.values()) for k in (1, 2, 3, 4)])
    rest = sum(d1[min(x, 3)] for x in before.values())

    def word(w):
        return (before[w] - d1[min(before[w], 3)] + rest / (len(before) + 1)) / len(pairs)

    def pair(a, w):
        follow = [x for (y, _), x in pairs.items() if y == a]
        if not follow:
            return word(w)
        return (pairs[a, w] - d2[min(pairs[a, w], 3)] + sum(d2[min(x, 3)] for x in follow) * word(w)) / sum(follow)

    for i, d in enumerate(docs):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(d), sum(c[w] > 0 for w in d), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d), rel_tol=1e-9)
        assert math.isclose(got[i]["score"], sum(math.log10(pair(a, w)) for a, w in zip([b"<s>", *d], d, strict=False)), rel_tol=1e-9)
    a = b"a"
    assert math.isclose(sum(pair(a, w) for w in before) + pair(a, b"never seen"), 1.0, rel_tol=1e-9)


def test_language_model_blocks():
    r = np.random.default_rng(4)
    for arrays in ([[]], [[0]], [[5, 300, 0], [2**64 - 1, 1, 2**32]], [r.integers(0, 2**63, 1000), r.integers(0, 9, 7)]):
        arrays = [np.array(a, np.uint64) for a in arrays]
        assert [a.tolist() for a in language_model.unpack(language_model.pack(*arrays))] == [a.tolist() for a in arrays]
    few = r.integers(1, 2**63, 40).astype(np.uint64) * np.uint64(2)
    v, w = few[r.integers(0, 40, 500)], few[r.integers(0, 40, 500)]
    n = r.integers(1, 2**40, 500)
    back = language_model.unpack_pairs(language_model.pack_pairs(v, w, n))
    assert sorted(zip(*(a.tolist() for a in back), strict=True)) == sorted(zip(v.tolist(), w.tolist(), n.tolist(), strict=True))


def test_language_model_tables_over_many_flushes(monkeypatch, tmp_path):
    """Counting with several flushes a task, several tasks and several shards equals plain counts."""
    monkeypatch.setattr(language_model, "HELD", 50)
    r, shards = random.Random(8), 3
    texts = [" ".join(r.choice("a b c d e f g h i j k l m n".split()) for _ in range(r.randrange(0, 60))) for _ in range(90)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(part)], names=["text"])
    monkeypatch.setattr(common, "BATCH_BYTES", 200)
    counts = [b for k in range(3) for b in language_model._count(shards)(iter([batch(texts[k::3])]))]
    base = str(tmp_path)
    pick = lambda batches, s: [b.filter(pc.equal(b.column("shard"), s)) for b in batches]
    stats = [b for s in range(shards) for b in language_model._write_pairs(base, shards)(iter(pick(counts, s)))]
    sums = [next(language_model._write_words(base)(iter(pick(stats, s)))).to_pylist()[0] for s in range(shards)]
    h, at = language_model.tokens([t.encode() for t in texts])
    before = language_model.histories(h, at)
    words = collections.Counter(h.tolist())
    pairs = collections.Counter(zip(before.tolist(), h.tolist(), strict=True))
    assert sum(x["tokens"] for x in sums) == len(h) and sum(x["types"] for x in sums) == len(words)
    assert [sum(x[f"n{k}"] for x in sums) for k in (1, 2, 3, 4)] == [sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]
    assert language_model.look_up(base, "vocab", shards, h)[0].tolist() == [words[w] for w in h.tolist()]
    found = language_model.look_up(base, "pairs", shards, language_model.pair_keys(before, h))[0]
    assert found.tolist() == [pairs[p] for p in zip(before.tolist(), h.tolist(), strict=True)]
    got = np.array(language_model.look_up(base, "words", shards, before)).T.tolist()
    for v, row in dict(zip(before.tolist(), got, strict=True)).items():
        follow = [c for (a, _), c in pairs.items() if a == v]
        assert row == [sum(follow), follow.count(1), follow.count(2), sum(c > 2 for c in follow), sum(b == v for _, b in pairs)]


def test_language_model_without_rows(spark, tmp_path):
    assert language_model.op10_lm_scoring(spark, save(frame(spark, []), tmp_path)).count() == 0


def test_fingerprints(spark, tmp_path):
    r = random.Random(6)
    texts = [*HARD, *("".join(r.choice("abcdefgh ijkl\n") for _ in range(r.randrange(50, 6000))) for _ in range(20))]
    path = save(frame(spark, texts), tmp_path)
    rows = {x["doc_id"]: x for x in fingerprints.op7_document_fingerprints(spark, path).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""  # descending ids, after 0 the largest
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert rows[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(t)
        a, b = (fingerprints.Digest.parse(rows[i][c]) for c in ("fingerprint", "edited_fingerprint"))
        assert math.isclose(fingerprints.likeness(a, b), rows[i]["near_edited"], abs_tol=1e-6)
        assert (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) == (t == new) or not t.strip()
    assert rows[9]["fingerprint"] == rows[10]["fingerprint"]
    long = [x for i, x in rows.items() if i > len(HARD)]
    assert np.mean([x["near_edited"] for x in long]) > 0.3 > 0.1 > np.mean([x["near_next"] for x in long])


def test_media_round_trip(spark, tmp_path):
    texts = HARD + noise(7, 30)
    path = save(frame(spark, texts), tmp_path)
    rows = {x["doc_id"]: x for x in media.op9_media_columns(spark, path).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        x = rows[i]
        assert (x["n_bytes"], x["payload_bytes"], x["media_bytes"]) == (len(data), len(payload), 44 + len(payload))
        assert x["payload_sha256"] == hashlib.sha256(payload).hexdigest() and x["tail_crc32"] == zlib.crc32(payload[-16:])
        assert media.load(media.store(payload)) == payload
    assert rows[9]["feature"] == rows[10]["feature"]
    codes, at = media.peak_pairs([media.pad((t or "").encode()) for t in texts])
    for i in (5, 7, 20):
        assert codes[at[i] : at[i + 1]].tolist() == media.peak_pairs([media.pad((texts[i] or "").encode())])[0].tolist()


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = old = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old, older = [i], row, old
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                    row[j] = min(row[j], older[j - 2] + 1)
        return row[-1]

    r = random.Random(3)
    lexicon = {"".join(r.choice("abc") for _ in range(r.randrange(3, 9))): 1.0 for _ in range(25)}
    a = toxicity.Automaton(lexicon)
    for _ in range(1500):
        token = "".join(r.choice("abc") for _ in range(r.randrange(1, 10)))
        near = [w for w in lexicon if distance(w, token) == 0 or len(w) >= toxicity.FUZZY and distance(w, token) == 1]
        got = a.read(token)
        assert (got is not None) == bool(near), (token, near, got)
        assert got is None or got[1] == min(distance(w, token) for w in near)


def test_masked_spellings_are_read():
    a = toxicity.Automaton({"idiot": 3.0, "stupid": 2.0, "scum": 1.0}, frozenset({"idiom"}))
    for token, term in {"id1ot": "idiot", "idoit": "idiot", "st*pid": "stupid", "1diot": "idiot", "diot": "idiot", "sc*m": "scum", "you.idiot": "idiot", "stupidd": "stupid"}.items():
        assert a.match(token)[0] == term, token
    assert not any(map(a.match, ["idiom", "scam", "st1p1d", "id", "2019", "a-b"]))
    assert [t for t in toxicity.TOKEN.findall("you st*pid, id1ot! $tupid")] == ["you", "st*pid", "id1ot", "$tupid"]


def classified(spark, module, label, bad):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        y = i % 2
        labels.append((i, y))
        texts.append(" ".join(r.choice(words) if r.random() > 0.1 or y != bad else r.choice(["wretch!!", "scoundrel!!", "villain!!"]) for _ in range(60)))
    docs = frame(spark, texts + HARD, ids=[*range(400), *range(1000, 1000 + len(HARD))])
    table = spark.createDataFrame(labels, f"doc_id long, {label} int")
    model = module.train(docs, table, module.learners())
    got = {x["doc_id"]: x["score"] for x in module.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % (5 if module is toxicity else 3) == (0 if module is toxicity else 1)]
    assert len(got) == 400 + len(HARD) and all(0 <= s <= 1 for s in got.values())
    assert got[1009] == got[1010]
    return np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in held])


def test_toxicity_on_held_out_rows(spark):
    assert classified(spark, toxicity, "toxic", 1) > 0.95


def test_quality_on_held_out_rows(spark):
    assert classified(spark, quality, "quality", 0) > 0.9


def test_word_vectors_equal_plain_sums(spark):
    texts = [*HARD[:5], "a b c a", "b a, c!", "d " * 30, "a b c a"]
    sums = {}
    for t in texts:
        words = [zlib.crc32(w) for w in quality.TOKEN.findall((t or "").encode())]
        for i, w in enumerate(words):
            v = sums.setdefault(int(quality.buckets(np.array([w], np.uint32))[0]), np.zeros(quality.DIM))
            for d in (-2, -1, 1, 2):
                if 0 <= i + d < len(words):
                    for k in range(4):
                        byte = words[i + d] >> (8 * k) & 255
                        v[byte & 63] += -1 if byte & 128 else 1
    table = quality.word_vectors(frame(spark, texts).repartition(3))
    for bucket in range(quality.BUCKETS):
        v = sums.get(bucket, np.zeros(quality.DIM))
        assert np.allclose(table[bucket], v / (np.linalg.norm(v) + 1e-9), atol=1e-6)
    assert not quality.word_vectors(frame(spark, [])).any()


def test_models_without_labels(spark):
    docs, none = frame(spark, ["a", None]), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.train(docs, none, toxicity.learners()) is None and quality.train(docs, none, quality.learners()) is None
    assert [x["score"] for x in toxicity.score(docs, None).collect()] == [0.0, 0.0]
