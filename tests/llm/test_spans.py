"""Secret and PII spans against plain searches of whole texts."""

import hashlib
import re
import zlib

import pytest

from quillon.llm import pii, secrets

from .data import HARD, frame, noise

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
SECRETS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: True),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m) >= 24),
}


def luhn(digits):
    ds = [int(c) for c in reversed(digits)]
    return (sum(ds[::2]) + sum(sum(divmod(2 * d, 10)) for d in ds[1::2])) % 10 == 0


def plain(text, kinds, by_start):
    out = []
    for k, (name, (pattern, ok)) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            if ok(m[0]) and (name != "assign" or len(m[2]) >= 6):
                out.append((m.start() if by_start else k, k if by_start else m.start(), f"{name}:{m.start()}:{m.end()}", name))
    return sorted(out)


@pytest.mark.parametrize("query, kinds, by_start", [(pii.op1_pii, PII, False), (secrets.op2_secret_scans, SECRETS, True)])
def test_base_spans_are_those_of_a_plain_search(spark, tmp_path, query, kinds, by_start):
    texts = HARD + noise(1, 400)
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t, kinds, by_start)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(w[2] for w in want).encode()).hexdigest(), (t, want, got[i])
        for name in kinds:
            assert got[i][f"n_{name}"] == sum(w[3] == name for w in want)
        assert {w[2] for w in want} <= set(got[i]["spans"].split(",")) or not want


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op1_pii(spark, str(tmp_path)).count() == 0
    assert secrets.op2_secret_scans(spark, str(tmp_path)).count() == 0


def test_classifier_takes_what_votes_agree_on(spark):
    texts = [f"my ssn is {n}-45-6789 thanks" for n in range(101, 180)] + [f"order {'0' * 9}{n} shipped" for n in range(100, 160)]
    texts += [f"mail me at u{n}@example.com" for n in range(60)]
    rows = pii.spans(frame(spark, texts)).collect()
    kinds = [[s["kind"] for s in r["extra"]] for r in rows]
    assert kinds[:79] == [["ssn"]] * 79
    assert all(k == [] for k in kinds[139:])


def test_checksum_decides_tokens():
    body = "0123456789abcdefghijABCDEFGHIJ"
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()), 6)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert ("github", 2, 42) in secrets.find("x " + good)
    assert all(k != "github" for k, _, _ in secrets.find("x " + bad))


def test_redaction_keeps_rows_and_columns(spark):
    df = frame(spark, [None, "a token = 'abcdef123' z", "plain"])
    out = secrets.redact(df)
    assert out.columns == df.columns
    assert [(r["text"], r["n_chars"]) for r in out.orderBy("doc_id").collect()] == [(None, None), ("a [SECRET]' z", 13), ("plain", 5)]
