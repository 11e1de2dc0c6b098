"""Secret scans: an Aho-Corasick pass finds keywords, anchored regular expressions run only at its hits, and
token formats with an embedded checksum count only if the checksum holds.

Every kind has keywords without which it cannot match: words for assignments, ``AKIA`` for access keys, all
runs of four hexadecimal digits for hexadecimal strings, prefixes for tokens with a checksum. Hits come in
text order, and one inside an earlier match of its kind is passed over, so the matches are those of a
left-to-right search of the whole text.

Defined cases: a null text is the empty text and has no spans. Equal rows give equal results; other columns
are kept by ``redact`` and not read by ``scan``.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("assign", "access", "hex")
#: Kinds with an embedded checksum, after the base kinds.
CHECKED = ("github", "npm")
ORDER = {k: i for i, k in enumerate(BASE + CHECKED)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
# The digits of base 62 in these tokens' checksums.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
SPANS = "array<struct<kind:string,start:int,end:int>>"


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        a.add_word(word, ("assign", len(word)))
    a.add_word("akia", ("access", 4))
    for word in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
        a.add_word(word, ("token", 4))
    for digits in itertools.product("0123456789abcdef", repeat=4):
        a.add_word("".join(digits), ("hex", 4))
    a.make_automaton()
    return a


def base62(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind."""
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, past = [], dict.fromkeys(("assign", "access", "hex", "token"), 0)
    for last, (kind, size) in automaton().iter(lower):
        start = last - size + 1
        if start < past[kind]:
            continue
        if kind == "hex":
            if not (m := HEX.match(text, start)):
                continue
            good = m.end() - start >= LEAST_HEX
        elif kind == "assign":
            if not (m := ASSIGN.match(text, start)):
                continue
            good = len(m[2]) >= LEAST_VALUE
        elif kind == "access":
            if not (m := ACCESS.match(text, start)):
                continue
            good = m.end() - start >= LEAST_ACCESS
        else:
            if not (m := TOKEN.match(text, start)):
                continue
            good = base62(zlib.crc32(m[2].encode()), 6) == m[3]
        past[kind] = m.end()
        if good:
            found.append((("npm" if m[1] == "npm" else "github") if kind == "token" else kind, start, m.end()))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for rows, texts in common.steps(batches):
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.decode("utf-8", "surrogatepass"))] for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(spans, kind)], names=["doc_id", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the spans of each document."""
    common.prepare(docs.sparkSession)
    return common.text_of(docs).mapInArrow(common.lean(_scan), f"doc_id long, found {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with secrets in ``text`` replaced and ``n_chars`` set to the new length."""
    common.prepare(docs.sparkSession)
    at, has_n = docs.columns.index("text"), "n_chars" in docs.columns
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, find(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if has_n:
                n = batch.schema.get_field_index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in texts], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(common.lean(run), kinds)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of spans, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("found"), BASE), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
