"""Relationships as text: ``type:id#rel@type:id#rel[caveat:{json}][expiration:time]``, and consistency tokens."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ELLIPSIS, TUPLES
from .cel import timestamp

# The grammar of the parts.
NAME = r"[a-z][a-z0-9_]{1,62}[a-z0-9]"
TYPE = rf"(?:[a-z][a-z0-9_]{{1,61}}[a-z0-9]/)*{NAME}"
RESOURCE_ID = r"[a-zA-Z0-9/_|\-=+]+"
SUBJECT_ID = r"[a-zA-Z0-9/_|\-=+]+|\*"
TIME = r"[0-9\-.:TZ]+"
LONGEST_ID = 1024

OBJECT = re.compile(rf"(?P<type>{TYPE}):(?P<id>{RESOURCE_ID})#(?P<rel>{NAME})\n?")
LINE = re.compile(
    rf"(?P<rtype>{TYPE}):(?P<rid>{RESOURCE_ID})#(?P<rrel>{NAME})@(?P<stype>{TYPE}):(?P<sid>{SUBJECT_ID})(?:#(?P<srel>{NAME}|\.\.\.))?"
    rf"(?:\[(?P<caveat>{TYPE})(?::(?P<ctx>\{{.+\}}))?\])?(?:\[expiration:(?P<exp>{TIME})\])?\n?"
)
#: The same grammar's frame for Spark's own expressions: seven groups.
FRAME = r"^([^:#@\[]+):([^#@\[]+)#([^@\[]+)@([^:#@\[]+):([^#@\[]+)(?:#([^@\[]+))?((?:\[.*\])?)$"


def nanos(s: str) -> int:
    """RFC 3339 time in nanoseconds; digits after the seventh of the fraction are dropped."""
    m = re.fullmatch(r"(.*\.\d{7})\d*(\D.*)", s)
    return timestamp(m[1] + m[2] if m else s).ns


def rfc3339(ns: int) -> str:
    import datetime as dt

    at = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=ns // 10**9)
    frac = f".{ns % 10**9:09d}".rstrip("0") if ns % 10**9 else ""
    return f"{at.isoformat()}{frac}Z"


def canonical(context) -> str:
    """JSON with sorted keys, no spaces, and <, > and & escaped."""
    out = json.dumps(context, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return re.sub("[<>&\u2028\u2029]", lambda m: f"\\u{ord(m[0]):04X}", out)


def parse_line(line: str) -> tuple | None:
    """The nine columns of a relationship, or None if the line isn't one. One line end may follow, no other blank."""
    m = LINE.fullmatch(line)
    if not m or max(len(m["rid"]), len(m["sid"])) > LONGEST_ID:
        return None
    try:
        ctx = canonical(json.loads(m["ctx"])) if m["ctx"] else None
        exp = nanos(m["exp"]) if m["exp"] else None
    except ValueError:
        return None
    return m["rtype"], m["rid"], m["rrel"], m["stype"], m["sid"], m["srel"] or ELLIPSIS, m["caveat"], ctx, exp


def parse_object(text: str) -> tuple[str, str, str] | None:
    """Type, id and relation of ``type:id#relation``, or None."""
    m = OBJECT.fullmatch(text)
    return (m["type"], m["id"], m["rel"]) if m and len(m["id"]) <= LONGEST_ID else None


def objects(rows: DataFrame, column: str) -> DataFrame:
    """The rows with type, id and relation of the objects in a text column; null where it has none."""
    kind = "struct<type:string,id:string,rel:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else parse_object(x) for x in batch.column(0).to_pylist()]
            columns = [pa.array([None if f is None else f[i] for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, ["type", "id", "rel"])], names=[column, "object"])

    return rows.select(column).mapInArrow(run, f"{column} string, object {kind}").select(column, "object.*")


def parse(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Relationships of text lines, by the whole grammar and canonical contexts; lines that are none raise, or
    are left out if not ``strict``. Blank lines and ``//`` comments are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                if not line or not line.strip() or line.strip().startswith("//"):
                    continue
                row = parse_line(line.strip())
                if row is not None:
                    rows.append(row)
                elif strict:
                    raise ValueError(f"no relationship: {line!r}")
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.name == "expiration_ns" else pa.string()) for c, f in zip(columns, TUPLES, strict=True)], names=TUPLES.names)

    return lines.select(column).mapInArrow(run, TUPLES)


def parts(text: Column) -> list[Column]:
    """The six parts by a built-in expression, for lines without conditions."""
    get = lambda i: F.regexp_extract(text, FRAME, i)
    names = ("resource_type", "resource_id", "resource_rel", "subject_type", "subject_id")
    return [*(get(i + 1).alias(n) for i, n in enumerate(names)), F.when(get(6) == "", ELLIPSIS).otherwise(get(6)).alias("subject_rel")]


def text(extras: bool = True) -> Column:
    """The canonical line of a relationship row, by built-in expressions."""
    out = [F.concat_ws(":", "resource_type", "resource_id"), F.lit("#"), F.col("resource_rel"), F.lit("@"), F.concat_ws(":", "subject_type", "subject_id"), F.when(F.col("subject_rel") != ELLIPSIS, F.concat(F.lit("#"), "subject_rel")).otherwise("")]
    if extras:
        ctx = F.when(F.col("caveat_ctx").isNotNull() & ~F.col("caveat_ctx").isin("", "{}"), F.concat(F.lit(":"), "caveat_ctx")).otherwise("")
        out.append(F.when(F.col("caveat_name").isNotNull(), F.concat(F.lit("["), F.col("caveat_name"), ctx, F.lit("]"))).otherwise(""))
        ns = F.col("expiration_ns")
        seconds = F.date_format(F.timestamp_seconds(F.floor(ns / F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss")
        frac = F.regexp_replace(F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"), "0+$", "")
        out.append(F.when(ns.isNotNull(), F.concat(F.lit("[expiration:"), seconds, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(""), F.lit("Z]"))).otherwise(""))
    return F.concat(*out)


def token(store: str, revision: int, schema_hash: str) -> str:
    return base64.b64encode(f"v1\n{store}\n{revision}\n{schema_hash}".encode()).decode()


def parse_token(value: str) -> tuple[str, int, str]:
    try:
        version, store, revision, schema = base64.b64decode(value, validate=True).decode().split("\n")
        if version == "v1":
            return store, int(revision), schema
    except ValueError:
        pass
    raise ValueError("no consistency token")


def cursor(request: dict, key: list[str]) -> str:
    """A place in the rows of one request, which no other request takes."""
    return base64.urlsafe_b64encode(canonical({"v": 1, "request": digest(request), "key": key}).encode()).decode()


def parse_cursor(value: str, request: dict) -> list[str]:
    try:
        found = json.loads(base64.urlsafe_b64decode(value.encode()))
        version, asked, key = found["v"], found["request"], found["key"]
    except (ValueError, KeyError, TypeError):
        raise ValueError("no cursor") from None
    if version != 1 or asked != digest(request):
        raise ValueError("the cursor belongs to another request")
    return key


def digest(request: dict) -> str:
    return hashlib.sha256(canonical(request).encode()).hexdigest()
