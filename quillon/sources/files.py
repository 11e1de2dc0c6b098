"""Relationships from and to files: text lines, Parquet pages, and YAML validation files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tuples
from ..model import TUPLES, Schema, SchemaError
from ..operators.filters import page
from ..plans.dsl import compile_schema
from ..plans.validate import check_schema

EXPORT_ROWS = 1000


def read_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A line each; see ``tuples.parse``."""
    return tuples.parse(spark.read.text(path), "value", strict)


def write_text(rows: DataFrame, path: str) -> None:
    rows.select(tuples.text().alias("value")).write.text(path)


def export(rows: DataFrame, cursor: str | None = None, limit: int = EXPORT_ROWS) -> DataFrame:
    """The next page of lines in their order, after the last page's last line."""
    return page(rows.select(tuples.text().alias("tuple")), ["tuple"], None if cursor is None else [cursor], limit)


@dataclass
class ValidationFile:
    schema: Schema
    relationships: list[tuple]
    #: (line, context, expected verdict)
    assertions: list[tuple[str, str | None, str]] = field(default_factory=list)
    #: object: expected subjects
    expected: dict[str, list[str]] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.relationships, TUPLES)


def load_validation(text: str, folder: str | None = None) -> ValidationFile:
    """A schema, relationships and what is expected of them. The schema stands in the text or in ``schemaFile``, a file
    of ``folder``, not in both. Raises SchemaError for a file that is malformed, repeats a relationship or has one
    that isn't one."""
    import yaml

    try:
        doc = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise SchemaError(f"no YAML: {e}") from None
    if not isinstance(doc, dict) or (other := sorted(set(doc) - {"schema", "schemaFile", "relationships", "assertions", "validation"})):
        raise SchemaError(f"unknown part {other[0]!r}" if isinstance(doc, dict) else "a mapping is wanted")
    schema, other = doc.get("schema") or "", (doc.get("schemaFile") or "").strip()
    if other:
        root = os.path.realpath(folder) if folder else ""
        path = os.path.realpath(os.path.join(root, other))
        if schema.strip() or not root or os.path.isabs(other) or not path.startswith(root + os.sep) or not os.path.isfile(path):
            raise SchemaError("a schema and a file of it" if schema.strip() else f"no local schema file {other!r}")
        with open(path, encoding="utf-8") as f:
            schema = f.read()
    rows, seen = [], set()
    for line in (doc.get("relationships") or "").splitlines():
        if line.strip() and not line.strip().startswith("//"):
            row = tuples.parse_line(line.strip())
            if row is None:
                raise SchemaError(f"no relationship: {line!r}")
            if row[:6] in seen:
                raise SchemaError(f"repeated relationship: {line!r}")
            seen.add(row[:6])
            rows.append(row)
    out = ValidationFile(check_schema(compile_schema(schema)), rows, expected=doc.get("validation") or {})
    for key, verdict in (("assertTrue", "member"), ("assertFalse", "notMember"), ("assertCaveated", "caveated")):
        for item in (doc.get("assertions") or {}).get(key) or []:
            line, _, ctx = item.partition(" with ")
            line = line.strip()
            if tuples.parse_line(line) is None:
                raise SchemaError(f"no assertion: {item!r}")
            out.assertions.append((line, ctx or None, verdict))
    return out


def changelog(log: DataFrame, path: str) -> None:
    """Append whole revisions: all rows of one revision go to one file."""
    log.repartition("rev").sortWithinPartitions("rev", "seq").write.mode("append").parquet(path)


def by_resource(rows: DataFrame, path: str, files: int) -> None:
    """Written for scans by resource: clustered and sorted, so row-group statistics prune."""
    rows.repartitionByRange(files, "resource_type", "resource_id").sortWithinPartitions("resource_type", "resource_rel", "resource_id").write.parquet(path)


def by_subject(rows: DataFrame, path: str, files: int) -> None:
    """The same rows for scans by subject."""
    rows.repartitionByRange(files, "subject_type", "subject_id").sortWithinPartitions("subject_type", "subject_id", F.col("subject_rel")).write.parquet(path)
