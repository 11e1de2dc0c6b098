"""The change feed as a stream over the change log's files.

Files hold whole revisions, so a micro-batch does too. A batch's changes come out in revision order, empty
revisions not at all, and then one checkpoint row with the last revision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import CHANGELOG, ELLIPSIS, KEY
from ..operators.filters import Filter

RELATIONSHIPS, SCHEMA, CHECKPOINTS = 1, 2, 4


class Gone(ValueError):
    """A cursor below what has been collected."""


def changes(log: DataFrame, after: int, types: tuple[str, ...] = (), filters: tuple[Filter, ...] = (), content: int = RELATIONSHIPS | SCHEMA, floor: int = 0) -> DataFrame:
    """Changes strictly after a revision, batch or stream. Object types and filters exclude one another; a change of
    the schema passes any filter. ``content`` says what is wanted; a row that has none of it is dropped, metadata
    alone being no content."""
    if after < floor:
        raise Gone("the revision has been collected")
    if types and filters:
        raise ValueError("types or filters, not both")
    touched = F.col("op").isNotNull()
    if types:
        touched = touched & F.col("resource_type").isin(*types)
    if filters:
        match = F.lit(False)
        for f in filters:
            match = match | f.column()
        touched = touched & match
    wanted = F.lit(False)
    if content & RELATIONSHIPS:
        wanted = wanted | touched
    if content & SCHEMA:
        wanted = wanted | F.coalesce("schema_changed", F.lit(False))
    return log.filter((F.col("rev") > after) & F.coalesce(wanted, F.lit(False)))


def only_objects(f: Filter) -> Filter:
    """A watch filter that names an empty subject relation means subjects that are objects themselves."""
    from dataclasses import replace

    from ..operators.filters import SubjectRelation

    return replace(f, subjects=tuple(replace(s, relation=SubjectRelation((ELLIPSIS,))) if s.relation == SubjectRelation() else s for s in f.subjects))


def stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(CHANGELOG).option("maxFilesPerTrigger", max_files).parquet(path)


def watch(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame], None], after: int = 0, content: int = RELATIONSHIPS | SCHEMA | CHECKPOINTS, **filters) -> StreamingQuery:
    """Run ``sink(changes, checkpoint row)`` for each micro-batch of new log files. The checkpoint has the largest
    revision looked at, also when all its changes were filtered out, and no row in an empty batch."""

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        found = changes(batch, after, content=content & 3, **filters).orderBy("rev", "seq", *KEY)
        mark = batch.filter(F.col("rev") > after).agg(F.max("rev").alias("rev")).filter("rev is not null")
        sink(found, mark if content & CHECKPOINTS else mark.filter("false"))
        batch.unpersist()

    return stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(log: DataFrame) -> DataFrame:
    """The live rows that a log of changes leaves: each key's last operation, if it isn't a delete."""
    last = log.filter("op is not null").groupBy(*KEY).agg(F.max(F.struct("rev", "seq", "op", "caveat_name", "caveat_ctx", "expiration_ns")).alias("x"))
    return last.filter("x.op <> 'delete'").select(*KEY, "x.caveat_name", "x.caveat_ctx", "x.expiration_ns", F.col("x.rev").alias("created_rev"))
