"""The relationship table through time: commits, history, compaction.

A row lives from created_rev until deleted_rev. A commit joins staged updates with live rows on the six-part key
and closes or adds rows; the table is written anew, the change log only gets what is new.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CHANGELOG, KEY, RELATIONSHIPS, TUPLES
from ..functions.tuples import canonical
from ..plans.dsl import compile_schema
from ..plans.graph import schema_hash
from ..plans.validate import check_schema, relationship_faults
from .filters import Filter, conditions, query, visible
from .fixpoint import keep

PAYLOAD = ("caveat_name", "caveat_ctx", "expiration_ns")
MOST_UPDATES = 1000


class Conflict(ValueError):
    """A commit that can't be made as asked."""


def intervals(changes: DataFrame) -> DataFrame:
    """Rows with created_rev and deleted_rev from a log of changes (rev, op, key, payload).

    A touch that changes nothing and a delete of nothing leave no trace. Each key's changes are one window, so
    the work is spread by key; a key's history is as long as its own changes.
    """
    by = Window.partitionBy(*KEY).orderBy("rev")
    same = F.lit(True)
    for c in PAYLOAD:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(by))
    log = changes.withColumns({"pop": F.lag("op").over(by), "same": same})
    touched = F.col("op").isin("touch", "create")
    log = log.filter((touched & (F.col("pop").isNull() | (F.col("pop") == "delete") | ~F.col("same"))) | ((F.col("op") == "delete") & F.col("pop").isin("touch", "create")))
    log = log.withColumn("deleted_rev", F.lead("rev").over(by))
    return log.filter(F.col("op") != "delete").select(*KEY, *PAYLOAD, F.col("rev").alias("created_rev"), "deleted_rev")


def apply_updates(rows: DataFrame, updates: DataFrame, revision: int) -> DataFrame:
    """The table after updates (op, key, payload) with distinct keys: create raises if the key is live (see
    ``conflicts``), touch writes unless the payload is the same, delete closes what is there."""
    staged = updates.select("op", *KEY, *(F.col(c).alias(f"u_{c}") for c in PAYLOAD))
    live = F.col("deleted_rev").isNull()
    same = F.lit(True)
    for c in PAYLOAD:
        same = same & F.col(c).eqNullSafe(F.col(f"u_{c}"))
    old = rows.withColumn("alive", live)
    met = old.join(staged, list(KEY), "left")
    closes = F.col("alive") & ((F.col("op") == "delete") | (F.col("op").isin("touch", "create") & ~same))
    kept = met.select(*KEY, *PAYLOAD, "created_rev", F.when(closes, F.lit(revision)).otherwise(F.col("deleted_rev")).cast("long").alias("deleted_rev"))
    unchanged = old.filter("alive").select(*KEY, *(F.col(c).alias(f"o_{c}") for c in PAYLOAD), F.lit(True).alias("had"))
    fresh = updates.filter(F.col("op") != "delete").join(unchanged, list(KEY), "left")
    alike = F.coalesce(F.col("had"), F.lit(False))
    for c in PAYLOAD:
        alike = alike & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    fresh = fresh.filter(~alike).select(*KEY, *PAYLOAD, F.lit(revision).cast("long").alias("created_rev"), F.lit(None).cast("long").alias("deleted_rev"))
    return kept.unionByName(fresh)


def conflicts(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """(key, why) of updates that can't be made: a key that is there twice, or a create of a live key."""
    twice = updates.groupBy(*KEY).count().filter("count > 1").select(*KEY, F.lit("twice").alias("why"))
    creates = updates.filter(F.col("op") == "create").select(*KEY).distinct()
    return twice.unionByName(creates.join(rows.filter("deleted_rev is null").select(*KEY), list(KEY), "left_semi").withColumn("why", F.lit("exists")))


def to_delete(rows: DataFrame, f: Filter, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the rows that a delete by filter takes, one row (count, reached)): in resource-first order, ``limit`` at
    most; the limit counts as reached also if exactly so many match."""
    hit = query(rows, f)
    if limit > 0:
        hit = hit.orderBy(*KEY).limit(limit)
    n = hit.agg(F.count("*").alias("deleted"))
    return hit, n.select("deleted", (F.lit(limit > 0) & (F.col("deleted") >= limit)).alias("reached"))


def changes_at(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(rev, op, key, payload) of the revisions in (low, high]: what a revision creates is a touch; what it closes is
    a delete unless it touches the same key."""
    made = rows.filter((F.col("created_rev") > low) & (F.col("created_rev") <= high)).select(F.col("created_rev").alias("rev"), F.lit("touch").alias("op"), *KEY, *PAYLOAD)
    gone = rows.filter((F.col("deleted_rev") > low) & (F.col("deleted_rev") <= high)).select(F.col("deleted_rev").alias("rev"), F.lit("delete").alias("op"), *KEY, *PAYLOAD)
    return made.unionByName(gone.join(made.select("rev", *KEY), ["rev", *KEY], "left_anti"))


def collected(rows: DataFrame, floor: int) -> DataFrame:
    """The table without rows closed at or before the floor; reads at the floor or later don't change."""
    return rows.filter(F.col("deleted_rev").isNull() | (F.col("deleted_rev") > floor))


def as_of(versions: DataFrame, keys: list[str], revision: int, tombstone: str | None = None) -> DataFrame:
    """The last version of each key up to a revision (column rev); one whose ``tombstone`` column is null is gone."""
    out = versions.filter(F.col("rev") <= revision)
    if keys:
        last = Window.partitionBy(*keys).orderBy(F.desc("rev"))
        out = out.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    else:
        out = out.orderBy(F.desc("rev")).limit(1)
    return out.filter(F.col(tombstone).isNotNull()) if tombstone else out


def resolve(consistency: str, head: int, now_ns: int, at: int | None = None, quantum_ns: int = 5 * 10**9, floor: int = 0) -> int:
    """The revision that a request reads: full (the head), latency (the head, or now rounded down to the quantum),
    fresh (at least ``at``) or exact (``at``, which must lie between floor and head)."""
    quick = min(head, now_ns - now_ns % quantum_ns) if quantum_ns else head
    if consistency == "full":
        return head
    if consistency == "latency":
        return max(quick, floor)
    if consistency not in ("fresh", "exact") or at is None:
        raise Conflict(f"no consistency {consistency!r}")
    if at > head:
        raise Conflict("the revision isn't there yet")
    if consistency == "fresh":
        return max(quick, at)
    if at < floor:
        raise Conflict("the revision has been collected")
    return at


@dataclass
class Commit:
    """What one transaction asks for, in the order in which it is looked at."""

    updates: DataFrame | None = None
    preconditions: list[tuple[str, Filter, bool]] = field(default_factory=list)
    delete: Filter | None = None
    delete_limit: int = 0
    whole_delete: bool = True
    schema: str | None = None
    counters: dict[str, str | None] = field(default_factory=dict)
    expected_head: int | None = None
    schema_hash: str | None = None
    #: Kept with the revision's changes in the log.
    metadata: dict | None = None


def compiled(schema: str):
    return check_schema(compile_schema(schema))


class Store:
    """Relationships, schemas, counters and the change log as DataFrames, with the head revision."""

    def __init__(self, spark: SparkSession, schema: str | None = None) -> None:
        self.spark, self.head, self.floor = spark, 0, 0
        self.rows = spark.createDataFrame([], RELATIONSHIPS)
        self.log = spark.createDataFrame([], CHANGELOG)
        self.schemas: list[tuple[int, str, str]] = []
        if schema is not None:
            self.schemas.append((0, schema_hash(compiled(schema)), schema))
        self.counters = spark.createDataFrame([], "rev long, name string, filter string")

    def live(self, revision: int | None = None) -> DataFrame:
        if revision is not None and not self.floor <= revision <= self.head:
            raise Conflict("no such revision")
        return visible(self.rows, self.head if revision is None else revision)

    def commit(self, c: Commit, now_ns: int | None = None) -> tuple[int, int, bool]:
        """(revision, deleted, limit reached). Nothing changes if anything is refused."""
        if c.expected_head is not None and c.expected_head != self.head:
            raise Conflict("the head has moved")
        if c.schema_hash is not None and (not self.schemas or self.schemas[-1][1] != c.schema_hash):
            raise Conflict("the schema has changed")
        revision = max(time.time_ns() if now_ns is None else now_ns, self.head + 1)
        live = self.live()
        if c.preconditions and (bad := conditions(live, c.preconditions).filter("not holds").first()):
            raise Conflict(f"precondition {bad['name']!r} doesn't hold")
        rows, deleted, reached = self.rows, 0, False
        schema = c.schema if c.schema is not None else self.schemas[-1][2] if self.schemas else None
        if c.updates is not None:
            if c.updates.limit(MOST_UPDATES + 1).count() > MOST_UPDATES:
                raise Conflict(f"more than {MOST_UPDATES} updates")
            self.refuse(live, c.updates, schema)
            rows = apply_updates(rows, c.updates, revision)
        if c.delete is not None:
            current = rows.filter("deleted_rev is null")
            if c.whole_delete and c.delete_limit and query(current, c.delete).limit(c.delete_limit + 1).count() > c.delete_limit:
                raise Conflict("more rows match than the limit allows")
            hit, n = to_delete(current, c.delete, c.delete_limit)
            deleted, reached = n.first()
            rows = apply_updates(rows, hit.select(F.lit("delete").alias("op"), *TUPLES.names), revision)
        rows = keep(rows)
        if c.schema is not None:
            new = compiled(c.schema)
            if bad := relationship_faults(new, rows.filter("deleted_rev is null")).first():
                raise Conflict(f"{shown(bad)} would be left: {bad['fault']}")
            self.schemas.append((revision, schema_hash(new), c.schema))
        if c.counters:
            self.counters = keep(self.counters.union(self.spark.createDataFrame([(revision, k, v) for k, v in c.counters.items()], self.counters.schema)))
        self.rows = rows
        self.logged(revision, c.schema is not None, c.metadata)
        return revision, deleted, reached

    def refuse(self, live: DataFrame, updates: DataFrame, schema: str | None) -> None:
        """Raise Conflict for updates that can't be made or that the schema doesn't allow."""
        if schema is None:
            raise Conflict("no schema has been written")
        if bad := relationship_faults(compiled(schema), updates.filter(F.col("op") != "delete")).first():
            raise Conflict(f"{shown(bad)}: {bad['fault']}")
        if bad := conflicts(live, updates).first():
            raise Conflict(f"{shown(bad)}: {bad['why']}")

    def logged(self, revision: int, changed: bool = False, metadata: dict | None = None) -> None:
        """Make ``revision`` the head, with its changes in the log."""
        noted = F.lit(None if metadata is None else canonical(metadata)).cast("string").alias("tx_metadata")
        log = changes_at(self.rows, revision - 1, revision).select("rev", F.lit(0).alias("seq"), "op", *TUPLES.names, F.lit(changed).alias("schema_changed"), noted)
        self.log, self.head = self.log.unionByName(keep(log)), revision

    def bulk_import(self, tuples: DataFrame, now_ns: int | None = None) -> int:
        """All rows in one revision, any number of them; a key that is there twice or already, or a row that the schema
        doesn't allow, refuses the whole."""
        updates = tuples.select(F.lit("create").alias("op"), *TUPLES.names)
        self.refuse(self.live(), updates, self.schemas[-1][2] if self.schemas else None)
        revision = max(time.time_ns() if now_ns is None else now_ns, self.head + 1)
        self.rows = keep(self.rows.unionByName(updates.drop("op").withColumns({"created_rev": F.lit(revision).cast("long"), "deleted_rev": F.lit(None).cast("long")})))
        self.logged(revision)
        return revision

    def collect_garbage(self, floor: int) -> None:
        """Rows closed and changes logged at or before the floor go."""
        self.rows, self.floor = keep(collected(self.rows, floor)), max(self.floor, floor)
        self.log = keep(self.log.filter(F.col("rev") > floor))


def shown(row) -> str:
    return f"{row['resource_type']}:{row['resource_id']}#{row['resource_rel']}"
