"""Scans of the relationship table: as of a revision, without expired rows, filtered, ordered, paged.

Predicates are equality, IN, prefix and null tests on the flat columns, so they reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tuples
from ..model import ELLIPSIS, KEY, WILDCARD


def visible(rows: DataFrame, revision: int) -> DataFrame:
    """Rows that exist at a revision."""
    return rows.filter((F.col("created_rev") <= revision) & (F.col("deleted_rev").isNull() | (F.col("deleted_rev") > revision)))


def unexpired(rows: DataFrame, now_ns: int) -> DataFrame:
    """Rows that haven't expired; one that expires exactly now has."""
    return rows.filter(F.col("expiration_ns").isNull() | (F.col("expiration_ns") > now_ns))


@dataclass(frozen=True)
class SubjectRelation:
    """Which subject relations match: any of those named, ``...``, or only others than ``...``. ``ellipsis`` alone
    matches every relation, and so does a filter without anything."""

    names: tuple[str, ...] = ()
    ellipsis: bool = False
    only_other: bool = False

    def column(self) -> Column | None:
        rel = F.col("subject_rel")
        if self.only_other:
            return rel != ELLIPSIS
        if not self.names:
            return None
        return rel.isin(*self.names, ELLIPSIS) if self.ellipsis else rel.isin(*self.names)


@dataclass(frozen=True)
class Subjects:
    type: str | None = None
    ids: tuple[str, ...] = ()
    relation: SubjectRelation | None = None

    def column(self) -> Column:
        rel = self.relation.column() if self.relation else None
        return _all(F.col("subject_type") == self.type if self.type is not None else None, F.col("subject_id").isin(*self.ids) if self.ids else None, rel)


def _all(*columns: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in columns if c is not None], F.lit(True))


@dataclass(frozen=True)
class Filter:
    """All set fields must match; no ids means any id. caveat: a name, "" for rows with none, None for no test;
    expires: whether there is an expiration, None for no test. Of several subjects one must match."""

    type: str | None = None
    ids: tuple[str, ...] = ()
    prefix: str = ""
    relation: str | None = None
    subjects: tuple[Subjects, ...] = ()
    caveat: str | None = None
    expires: bool | None = None

    def column(self) -> Column:
        subjects = reduce(lambda a, b: a | b, [s.column() for s in self.subjects]) if self.subjects else None
        caveat = None if self.caveat is None else F.col("caveat_name").isNull() if not self.caveat else F.col("caveat_name").eqNullSafe(self.caveat)
        expires = None if self.expires is None else F.col("expiration_ns").isNotNull() if self.expires else F.col("expiration_ns").isNull()
        return _all(
            F.col("resource_type") == self.type if self.type is not None else None,
            F.col("resource_id").isin(*self.ids) if self.ids else None,
            F.col("resource_id").startswith(self.prefix) if self.prefix else None,
            F.col("resource_rel") == self.relation if self.relation is not None else None,
            subjects, caveat, expires,
        )


def query(rows: DataFrame, f: Filter) -> DataFrame:
    return rows.filter(f.column())


def reverse(rows: DataFrame, subject: Subjects, type_: str | None = None, relation: str | None = None) -> DataFrame:
    """From the subject's side, for all resources or those of one relation."""
    return rows.filter(_all(subject.column(), F.col("resource_type") == type_ if type_ else None, F.col("resource_rel") == relation if relation else None))


def check_scan(rows: DataFrame, type_: str, relation: str, subject: tuple[str, str, str]) -> DataFrame:
    """What one step of a check reads: the exact subject, its type's wildcard, and all usersets. Three scans, so
    each has equality filters of its own."""
    base = rows.filter((F.col("resource_type") == type_) & (F.col("resource_rel") == relation))
    exact = base.filter((F.col("subject_type") == subject[0]) & (F.col("subject_id") == subject[1]) & (F.col("subject_rel") == subject[2]))
    wild = base.filter((F.col("subject_type") == subject[0]) & (F.col("subject_id") == WILDCARD))
    return exact.unionByName(wild).unionByName(base.filter((F.col("subject_rel") != ELLIPSIS) & ~((F.col("subject_type") == subject[0]) & (F.col("subject_id") == subject[1]) & (F.col("subject_rel") == subject[2]))))


BY_SUBJECT = ("subject_type", "subject_id", "subject_rel", "resource_type", "resource_id", "resource_rel")


def after(columns: Sequence[str], values: Sequence[str]) -> Column:
    """Strictly after a key in the order of the columns. The first conjunct bounds the leading column alone, which
    the reader can use."""
    out = F.lit(False)
    for i in reversed(range(len(columns))):
        out = (F.col(columns[i]) > values[i]) | ((F.col(columns[i]) == values[i]) & out)
    return (F.col(columns[0]) >= values[0]) & out


def page(rows: DataFrame, order: Sequence[str], cursor: Sequence[str] | None = None, limit: int = 0) -> DataFrame:
    """Rows in order after the cursor; 0 or less is no limit. With a limit this is a top-k, not a sort."""
    if cursor is not None:
        rows = rows.filter(after(order, cursor))
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit > 0 else rows


def read(rows: DataFrame, f: Filter, cursor: str | None = None, limit: int = 0) -> DataFrame:
    """Matching rows with their canonical line, in the order of lines, after the cursor's line."""
    return page(query(rows, f).withColumn("tuple", tuples.text()), ["tuple"], None if cursor is None else [cursor], limit)


def well_formed(rows: DataFrame) -> DataFrame:
    """Rows whose parts are all there and whose resource is no wildcard."""
    return rows.filter(_all(*(F.length(c) > 0 for c in KEY)) & (F.col("resource_id") != WILDCARD))


def counted(rows: DataFrame, f: Filter) -> DataFrame:
    """One row (n): how many match, as a registered counter reports."""
    return query(rows, f).agg(F.count("*").alias("n"))


def conditions(rows: DataFrame, wanted: list[tuple[str, Filter, bool]]) -> DataFrame:
    """(name, holds) of named preconditions: that a row matches, or that none does. All are counted in one pass."""
    sums = rows.agg(*(F.count(F.when(f.column(), 1)).alias(f"c{i}") for i, (_, f, _) in enumerate(wanted)))
    each = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col(f"c{i}") > 0) == F.lit(must)).alias("holds")) for i, (name, _, must) in enumerate(wanted)))
    return sums.select(F.explode(each).alias("x")).select("x.name", "x.holds")
