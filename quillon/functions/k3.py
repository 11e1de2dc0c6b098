"""Conditional membership as a column: STRUCT<st INT, missing ARRAY<STRING>>.

st is 3 for unconditional (A), 2 for a condition that holds (T), 1 for one that can't be told yet for want of
the inputs in ``missing`` (U), 0 for one that fails (F). A null struct means no entry. With this order OR is the
largest state and AND the least. A and T differ: NOT turns T into F but leaves A, and removing an
unconditional entry removes a row outright.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A, T, U, FALSE = 3, 2, 1, 0
TYPE = "struct<st:int,missing:array<string>>"


def none() -> Column:
    return F.lit(None).cast(TYPE)


def of(st: Column, missing: Column | None = None) -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(st.cast("int").alias("st"), (empty if missing is None else F.coalesce(missing, empty)).alias("missing")).cast(TYPE)


def always() -> Column:
    return of(F.lit(A))


def _merged(st: Column, a: Column, b: Column) -> Column:
    names = lambda x: F.when(x["st"] == U, x["missing"]).otherwise(F.array().cast("array<string>"))
    both = F.array_sort(F.array_union(names(a), names(b)))
    return of(st, F.when(st == U, both))


def or_(a: Column, b: Column) -> Column:
    """Either; no entry on one side leaves the other."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(_merged(F.greatest(a["st"], b["st"]), a, b))


def or_keep(a: Column, b: Column) -> Column:
    """Either, but an unconditional side says nothing."""
    return F.when(a.isNull() | (a["st"] == A), b).when(b.isNull() | (b["st"] == A), a).otherwise(or_(a, b))


def and_(a: Column, b: Column) -> Column:
    """Both; no entry on one side is none."""
    return F.when(a.isNull() | b.isNull(), none()).otherwise(_merged(F.least(a["st"], b["st"]), a, b))


def not_(a: Column) -> Column:
    return F.when(a.isNull(), none()).otherwise(of(F.when(a["st"] == A, A).otherwise(2 - a["st"]), a["missing"]))


def minus(a: Column, b: Column) -> Column:
    """a without b: gone if b is unconditional, a itself if b has no entry."""
    return F.when(b.isNull(), a).when(b["st"] == A, none()).otherwise(and_(a, not_(b)))


def any_of(k: Column) -> Column:
    """Aggregate: OR over the rows' entries, null if there is none."""
    st = F.max(k["st"])
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(k["st"] == U, k["missing"])))))
    return F.when(st.isNotNull(), of(st, F.when(st == U, names)))


def all_of(k: Column) -> Column:
    """Aggregate: AND over the rows' entries, null if there is none."""
    st = F.min(k["st"])
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(k["st"] == U, k["missing"])))))
    return F.when(st.isNotNull(), of(st, F.when(st == U, names)))


def all_in(ks: Column) -> Column:
    """AND over an array of entries, null if there is none."""
    ks = F.filter(ks, lambda k: k.isNotNull())
    st = F.array_min(F.transform(ks, lambda k: k["st"]))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(ks, lambda k: k["st"] == U), lambda k: k["missing"]))))
    return F.when(st.isNotNull(), of(st, F.when(st == U, names)))


def verdict(k: Column) -> Column:
    return F.when(k["st"] >= T, "member").when(k["st"] == U, "caveated").otherwise("notMember")
