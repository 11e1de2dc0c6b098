"""Subject sets of many objects at once, with public wildcards and conditions.

A set is a DataFrame (rid, stype, srel, sid, c, e): c is the entry of a listed subject, or of everybody where sid
is ``*``; e, in rows of single subjects, excludes them from everybody. Sets that are known to hold no wildcard
(``wild`` is false) go through plain unions and joins; only the others need the exclusion columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import k3
from ..model import ELLIPSIS, WILDCARD
from .fixpoint import keep

KEYS = ["rid", "stype", "srel", "sid"]
GROUP = ["rid", "stype", "srel"]
SCHEMA = f"rid string, stype string, srel string, sid string, c {k3.TYPE}, e {k3.TYPE}"


@dataclass
class SubjectSet:
    rows: DataFrame
    #: May hold wildcards.
    wild: bool = False
    #: May hold conditions.
    conditional: bool = False
    #: Is empty by the schema alone.
    empty: bool = False

    def keyed(self, over: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows of single subjects, and of everybody."""
        single = self.rows.filter(F.col("sid") != WILDCARD)
        return single, self.rows.filter(F.col("sid") == WILDCARD)


def nobody(spark) -> SubjectSet:
    return SubjectSet(spark.createDataFrame([], SCHEMA), empty=True)


def _plain(rows: DataFrame) -> DataFrame:
    """Rows of one entry a subject, without exclusions."""
    return rows.groupBy(*KEYS).agg(k3.any_of(F.col("c")).alias("c")).withColumn("e", k3.none())


def union(sets: list[SubjectSet], spark, branch: str | None = None) -> SubjectSet:
    """Everyone of any set. With ``branch``, that column tells apart the sets that one frame holds."""
    sets = [s for s in sets if not s.empty]
    if not sets:
        return nobody(spark)
    if len(sets) == 1 and branch is None:
        return sets[0]
    wild, cond = any(s.wild for s in sets), any(s.conditional for s in sets)
    if branch is None:
        rows = reduce(DataFrame.unionByName, (s.rows.select(*KEYS, "c", "e", F.lit(i).cast("string").alias("branch")) for i, s in enumerate(sets)))
    else:
        rows = sets[0].rows.select(*KEYS, "c", "e", F.col(branch).alias("branch"))
    if not wild:
        if not cond:
            return SubjectSet(rows.select(*KEYS).distinct().withColumns({"c": k3.always(), "e": k3.none()}))
        return SubjectSet(_plain(rows), conditional=cond)
    rows = keep(rows)  # read twice; without it plans double with every level
    everybody = rows.filter(F.col("sid") == WILDCARD).groupBy(*GROUP).agg(k3.any_of(F.col("c")).alias("c"), F.count_distinct("branch").alias("n"))
    single = rows.filter(F.col("sid") != WILDCARD)
    single = single.groupBy(*KEYS).agg(k3.any_of(F.col("c")).alias("c"), k3.all_of(F.col("e")).alias("e"), F.count_distinct(F.when(F.col("e").isNotNull(), F.col("branch"))).alias("k"))
    single = single.join(everybody.select(*GROUP, "n"), GROUP, "left")
    # an exclusion stays if every wildcard has it, and a listed subject weakens it
    e = F.when(F.col("k") == F.col("n"), k3.minus(F.col("e"), F.col("c")))
    single = single.withColumn("e", e).filter(F.col("c").isNotNull() | F.col("e").isNotNull())
    out = single.select(*KEYS, "c", "e").unionByName(everybody.select(*GROUP, F.lit(WILDCARD).alias("sid"), "c").withColumn("e", k3.none()))
    return SubjectSet(out, wild, cond)


def _pair(a: SubjectSet, b: SubjectSet, how: str) -> tuple[DataFrame, DataFrame]:
    """(single subjects, everybody) of two sets side by side: ca, ea, cb, eb, and wa, wb of everybody."""
    side = lambda s, x: s.select(*KEYS, F.col("c").alias(f"c{x}"), F.col("e").alias(f"e{x}"))
    sa, wa = SubjectSet(keep(a.rows)).keyed()
    sb, wb = SubjectSet(keep(b.rows)).keyed()
    wa, wb = (w.select(*GROUP, F.col("c").alias(f"w{x}")) for w, x in ((wa, "a"), (wb, "b")))
    single = side(sa, "a").join(side(sb, "b"), KEYS, "full")
    single = single.join(wa, GROUP, "left").join(wb, GROUP, "left")
    return single, wa.join(wb, GROUP, how)


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _apart(w: Column, e: Column) -> Column:
    """What everybody's entry gives a subject that e excludes."""
    return k3.minus(w, e)


def intersect(a: SubjectSet, b: SubjectSet, spark) -> SubjectSet:
    """Everyone of both sets."""
    if a.empty or b.empty:
        return nobody(spark)
    cond = a.conditional or b.conditional
    if not (a.wild or b.wild):
        rows = a.rows.select(*KEYS, F.col("c").alias("ca")).join(b.rows.select(*KEYS, F.col("c").alias("cb")), KEYS)
        return SubjectSet(rows.select(*KEYS, (k3.and_(*_c("ca", "cb")) if cond else k3.always()).alias("c"), k3.none().alias("e")), conditional=cond)
    if not (a.wild and b.wild):  # only whom the one set lists can be in both
        listing, other = (b, a) if a.wild else (a, b)
        named, everybody = SubjectSet(keep(other.rows)).keyed()
        rows = listing.rows.select(*KEYS, F.col("c").alias("ca"))
        rows = rows.join(named.select(*KEYS, F.col("c").alias("cb"), F.col("e").alias("eb")), KEYS, "left")
        rows = rows.join(everybody.select(*GROUP, F.col("c").alias("wb")), GROUP, "left")
        ca, cb, eb, wb, x, y = _c("ca", "cb", "eb", "wb", "x", "y")
        rows = rows.withColumns({"x": k3.and_(ca, cb), "y": _apart(wb, eb)}).withColumn("y", k3.and_(ca, y))
        return SubjectSet(rows.select(*KEYS, k3.or_(x, y).alias("c"), k3.none().alias("e")).filter("c is not null"), conditional=cond)
    single, both = _pair(a, b, "inner")
    ca, ea, cb, eb, wa, wb = _c("ca", "ea", "cb", "eb", "wa", "wb")
    x, y, z = _c("x", "y", "z")
    e = F.when(wa.isNotNull() & wb.isNotNull(), k3.or_(ea, eb))
    # step by step, since each operation names its operands several times
    single = single.withColumns({"x": k3.and_(ca, cb), "y": _apart(wb, eb), "z": _apart(wa, ea), "e": e})
    single = single.withColumns({"y": k3.and_(ca, y), "z": k3.and_(cb, z)}).withColumn("x", k3.or_(x, y))
    single = single.select(*KEYS, k3.or_(x, z).alias("c"), "e").filter("c is not null or e is not null")
    everybody = both.select(*GROUP, F.lit(WILDCARD).alias("sid"), k3.and_(wa, wb).alias("c"), k3.none().alias("e"))
    return SubjectSet(single.unionByName(everybody), a.wild and b.wild, cond)


def exclude(a: SubjectSet, b: SubjectSet) -> SubjectSet:
    """Everyone of a who is not in b. Listed subjects are taken away first, then everybody."""
    if a.empty or b.empty:
        return a
    cond = a.conditional or b.conditional
    if not (a.wild or b.wild):
        if not b.conditional:
            return SubjectSet(a.rows.join(b.rows.select(*KEYS), KEYS, "left_anti"), conditional=cond)
        rows = a.rows.join(b.rows.select(*KEYS, F.col("c").alias("cb")), KEYS, "left")
        return SubjectSet(rows.select(*KEYS, k3.minus(*_c("c", "cb")).alias("c"), "e").filter("c is not null"), conditional=cond)
    if not b.wild:  # everybody stays, and whom b lists is excluded
        named, everybody = SubjectSet(keep(a.rows)).keyed()
        rows = named.select(*KEYS, F.col("c").alias("ca"), F.col("e").alias("ea")).join(b.rows.select(*KEYS, F.col("c").alias("cb")), KEYS, "full")
        rows = rows.join(everybody.select(*GROUP, F.lit(True).alias("has")), GROUP, "left")
        ca, ea, cb = _c("ca", "ea", "cb")
        rows = rows.select(*KEYS, k3.minus(ca, cb).alias("c"), F.when(F.col("has"), k3.or_(ea, cb)).alias("e"))
        return SubjectSet(rows.filter("c is not null or e is not null").unionByName(everybody), True, cond)
    single, both = _pair(a, b, "left")
    ca, ea, cb, eb, wa, wb = _c("ca", "ea", "cb", "eb", "wa", "wb")
    left, open_, x, kept = _c("left", "open", "x", "kept")
    single = single.withColumns({"left": k3.minus(ca, cb), "open": k3.or_keep(k3.not_(wb), eb), "x": k3.and_(wa, eb), "e": F.when(wa.isNotNull(), k3.or_(ea, cb))})
    single = single.withColumn("x", _apart(x, ea))
    # everybody's removal spares those whom b's wildcard excludes for certain, and conditionally those it may exclude
    spared = F.when(wb.isNull() | (eb["st"] == k3.A), left).when(eb.isNull(), k3.minus(left, wb)).otherwise(k3.and_(left, open_))
    # whom b's wildcard excludes but a's covers, stays as a listed subject, less what b lists
    single = single.withColumns({"left": spared, "kept": F.when(wb.isNotNull() & eb.isNotNull(), k3.minus(x, cb))})
    single = single.select(*KEYS, k3.or_(left, kept).alias("c"), "e")
    everybody = both.select(*GROUP, F.lit(WILDCARD).alias("sid"), k3.minus(wa, wb).alias("c"), k3.none().alias("e")).filter("c is not null")
    gone = everybody.select(*GROUP, F.lit(True).alias("has"))
    single = single.join(gone, GROUP, "left").withColumn("e", F.when(F.col("has"), F.col("e"))).drop("has")
    return SubjectSet(single.filter("c is not null or e is not null").unionByName(everybody), a.wild, cond)


def every(targets: DataFrame, s: SubjectSet, spark) -> SubjectSet:
    """Everyone whom all targets of an object grant. targets: (rid, target) pairs; s: rows with a column target."""
    if s.empty:
        return nobody(spark)
    n = targets.distinct().groupBy("rid").agg(F.count("*").alias("n"))
    rows = s.rows
    if not s.wild:
        got = rows.groupBy(*KEYS).agg(k3.all_of(F.col("c")).alias("c"), F.count_distinct("target").alias("k"))
        got = got.join(n, "rid").filter("k = n")
        return SubjectSet(got.select(*KEYS, "c", k3.none().alias("e")), conditional=s.conditional)
    everybody = rows.filter(F.col("sid") == WILDCARD).select(*GROUP, "target", F.col("c").alias("w"))
    single = rows.filter(F.col("sid") != WILDCARD)
    # targets that don't name a subject give it everybody's entries: all of those, less the ones of targets that do
    grid = single.join(everybody, [*GROUP, "target"], "left").withColumn("v", k3.or_(F.col("c"), _apart(F.col("w"), F.col("e"))))
    grid = grid.repartition(*KEYS).groupBy(*KEYS, "w").agg(k3.all_of(F.col("v")).alias("v"), F.count("v").alias("k"), F.count("c").alias("listed"), k3.any_of(F.col("e")).alias("e"), F.count("*").alias("m"))
    taken = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "m"))).alias("taken")
    grid = grid.groupBy(*KEYS).agg(k3.all_of(F.col("v")).alias("v"), F.sum("k").alias("k"), F.sum("listed").alias("listed"), k3.any_of(F.col("e")).alias("e"), taken)
    open_ = everybody.groupBy(*GROUP, "w").agg(F.count("*").alias("m")).groupBy(*GROUP).agg(F.collect_list(F.struct("w", "m")).alias("open"))
    fewer = lambda x: F.aggregate(F.filter("taken", lambda y: y["w"] == x["w"]), x["m"], lambda m, y: m - y["m"])
    rest = F.filter(F.transform("open", lambda x: F.struct(x["w"].alias("w"), fewer(x).alias("m"))), lambda x: x["m"] > 0)
    grid = grid.join(open_, GROUP, "left").withColumn("rest", F.coalesce(rest, F.array().cast(f"array<struct<w:{k3.TYPE},m:bigint>>")))
    grid = grid.withColumns({"k": F.aggregate("rest", F.col("k"), lambda k, x: k + x["m"]), "v": k3.all_in(F.array_append(F.transform("rest", lambda x: x["w"]), F.col("v")))})
    both = everybody.groupBy(*GROUP).agg(k3.all_of(F.col("w")).alias("w"), F.count("*").alias("k")).join(n, "rid").filter("k = n")
    grid = grid.join(n, "rid").join(both.select(*GROUP, F.lit(True).alias("has")), GROUP, "left")
    c = F.when((F.col("k") == F.col("n")) & (F.col("listed") > 0), F.col("v"))
    single = grid.select(*KEYS, c.alias("c"), F.when(F.col("has"), F.col("e")).alias("e")).filter("c is not null or e is not null")
    return SubjectSet(single.unionByName(both.select(*GROUP, F.lit(WILDCARD).alias("sid"), F.col("w").alias("c"), k3.none().alias("e"))), True, s.conditional)


def listed(s: SubjectSet) -> DataFrame:
    """Found subjects: (rid, stype, srel, sid, st, missing, excluded); of everybody, whom it leaves out."""
    single, everybody = (SubjectSet(keep(s.rows)) if s.wild else s).keyed()
    row = [*KEYS, F.col("c.st").alias("st"), F.col("c.missing").alias("missing")]
    found = single.filter(F.col("c.st") > k3.FALSE).select(*row, F.array().cast("array<string>").alias("excluded"))
    if not s.wild:
        return found
    out = single.filter(F.col("e.st") > k3.FALSE).groupBy(*GROUP).agg(F.array_sort(F.collect_list("sid")).alias("excluded"))
    everybody = everybody.filter(F.col("c.st") > k3.FALSE).select(*row).join(out, GROUP, "left")
    return found.unionByName(everybody.select(*found.columns[:-1], F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded")))


def granted(s: SubjectSet, asked: DataFrame) -> DataFrame:
    """asked (rid, stype, srel, sid, ...) with its entry k; a wildcard covers its type whatever the relation."""
    single = s.rows if not s.wild else s.rows.filter(F.col("sid") != WILDCARD)
    single = single.select(*KEYS, F.col("c").alias("k_c"), F.col("e").alias("k_e"))
    out = asked.join(single, KEYS, "left")
    if not s.wild:
        return out.withColumnRenamed("k_c", "k").drop("k_e")
    everybody = s.rows.filter(F.col("sid") == WILDCARD).groupBy("rid", "stype").agg(k3.any_of(F.col("c")).alias("k_w"))
    out = out.join(everybody, ["rid", "stype"], "left")
    return out.withColumn("k_w", _apart(F.col("k_w"), F.col("k_e"))).withColumn("k", k3.or_(F.col("k_c"), F.col("k_w"))).drop("k_c", "k_e", "k_w")


def identity(objects: DataFrame, type_: str) -> SubjectSet:
    """Each object (rid) as its own subject."""
    return SubjectSet(objects.select("rid", F.lit(type_).alias("stype"), F.lit(ELLIPSIS).alias("srel"), F.col("rid").alias("sid"), k3.always().alias("c"), k3.none().alias("e")))
