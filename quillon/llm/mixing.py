"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document of ``size`` words gets a rate w between 0 and LIMIT, as close to 1 as its source's token constraint
allows: the rates minimise sum(w log w - w + 1) subject to sum(size * w) = target for each source. The solution of
the convex dual is an exponential tilt, w = min(LIMIT, exp(lambda * size / mean size)), with one lambda a source
and no closed form. Newton's method finds it, on the logarithm of the constraint, inside a bracket that halves
wherever a step would leave it. Documents of one source and size are one cell, so an iteration reads cells, not
documents, and its gradient and Hessian are sums over cells.

Rates become copies: everyone takes floor(w). Of a source's cells, in descending size, each gives one copy more to
as many documents as keep the running sum of remainders rounded, which misses the target by at most half the source's
largest document; the source's smallest documents then round the other way until about half a small document is
missing. Within a cell the documents with the least md5 of id and text take the copy more. The last one's digest is found for each cell, and every row is then decided on its own.

Defined cases: null, empty and blank texts have size 0 and take 0 words; a null source is a source of its
own, last in order; a source without words has target 0; of rows with equal id and text as many take one copy more
as are due, any of them; no document takes more than LIMIT times its size. Extra columns are kept by ``mixed`` and
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import cut

WEIGHTS, LIMIT = (1, 2, 3), 3
#: Cells of more documents than RANGE are ordered in 4,096 ranges of their digest.
RANGE, DIGITS = 4096, 3
#: Cells that may be broadcast to the documents (about 100 bytes each); beyond, a shuffled join takes its place.
BROADCAST_CELLS = 100_000
#: Newton stops at this relative error of every constraint, before its last step; so many iterations always do.
TOLERANCE, ITERATIONS = 1e-9, 200
#: Rates are multiples of 1 / UNIT.
UNIT = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Weights go to sources by code point, null last. Where 3 * size < weight * level for the common level, the
    source stops there; the level is found among sources in the order of 3 * size / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("w", cycle.cast("long"))
    ratio = F.col("source_size") * LIMIT / F.col("w")
    up = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * LIMIT).over(up), F.lit(0)))
    level = (F.sum("source_size").over(everything) - F.col("stopped")) / F.sum("w").over(down)
    rows = rows.withColumn("level", level).withColumn("ratio", ratio)
    # the first source, by ratio, that the level of its suffix doesn't push above its stop
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))
    rows = rows.withColumn("at", F.min(fits).over(everything))
    target = F.least(F.col("source_size") * F.lit(float(LIMIT)), F.col("at.level") * F.col("w"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def rate(lam: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(LIMIT)), F.exp(F.least(F.lit(2.0), lam * size / mean)))


def balance(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """(s, mean, lam): the dual's solution for cells (source, size, n) and goals (source, source_size, target > 0).

    Sources that stop at LIMIT times their size have lam null. Each iteration is one aggregation over the cells; only
    the largest relative error reaches the driver.
    """
    some = cells.filter("size > 0").groupBy(F.col("source").alias("s")).agg(F.min("size").alias("low"), F.sum("n").alias("docs"))
    state = goal.filter("target > 0").join(some, F.col("source").eqNullSafe(F.col("s")))
    mean, share = F.col("source_size") / F.col("docs"), F.col("target") / F.col("source_size")
    free = F.col("target") < LIMIT * F.col("source_size")
    # at the ends all rates are at most the target's share of the source, or at least LIMIT
    lo = F.when(share < 1, mean * F.log(share) / F.col("low")).otherwise(0.0)
    hi = F.when(share > 1, mean * F.log(F.lit(float(LIMIT))) / F.col("low")).otherwise(0.0)
    state = cut(state.select("s", "target", mean.alias("mean"), F.when(free, 0.0).alias("lam"), lo.alias("lo"), hi.alias("hi")))
    done = state.filter("lam is null").select("s", "mean", "lam")
    state = state.filter("lam is not null")
    for _ in range(ITERATIONS):
        at = cells.filter("size > 0").join(F.broadcast(state), F.col("source").eqNullSafe(F.col("s")))
        w = rate(F.col("lam"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * w
        slope = F.when(w < LIMIT, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = at.groupBy("s", "target", "mean", "lam", "lo", "hi").agg(F.sum(words).alias("have"), F.sum(slope).alias("slope"))
        low = F.when(F.col("have") <= F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("have") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        err = F.abs(F.col("have") - F.col("target")) / F.col("target")
        sums = sums.withColumns({"low": low, "high": high, "err": err})
        step = F.col("lam") - F.log(F.col("have") / F.col("target")) * F.col("have") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (step >= F.col("low")) & (step <= F.col("high"))
        lam = F.when(F.col("err") < 1e-14, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = cut(sums.select("s", "target", "mean", lam.alias("lam"), F.col("low").alias("lo"), F.col("high").alias("hi"), "err"))
        worst = state.agg(F.max("err")).first()[0]
        state = state.drop("err")
        if worst is None or worst < TOLERANCE:
            return done.unionByName(state.select("s", "mean", "lam"))
    raise RuntimeError(f"entropy balancing: relative error {worst} after {ITERATIONS} iterations")


def measured(docs: DataFrame, source: str, *more: Column) -> DataFrame:
    """(source, size, digest) and more for each row of ``docs``."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    return docs.select(F.col(source).alias("source"), words_of(F.col("text")).alias("size"), digest.alias("digest"), *more)


def _on(rows: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with (source, size) and what cells with (s, z) have."""
    return rows.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), how).drop("s", "z")


def few(cells: DataFrame) -> DataFrame:
    """Cells, to be broadcast if there are few."""
    return F.broadcast(cells) if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else cells


def limits(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(s, z, last, due, ties) for cells (source, size, n, k) that give some of their documents a copy more: the k-th
    digest, how many documents have it, and how many of these are due."""
    some = cells.filter("k > 0 and k < n").select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "k")
    range_ = F.when(F.col("n") > RANGE, F.substring("digest", 1, DIGITS)).otherwise("")
    each = _on(rows.select("source", "size", "digest"), few(some)).groupBy("source", "size", "digest", "n", "k").agg(F.count("*").alias("ties"))
    each = cut(each.withColumn("range", range_))
    before = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.groupBy("source", "size", "range", "k").agg(F.sum("ties").alias("all"))
    ranges = ranges.withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).filter("base < k and k <= base + all")
    ranges = ranges.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("range").alias("r"), "base")
    inside = _on(each, ranges).filter("range = r")
    upto = Window.partitionBy("source", "size").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("base") + F.sum("ties").over(upto)).filter("upto - ties < k and k <= upto")
    return cut(inside.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("digest").alias("last"), (F.col("k") - F.col("upto") + F.col("ties")).alias("due"), "ties"))


def planned(rows: DataFrame) -> DataFrame:
    """(s, z, source_size, target, whole, n, k, last, due, ties) of each source and size."""
    cells = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = cut(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    rates = goal.join(balance(cells, goal), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s")
    cells = cells.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = F.round(F.coalesce(rate(F.col("lam"), F.col("size"), F.col("mean")), F.lit(float(LIMIT))) * UNIT).cast("long")
    cells = cells.withColumn("units", F.when(F.col("size") > 0, units).otherwise(0))
    own = F.col("n") * (F.col("units") % UNIT)
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("own", own).withColumn("run", F.sum("own").over(down))
    cells = cells.withColumn("k", F.expr(f"(run + {UNIT // 2}) div {UNIT} - (run - own + {UNIT // 2}) div {UNIT}"))
    cells = cells.withColumn("whole", F.expr(f"units div {UNIT}"))
    off = F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("k"))).over(Window.partitionBy("source")) - F.col("target")
    cells = cells.withColumn("off", off).withColumn("room", F.when(F.col("own") == 0, 0).when(F.col("off") > 0, F.col("k")).otherwise(F.col("n") - F.col("k")))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.abs("off") - F.coalesce(F.sum(F.col("size") * F.col("room")).over(smaller), F.lit(0))
    turned = F.least(F.col("room"), F.greatest(F.lit(0), F.floor(left / F.col("size") + 0.5))).cast("long")
    cells = cells.withColumn("k", F.when(F.col("own") == 0, F.col("k")).when(F.col("off") > 0, F.col("k") - turned).otherwise(F.col("k") + turned))
    cells = cut(cells.select("source", "size", "source_size", "target", "whole", "n", "k"))
    return cut(_on(cells, limits(rows, cells), "left").withColumnsRenamed({"source": "s", "size": "z"}))


def decided(rows: DataFrame) -> DataFrame:
    """Rows on their cells with ``copies``: null where only some of a cell's equal rows are due one more."""
    extra = F.when(F.col("k") == 0, 0).when(F.col("k") == F.col("n"), 1).when(F.col("digest") < F.col("last"), 1).when(F.col("digest") > F.col("last"), 0).when(F.col("due") == F.col("ties"), 1)
    return rows.withColumn("copies", (F.col("whole") + extra).cast("int"))


def dealt(equal: DataFrame) -> DataFrame:
    """``copies`` for kept rows of which, in each cell, ``due`` get one more: counted partition by partition."""
    rows = cut(equal.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    before = Window.partitionBy("s", "z").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p")).agg(F.count("*").alias("m"))
    parts = parts.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = Window.partitionBy("source", "size", "part").orderBy("at")
    rows = _on(rows, parts).filter("part = p").withColumn("place", F.col("base") + F.row_number().over(inside))
    return rows.withColumn("copies", (F.col("whole") + (F.col("place") <= F.col("due")).cast("int")).cast("int")).drop("part", "at", "p", "base", "place")


def mix(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs``."""
    common.prepare(docs.sparkSession)
    rows = cut(measured(docs, source, F.col("doc_id")))
    rows = decided(_on(rows, few(planned(rows))))
    rows = rows.filter("copies is not null").unionByName(dealt(rows.filter("copies is null")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their columns; a document it leaves out is gone.

    Rows carry their columns along and are decided one by one as in ``mix``, whatever their ids.
    """
    common.prepare(docs.sparkSession)
    rows = measured(docs, "source", F.struct("*").alias("row"))
    rows = decided(_on(rows, few(planned(cut(rows.drop("row"))))))
    rows = rows.filter("copies > 0").unionByName(dealt(rows.filter("copies is null")).filter("copies > 0"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(common.documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


#: The same rates by bisection instead of Newton's method, cell by cell.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
c AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
s AS (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, sum(n) FILTER (size > 0) AS docs, min(size) FILTER (size > 0) AS low FROM c GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s),
r AS (SELECT *, CAST(source_size * 3 AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
lv AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS MATERIALIZED (SELECT source, source_size, docs, low, least(CAST(source_size * 3 AS DOUBLE), (SELECT level FROM lv) * w) AS target FROM l),
b AS (
  SELECT source, target, source_size / docs AS mean, CASE WHEN target < source_size THEN source_size / docs * ln(target / source_size) / low ELSE 0.0 END AS lo,
    CASE WHEN target > source_size THEN source_size / docs * ln(3.0) / low ELSE 0.0 END AS hi, 0 AS i FROM t WHERE target > 0 AND target < 3 * source_size
  UNION ALL
  SELECT source, target, mean, CASE WHEN have > target THEN lo ELSE mid END, CASE WHEN have > target THEN mid ELSE hi END, i + 1 FROM (
    SELECT b.source, b.target, b.mean, b.lo, b.hi, b.i, (b.lo + b.hi) / 2 AS mid, sum(c.n * c.size * least(3.0, exp(least(2.0, (b.lo + b.hi) / 2 * c.size / b.mean)))) AS have
    FROM b JOIN c ON c.source IS NOT DISTINCT FROM b.source AND c.size > 0 WHERE b.i < 100 GROUP BY ALL)
),
u AS (SELECT c.source, c.size, c.n, t.source_size, t.target, CASE WHEN c.size = 0 THEN 0
    ELSE CAST(round(coalesce(least(3.0, exp(least(2.0, (b.lo + b.hi) / 2 * c.size / b.mean))), 3.0) * 1000000) AS BIGINT) END AS units
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source LEFT JOIN (SELECT * FROM b WHERE i = 100) b ON c.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, n * (units % 1000000) AS own, CAST(sum(n * (units % 1000000)) OVER (PARTITION BY source ORDER BY size DESC) AS BIGINT) AS run FROM u),
j AS (SELECT *, (run + 500000) // 1000000 - (run - own + 500000) // 1000000 AS rounded FROM k),
e AS (SELECT *, CAST(sum(size * (n * (units // 1000000) + rounded)) OVER (PARTITION BY source) AS BIGINT) - target AS off FROM j),
f AS (SELECT *, CASE WHEN own = 0 THEN 0 WHEN off > 0 THEN rounded ELSE n - rounded END AS room FROM e),
g AS (SELECT *, abs(off) - CAST(coalesce(sum(size * room) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM f),
p AS (SELECT *, rounded - CASE WHEN own = 0 THEN 0 ELSE CASE WHEN off > 0 THEN 1 ELSE -1 END * CAST(least(room, greatest(0, floor(rest / size + 0.5))) AS BIGINT) END AS more FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY h) AS place FROM d)
SELECT o.doc_id, o.size, p.source_size, p.target, CAST(o.size * (p.units // 1000000 + CASE WHEN o.place <= p.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source AND o.size = p.size
"""
