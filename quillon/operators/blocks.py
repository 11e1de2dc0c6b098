"""Subject sets held in blocks: subjects whom the same objects name are one block, and an object's set is a few
blocks and the single subjects in which it differs from them. Unions, intersections, exclusions and arrows work on
(object, block) pairs, so nothing grows with the subjects until they are listed. Blocks are disjoint, so listing them
needs no deduplication, and counts are sums of sizes.

Only for sets without wildcards and conditions. A block is told by two 64-bit sums (xor) over hashes of its objects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import k3
from .fixpoint import keep

SUBJECT = ["stype", "srel", "sid"]
BLOCK = ["stype", "srel", "b1", "b2"]
#: Subjects of a block that are listed by one row.
CHUNK = 4096
#: Members of up to so many bytes are broadcast to be listed; beyond, the join shuffles.
BROADCAST_BYTES = 48 << 20
#: Subjects that one task lists, about; tasks of the same size let none wait for a slow one.
TASK = 1 << 25


@dataclass
class Blocked:
    #: (rid, BLOCK), distinct; None if the set has only single subjects.
    blocks: DataFrame | None = None
    #: (SUBJECT, b1, b2): every subject's block.
    members: DataFrame | None = None
    #: (rid, SUBJECT, delta): 1 for a subject that is in the set but not by a block, -1 the other way round.
    changes: DataFrame | None = None


def _matched(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal values, nulls among them."""
    b = b.withColumnsRenamed({c: f"r_{c}" for c in on})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"r_{c}")) if c in ("rid", "sid") else F.col(c) == F.col(f"r_{c}") for c in on))
    return a.join(b, same, how).drop(*(f"r_{c}" for c in on))


def grouped(rows: DataFrame) -> Blocked:
    """The blocks of single subjects (rid, SUBJECT)."""
    rows = rows.select("rid", *SUBJECT)
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "rid")).alias(f"b{i}") for i in (1, 2)]
    members = keep(rows.distinct().groupBy(*SUBJECT).agg(*sums))
    one = members.groupBy(*BLOCK).agg(F.min("sid").alias("sid"))  # all of a block have the same objects
    return Blocked(keep(_matched(rows, one, SUBJECT).select("rid", *BLOCK).distinct()), members)


def single(rows: DataFrame) -> Blocked:
    return Blocked(changes=rows.select("rid", *SUBJECT, F.lit(1).alias("delta")))


def through(links: DataFrame, inner: Blocked, every: bool = False) -> Blocked:
    """The blocks of the objects (rid) whose targets have them: links (rid, target), with ``every`` also the target's id."""
    targets = inner.blocks.withColumnRenamed("rid", "target")
    if not every:
        return Blocked(keep(links.join(targets, "target").select("rid", *BLOCK).distinct()), inner.members)
    # dealt out once by object, for the links' deduplication, their number and the blocks' numbers
    links = links.repartition("rid").distinct().withColumn("n", F.count("*").over(Window.partitionBy("rid")))
    rows = links.join(targets, "target").groupBy("rid", "n", *BLOCK).agg(F.count("*").alias("k")).filter("k = n")
    return Blocked(keep(rows.select("rid", *BLOCK)), inner.members)


def combined(leaves: list[Blocked], holds: Callable[[list[Column]], Column]) -> Blocked:
    """The set whose subjects are those for whom ``holds`` is true of their presence in the leaves. A leaf has either
    blocks, of the same members as the others', or single subjects."""
    ids = range(len(leaves))
    cells = [i for i in ids if leaves[i].blocks is not None]
    names = [i for i in ids if leaves[i].blocks is None]

    def flags(of: list[int], by: list[str], frame: Callable[[int], DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, (frame(i).select(*by, F.lit(i).alias("leaf")) for i in of))
        return rows.groupBy(*by).agg(*(F.max(F.col("leaf") == i).alias(f"l{i}") for i in of))

    def value(known: list[int]) -> Column:
        return holds([F.col(f"l{i}") if i in known else F.lit(False) for i in ids])

    out = Blocked(members=leaves[cells[0]].members if cells else None)
    if cells:
        rows = leaves[cells[0]].blocks.withColumn(f"l{cells[0]}", F.lit(True)) if len(cells) == 1 else flags(cells, ["rid", *BLOCK], lambda i: leaves[i].blocks)
        out.blocks = rows.filter(value(cells)).select("rid", *BLOCK)
    if names:
        rows = flags(names, ["rid", *SUBJECT], lambda i: leaves[i].changes)
        if cells:
            rows = _matched(rows, out.members, SUBJECT, "left")
        for i in cells:
            rows = _matched(rows, leaves[i].blocks.withColumn(f"l{i}", F.lit(True)), ["rid", *BLOCK], "left").withColumn(f"l{i}", F.coalesce(f"l{i}", F.lit(False)))
        rows = rows.withColumns({"now": value([*ids]), "was": value(cells)}).filter("now <> was")
        out.changes = rows.select("rid", *SUBJECT, F.when(F.col("now"), 1).otherwise(-1).alias("delta"))
    return out


def listed(s: Blocked) -> DataFrame:
    """(rid, SUBJECT), each once."""
    added = None if s.changes is None else s.changes.filter("delta = 1").select("rid", *SUBJECT)
    if s.blocks is None:
        return added
    if s.changes is not None:  # read twice
        s = Blocked(s.blocks, s.members, keep(s.changes))
        added = s.changes.filter("delta = 1").select("rid", *SUBJECT)
    spark = s.blocks.sparkSession
    users = s.members.groupBy(*BLOCK).agg(F.count("*").alias("users"), F.sum(F.coalesce(F.length("sid"), F.lit(0)) + 24).alias("bytes"))
    sizes = users.select(*BLOCK, F.ceil(F.col("users") / CHUNK).cast("int").alias("chunks"))
    part = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int").alias("chunk")
    lists = s.members.join(sizes, BLOCK).select(*BLOCK, part, "sid").groupBy(*BLOCK, "chunk").agg(F.collect_list(F.struct("sid")).alias("sids"))
    pairs = s.blocks.join(sizes, BLOCK)
    wanted = pairs.select("rid", *BLOCK, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    gone = F.lit(None)
    if s.changes is not None:
        less = _matched(s.changes.filter("delta = -1"), s.members, SUBJECT).join(sizes, BLOCK)
        less = less.groupBy("rid", *BLOCK, part).agg(F.collect_list(F.struct("sid")).alias("gone"))
        wanted, gone = _matched(wanted, less, ["rid", *BLOCK, "chunk"], "left"), F.col("gone")
    named = users.join(s.blocks.groupBy(*BLOCK).agg(F.count("*").alias("k")), BLOCK, "left")
    n, size = named.agg(F.sum(F.col("users") * F.coalesce("k", F.lit(0))), F.sum("bytes")).first()
    if (size or 0) <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
        wanted = wanted.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // TASK)), "rid", "chunk")  # few pairs may list many
    rows = wanted.join(lists, [*BLOCK, "chunk"])
    left = F.coalesce(F.array_except("sids", gone), "sids") if s.changes is not None else F.col("sids")
    rows = rows.select("rid", "stype", "srel", F.inline(left))
    return rows if added is None else rows.unionByName(added)


def leading(s: Blocked, k: int) -> DataFrame:
    """Of the listed (rid, SUBJECT), at least the k first of each object, type and relation by id."""
    if s.blocks is None:
        return listed(s)
    first = Window.partitionBy(*BLOCK).orderBy("sid")
    heads = s.members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select(*BLOCK, "sid")
    if s.changes is None:
        return s.blocks.join(heads, BLOCK).select("rid", *SUBJECT)
    cut = _matched(s.changes.filter("delta = -1"), s.members, SUBJECT).select("rid", *BLOCK).distinct()
    whole = _matched(s.blocks, cut, ["rid", *BLOCK], "left_anti").join(heads, BLOCK).select("rid", *SUBJECT)
    return whole.unionByName(listed(Blocked(_matched(s.blocks, cut, ["rid", *BLOCK], "left_semi"), s.members, s.changes)))


def totals(s: Blocked, first: bool = False) -> DataFrame:
    """(rid, users): how many subjects an object has; with ``first``, also the smallest id."""
    parts, whole = [], s.changes is None
    if s.blocks is not None:
        sizes = s.members.groupBy(*BLOCK).agg(F.count("*").alias("users"), F.min("sid").alias("first"))
        parts.append(s.blocks.join(sizes, BLOCK).select("rid", "users", "first"))
    if not whole:
        parts.append(s.changes.select("rid", F.col("delta").cast("long").alias("users"), F.lit(None).cast("string").alias("first")))
    out = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(F.sum("users").alias("users"), F.min("first").alias("first")).filter("users > 0")
    if whole or not first:
        return out if first else out.drop("first")
    return _matched(out.drop("first"), leading(s, 1).groupBy("rid").agg(F.min("sid").alias("first")), ["rid"], "left")


def entries(rows: DataFrame) -> DataFrame:
    """As rows of a subject set."""
    return rows.select("rid", *SUBJECT, k3.always().alias("c"), k3.none().alias("e"))
