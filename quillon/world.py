"""A relationship world made of the sample tables: orders, customers, suppliers, nations, regions, groups, and items
that events touch and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import ELLIPSIS, WILDCARD

SCHEMA = """
use expiration
use self

definition user {}

caveat min_total(min double, total double) { total >= min }

definition group { relation member: user | group#member }

definition nation { relation member: user }

definition region { relation member: nation#member }

definition supplier {
  relation nation: nation
  permission rep = nation->member
}

definition order {
  relation owner: user
  relation supplier: supplier
  relation banned: user
  relation viewer: user | user:*
  relation payer: user with min_total
  relation temp: user with expiration
  relation team: group#member

  permission held = owner
  permission rep = supplier->rep
  permission all_reps = supplier.all(rep)
  permission view = (owner + supplier->rep) - banned
  permission any = owner + banned
  permission both = owner & supplier->rep
  permission own = owner - banned
  permission open = viewer - banned
  permission open_owned = viewer & owner
  permission pay = payer - banned
  permission paid = payer & owner
  permission nobody = nil
  permission me = self
  permission seen = owner + temp
  permission read = owner + team
}

definition item { relation viewer: user }
"""
#: 1999-01-01 in nanoseconds: the time by which expirations are judged.
NOW = 915_148_800 * 10**9
YEAR = 365 * 86_400 * 10**9


def _rows(df: DataFrame, rt: str, rid: Column, rel: str, st: str, sid: Column, srel: str = ELLIPSIS, caveat: str | None = None, ctx: Column | None = None, exp: Column | None = None) -> DataFrame:
    lit = F.lit
    return df.select(
        lit(rt).alias("resource_type"), rid.cast("string").alias("resource_id"), lit(rel).alias("resource_rel"), lit(st).alias("subject_type"), sid.cast("string").alias("subject_id"), lit(srel).alias("subject_rel"),
        lit(caveat).cast("string").alias("caveat_name"), (lit(None) if ctx is None else ctx).cast("string").alias("caveat_ctx"), (lit(None) if exp is None else exp).cast("long").alias("expiration_ns"),
    )


def family(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relationships of one kind."""
    c, table = F.col, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "owner":
        return _rows(table("orders"), "order", c("o_orderkey"), "owner", "user", c("o_custkey"))
    if name == "supplier":
        return _rows(table("lineitem").select("l_orderkey", "l_suppkey").distinct(), "order", c("l_orderkey"), "supplier", "supplier", c("l_suppkey"))
    if name == "nation":
        return _rows(table("supplier"), "supplier", c("s_suppkey"), "nation", "nation", c("s_nationkey"))
    if name == "citizen":
        return _rows(table("customer"), "nation", c("c_nationkey"), "member", "user", c("c_custkey"))
    if name == "region":
        return _rows(table("nation"), "region", c("n_regionkey"), "member", "nation", c("n_nationkey"), "member")
    if name == "group":
        users = table("customer").select("c_custkey")
        own = _rows(users, "group", c("c_custkey") + 1, "member", "user", c("c_custkey"))
        g = c("c_custkey") + 1
        return own.unionByName(_rows(users.filter(g >= 2), "group", F.floor(g / 2), "member", "group", g, "member"))
    if name == "team":
        return _rows(table("orders"), "order", c("o_orderkey"), "team", "group", c("o_custkey") + 1, "member")
    if name == "banned":
        poor = table("customer").filter("c_acctbal < 0").select("c_custkey")
        return _rows(table("orders").join(poor, c("o_custkey") == c("c_custkey")), "order", c("o_orderkey"), "banned", "user", c("o_custkey"))
    if name == "public":
        return _rows(table("orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), "order", c("o_orderkey"), "viewer", "user", F.lit(WILDCARD))
    if name == "payer":
        ctx = F.concat(F.lit('{"min":'), F.floor("o_totalprice").cast("string"), F.lit("}"))
        return _rows(table("orders"), "order", c("o_orderkey"), "payer", "user", c("o_custkey"), caveat="min_total", ctx=ctx)
    if name == "temp":
        end = F.unix_micros(c("o_orderdate").cast("timestamp")) * 1000 + YEAR
        return _rows(table("orders"), "order", c("o_orderkey"), "temp", "user", c("o_custkey"), exp=end)
    raise KeyError(name)


FAMILIES = ("owner", "supplier", "nation", "citizen", "region", "group", "team", "banned", "public", "payer", "temp")


def relationships(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The relationships of the named kinds, or of all."""
    parts = [family(spark, sf_dir, n) for n in names or FAMILIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change log of items: an error deletes, all else touches; the kind of event is the payload."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("rev"), F.when(F.col("event_type") == "error", "delete").otherwise("touch").alias("op"),
        F.lit("item").alias("resource_type"), F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(10)).cast("string").alias("resource_id"), F.lit("viewer").alias("resource_rel"),
        F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), F.lit(ELLIPSIS).alias("subject_rel"),
        F.lit(None).cast("string").alias("caveat_name"), F.col("event_type").alias("caveat_ctx"), F.lit(None).cast("long").alias("expiration_ns"),
    )
