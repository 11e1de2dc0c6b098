"""Reachability over edges, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MAX_DEPTH, DepthError


def shared_folder(spark: SparkSession) -> str:
    """The cluster names the shared folder in spark.checkpoint.dir; only without it a local one is made."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Run once and read the rows back from a table in the shared folder, so that plans stay short and a lost
    executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, seeds: DataFrame, rounds: int = MAX_DEPTH) -> DataFrame:
    """(start, node, depth): what each seed (start, node) reaches over edges (src, dst), with the least number of
    steps. Semi-naive: a round joins only what the one before has found, so cycles end by themselves; more than
    ``rounds`` rounds raise DepthError."""
    edges = edges.select("src", "dst").distinct()
    known = keep(seeds.select("start", "node", F.lit(0).alias("depth")).distinct())
    delta = known
    for depth in range(1, rounds + 2):
        step = delta.join(edges, delta["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        delta = keep(step.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if delta.isEmpty():
            return known
        if depth > rounds:
            break
        known = known.unionByName(delta)
    raise DepthError(f"more than {rounds} steps")


def closure_sql(spark: SparkSession, edges: DataFrame, seeds: DataFrame, rounds: int = MAX_DEPTH) -> DataFrame:
    """(start, node): the same in one recursive query, for acyclic and shallow data. It repeats paths; one of more
    than ``rounds`` steps, as any cycle has, raises when the rows are read. LIMIT ALL lifts Spark's bound of a million
    rows."""
    edges.createOrReplaceTempView("quillon_edges")
    seeds.createOrReplaceTempView("quillon_seeds")
    return spark.sql(
        f"""WITH RECURSIVE r(start, node, depth) AS (
          SELECT start, node, 0 FROM quillon_seeds
          UNION ALL SELECT r.start, e.dst, r.depth + 1 FROM r JOIN quillon_edges e ON r.node = e.src WHERE r.depth <= {rounds})
        SELECT DISTINCT start, node FROM (SELECT * FROM r LIMIT ALL) r WHERE CASE WHEN depth > {rounds} THEN CAST(raise_error('more than {rounds} steps') AS BOOLEAN) ELSE true END"""
    )
