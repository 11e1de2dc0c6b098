"""Checks of many (resource, subject) pairs, goal by goal: what is asked travels down, what is granted comes back.

Work grows with the pairs asked and the tuples next to their resources, not with the number of subjects that a
permission has. Each step joins goals with tuples by resource; goals that meet are answered once. Recursive
relations are taken from the planner's fixpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import k3
from ..model import ELLIPSIS, WILDCARD, Arrow, Itself, Nil, Ref, Schema
from . import subject_sets as sets
from .fixpoint import keep
from .permissions import Planner

GOAL = ["rid", "stype", "srel", "sid"]


class Goals:
    """plain: no tuple that matters has a condition, so entries need no aggregation and set steps are semi-joins."""

    def __init__(self, schema: Schema, rows: DataFrame, plain: bool = False) -> None:
        self.schema, self.planner, self.plain = schema, Planner(schema, rows), plain

    def granted(self, type_: str, rel: str, goals: DataFrame) -> DataFrame | None:
        """The goals (rid, stype, srel, sid) that have an entry ``k``; None if none can have one."""
        relation = self.schema.relation(type_, rel)
        if relation is None:
            return None
        if (type_, rel) in self.planner.cycles:
            view = self.planner.view(type_, rel)
            return None if view.empty else sets.granted(view, goals).filter("k is not null")
        if relation.is_permission:
            return self._expr(type_, relation.rewrite, goals)
        rows = self.planner.tuples(type_, rel)
        exact = rows.filter(F.col("sid") != WILDCARD) if any(a.wildcard for a in relation.allowed) else rows
        parts = [goals.join(exact, GOAL).select(*GOAL, "k")]
        if any(a.wildcard for a in relation.allowed):
            everybody = rows.filter(F.col("sid") == WILDCARD).select("rid", "stype", "k")
            parts.append(goals.join(everybody, ["rid", "stype"]).select(*GOAL, "k"))
        for t, r in sorted({(a.type, a.rel) for a in relation.allowed if a.rel != ELLIPSIS}):
            through = rows.filter((F.col("stype") == t) & (F.col("srel") == r)).select("rid", F.col("sid").alias("target"), "k")
            parts.append(self._below(t, r, goals, through))
        return self._any(parts)

    def _any(self, parts: list[DataFrame | None]) -> DataFrame | None:
        parts = [p for p in parts if p is not None]
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        if self.plain:
            return rows.select(*GOAL).distinct().withColumn("k", k3.always())
        return rows.groupBy(*GOAL).agg(k3.any_of(F.col("k")).alias("k"))

    def _own(self, t: str, r: str, goals: DataFrame) -> DataFrame:
        """Goals whose subject is the very object and relation."""
        return goals.filter((F.col("stype") == t) & (F.col("srel") == r) & (F.col("sid") == F.col("rid"))).select(*GOAL, k3.always().alias("k"))

    def _below(self, t: str, r: str, goals: DataFrame, through: DataFrame, every: bool = False) -> DataFrame | None:
        """Goals that a target (through: rid, target, k) grants, one row a target."""
        step = goals.join(through.withColumnRenamed("k", "k_t"), "rid")
        inner = keep(step.select(F.col("target").alias("rid"), "stype", "srel", "sid").distinct())  # read several times below
        found = self._any([self.granted(t, r, inner), self._own(t, r, inner)])
        found = found.select(F.col("rid").alias("target"), "stype", "srel", "sid", F.col("k").alias("k_i"))
        out = step.join(found, ["target", "stype", "srel", "sid"])
        out = out.withColumn("k", k3.always() if self.plain else k3.and_(F.col("k_t"), F.col("k_i")))
        return out.select(*GOAL, "k", F.concat(F.lit(f"{t}:"), "target").alias("target")) if every else out.select(*GOAL, "k")

    def _expr(self, type_: str, e, goals: DataFrame) -> DataFrame | None:
        if isinstance(e, Nil):
            return None
        if isinstance(e, Itself):
            return self._own(type_, ELLIPSIS, goals)
        if isinstance(e, Ref):
            return self._any([self.granted(type_, e.name, goals), self._own(type_, e.name, goals)])
        if isinstance(e, Arrow):
            return self._arrow(type_, e, goals)
        if e.kind == "union":
            return self._any([self._expr(type_, p, goals) for p in e.parts])
        out = self._expr(type_, e.parts[0], goals)
        for p in e.parts[1:]:
            if out is None:
                return None
            out = keep(out)  # later operands are asked only about what is left
            other = self._expr(type_, p, out.select(*GOAL))
            if e.kind == "intersection":
                if other is None:
                    return None
                out = out.join(other.select(*GOAL), GOAL, "left_semi") if self.plain else out.join(other.withColumnRenamed("k", "k_o"), GOAL).select(*GOAL, k3.and_(F.col("k"), F.col("k_o")).alias("k"))
            elif other is not None and self.plain:
                out = out.join(other.select(*GOAL), GOAL, "left_anti")
            elif other is not None:
                out = out.join(other.withColumnRenamed("k", "k_o"), GOAL, "left").select(*GOAL, k3.minus(F.col("k"), F.col("k_o")).alias("k")).filter("k is not null")
        return out

    def _arrow(self, type_: str, e: Arrow, goals: DataFrame) -> DataFrame | None:
        over = self.schema.relation(type_, e.over)
        if over is None:
            return None
        rows = self.planner.tuples(type_, e.over).filter(F.col("sid") != WILDCARD)
        parts = []
        for t in sorted({a.type for a in over.allowed if not a.wildcard}):
            if self.schema.relation(t, e.name):
                own = rows.filter(F.col("stype") == t).select("rid", F.col("sid").alias("target"), "k")
                through = own.select("rid", "target").distinct().withColumn("k", k3.always()) if self.plain else own.groupBy("rid", "target").agg(k3.any_of(F.col("k")).alias("k"))
                parts.append(self._below(t, e.name, goals, through, e.every))
        parts = [p for p in parts if p is not None]
        if not e.every or not parts:
            return self._any(parts)
        n = rows.select("rid", "stype", "sid").distinct().groupBy("rid").agg(F.count("*").alias("n"))
        got = reduce(DataFrame.unionByName, parts).groupBy(*GOAL).agg(k3.all_of(F.col("k")).alias("k"), F.count_distinct("target").alias("got"))
        return got.join(n, "rid").filter("got = n").select(*GOAL, "k")
