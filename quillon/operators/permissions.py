"""The planner: a relation or permission of a type becomes a DataFrame plan over the visible relationships.

Views are built per (type, relation) and shared. Each allowed subject type of a relation is read by a scan of
its own, whose equality filters reach the Parquet reader. Recursion through unions, arrows and usersets is a
least fixpoint, found in rounds; permissions of plain relations and arrows are held in ``blocks``; recursion through exclusion, intersection or ``.all`` has no such fixpoint
and is left to ``strict.Walk``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import k3
from ..model import ELLIPSIS, MAX_DEPTH, WILDCARD, Arrow, DepthError, Itself, Nil, Op, Ref, Schema, walk
from ..plans import graph
from . import blocks
from . import subject_sets as sets
from .blocks import Blocked
from .fixpoint import keep
from .subject_sets import KEYS, SubjectSet


class Unstratified(ValueError):
    """Recursion through an operator that isn't monotone."""


class _Listed(Exception):
    """A set that isn't held in blocks."""


class Planner:
    """rows: live relationships, without expired ones. caveats: entries of caveated rows as a column ``k``."""

    def __init__(self, schema: Schema, rows: DataFrame, within: DataFrame | None = None) -> None:
        self.schema, self.spark = schema, rows.sparkSession
        if "k" not in rows.columns:
            rows = rows.withColumn("k", k3.always())
        self.rows, self.within = rows, within
        self.views: dict[tuple[str, str], SubjectSet] = {}
        self.cycles = graph.cycles(schema)
        self.in_blocks: dict[tuple[str, str], Blocked | None] = {}
        self.grouped: dict[tuple[str, str], Blocked] = {}

    # ---- scans

    def tuples(self, type_: str, rel: str, root: bool = False) -> DataFrame:
        rows = self.rows.filter((F.col("resource_type") == type_) & (F.col("resource_rel") == rel))
        if root and self.within is not None:
            rows = rows.join(self.within.select(F.col("rid").alias("resource_id")), "resource_id", "left_semi")
        return rows.select(F.col("resource_id").alias("rid"), F.col("subject_type").alias("stype"), F.col("subject_id").alias("sid"), F.col("subject_rel").alias("srel"), "k")

    def objects(self, type_: str) -> DataFrame:
        """Every id of the type that a relationship names on either side."""
        left = self.rows.filter(F.col("resource_type") == type_).select(F.col("resource_id").alias("rid"))
        right = self.rows.filter((F.col("subject_type") == type_) & (F.col("subject_id") != WILDCARD)).select(F.col("subject_id").alias("rid"))
        return left.union(right).distinct()

    # ---- views

    def view(self, type_: str, rel: str, root: bool = False) -> SubjectSet:
        """The subject sets of a relation; one that the schema doesn't have is empty."""
        key = (type_, rel)
        if key in self.views:
            return self.views[key]
        relation = self.schema.relation(type_, rel)
        if relation is None:
            return sets.nobody(self.spark)
        ring = self.cycles.get(key)
        if ring and not root:
            self._fix(ring)
            return self.views[key]
        if ring:
            self._fix(ring)
            out = self.views[key]
            if self.within is not None:
                out = SubjectSet(out.rows.join(self.within.select("rid").distinct(), "rid", "left_semi"), out.wild, out.conditional)
            return out
        held = self.blocked(type_, rel, root) if relation.is_permission else None
        if held is not None and held.blocks is not None:
            out = SubjectSet(blocks.entries(blocks.listed(held)))
        else:
            out = self._relation(type_, rel, root)
        if not root:
            self.views[key] = out
        return out

    def _relation(self, type_: str, rel: str, root: bool = False) -> SubjectSet:
        relation = self.schema.relation(type_, rel)
        if relation.is_permission:
            return self._expr(type_, relation.rewrite, root)
        rows, parts = self.tuples(type_, rel, root), []
        cond = any(a.caveat for a in relation.allowed)
        wild = any(a.wildcard for a in relation.allowed)
        direct = rows.withColumnRenamed("k", "c").select(*KEYS, "c", k3.none().alias("e"))
        parts.append(SubjectSet(direct, wild, cond))
        for t, r in sorted({(a.type, a.rel) for a in relation.allowed if a.rel != ELLIPSIS}):
            inner = self.view(t, r)
            if not inner.empty:
                through = rows.filter((F.col("stype") == t) & (F.col("srel") == r)).select("rid", F.col("sid").alias("target"), "k")
                parts.append(self._joined(through, inner, cond))
        return sets.union(parts, self.spark) if len(parts) > 1 else parts[0]

    def _joined(self, through: DataFrame, inner: SubjectSet, cond: bool) -> SubjectSet:
        """Subjects of the targets, as the objects' own: through (rid, target, k)."""
        cond = cond or inner.conditional
        rows = through.join(inner.rows.withColumnRenamed("rid", "target"), "target")
        c = k3.and_(F.col("k"), F.col("c")) if cond else F.col("c")
        rows = rows.select("rid", "stype", "srel", "sid", c.alias("c"), "e", "target")
        merged = sets.union([SubjectSet(rows, inner.wild, cond)], self.spark, branch="target")
        return merged

    def _expr(self, type_: str, expr, root: bool = False) -> SubjectSet:
        if isinstance(expr, Ref):
            return self.view(type_, expr.name, root)
        if isinstance(expr, Nil):
            return sets.nobody(self.spark)
        if isinstance(expr, Itself):
            return sets.identity(self.within if root and self.within is not None else self.objects(type_), type_)
        if isinstance(expr, Arrow):
            return self._arrow(type_, expr, root)
        parts = [self._expr(type_, p, root) for p in expr.parts]
        if expr.kind == "union":
            return sets.union(parts, self.spark)
        out = parts[0]
        for p in parts[1:]:
            out = sets.intersect(out, p, self.spark) if expr.kind == "intersection" else sets.exclude(out, p)
        return out

    def _arrow(self, type_: str, expr: Arrow, root: bool = False) -> SubjectSet:
        """Subjects of the computed relation on the objects that the tuples of ``over`` name, whatever relation
        those tuples give; wildcards lead nowhere."""
        relation = self.schema.relation(type_, expr.over)
        if relation is None:
            return sets.nobody(self.spark)
        cond = any(a.caveat for a in relation.allowed)
        rows = self.tuples(type_, expr.over, root).filter(F.col("sid") != WILDCARD)
        parts = []
        for t in sorted({a.type for a in relation.allowed if not a.wildcard}):
            inner = self.view(t, expr.name)
            if not inner.empty:
                own = rows.filter(F.col("stype") == t).select("rid", F.col("sid").alias("target"), "k")
                through = own.groupBy("rid", "target").agg(k3.any_of(F.col("k")).alias("k")) if cond else own.select("rid", "target").distinct().withColumn("k", k3.always())
                parts.append((t, inner, through))
        if not expr.every:
            return sets.union([self._joined(through, inner, cond) for _, inner, through in parts], self.spark)
        if not parts:
            return sets.nobody(self.spark)
        rows_of, wild, any_cond = None, False, cond
        for t, inner, through in parts:
            got = through.join(inner.rows.withColumnRenamed("rid", "target"), "target")
            c = k3.and_(F.col("k"), F.col("c")) if cond or inner.conditional else F.col("c")
            got = got.select("rid", "stype", "srel", "sid", c.alias("c"), "e", F.concat(F.lit(f"{t}:"), "target").alias("target"))
            rows_of = got if rows_of is None else rows_of.unionByName(got)
            wild, any_cond = wild or inner.wild, any_cond or inner.conditional
        targets = rows.select("rid", F.concat("stype", F.lit(":"), "sid").alias("target"))
        return sets.every(targets, SubjectSet(rows_of, wild, any_cond), self.spark)

    # ---- blocks

    def blocked(self, type_: str, rel: str, root: bool = False) -> Blocked | None:
        """The set in blocks; None where it is recursive, may hold wildcards or conditions, goes through usersets or
        ``self``, or its arrows lead to sets without blocks in common."""
        key = (type_, rel)
        if not root and key in self.in_blocks:
            return self.in_blocks[key]
        out = None
        if not (graph.below(self.schema, {key}) & self.cycles.keys() or any(graph.may_hold(self.schema, {key}))):
            leaves: dict[object, Blocked] = {}
            try:
                holds = self._formula(type_, Ref(rel), leaves, root)
                found = [s for s in leaves.values() if s.blocks is not None]
                if found and all(s.members is found[0].members for s in found):
                    out = next(iter(leaves.values())) if isinstance(self.schema.relation(*key).rewrite, Arrow) else blocks.combined(list(leaves.values()), holds)
            except _Listed:
                pass
        if not root:
            self.in_blocks[key] = out
        return out

    def _formula(self, type_: str, expr, leaves: dict, root: bool):
        """What the expression says of a subject by its presence in the leaves, which are added."""
        if isinstance(expr, Nil):
            return lambda has: F.lit(False)
        if isinstance(expr, Op):
            parts = [self._formula(type_, p, leaves, root) for p in expr.parts]
            join = {"union": lambda x, y: x | y, "intersection": lambda x, y: x & y, "exclusion": lambda x, y: x & ~y}[expr.kind]
            return lambda has: reduce(join, (p(has) for p in parts))
        if isinstance(expr, Ref):
            relation = self.schema.relation(type_, expr.name)
            if relation is None:
                return lambda has: F.lit(False)
            if relation.is_permission:
                return self._formula(type_, relation.rewrite, leaves, root)
            if any(a.rel != ELLIPSIS for a in relation.allowed):
                raise _Listed
            if expr not in leaves:
                leaves[expr] = blocks.single(self.tuples(type_, expr.name, root))
        elif isinstance(expr, Arrow):
            if expr not in leaves:
                leaves[expr] = self._arrow_blocks(type_, expr, root)
        else:
            raise _Listed
        i = list(leaves).index(expr)
        return lambda has: has[i]

    def _arrow_blocks(self, type_: str, expr: Arrow, root: bool) -> Blocked:
        over = self.schema.relation(type_, expr.over)
        types = {a.type for a in (over.allowed if over else ()) if not a.wildcard}
        target = next(iter(types)) if len(types) == 1 else None
        relation = target and self.schema.relation(target, expr.name)
        if not relation:
            raise _Listed
        if relation.is_permission:
            inner = self.blocked(target, expr.name)
            if inner is None or inner.changes is not None:
                raise _Listed
        else:
            if any(a.rel != ELLIPSIS for a in relation.allowed):
                raise _Listed
            key = (target, expr.name)
            if key not in self.grouped:
                self.grouped[key] = blocks.grouped(self.tuples(*key))
            inner = self.grouped[key]
        rows = self.tuples(type_, expr.over, root).filter(F.col("sid") != WILDCARD)
        if not expr.every:
            rows = rows.filter(F.col("stype") == target)
            return blocks.through(rows.select("rid", F.col("sid").alias("target")), inner)
        # tuples of any other type are targets that grant nobody
        rows = rows.select("rid", F.when(F.col("stype") == target, F.col("sid")).alias("target"), F.concat("stype", F.lit(":"), "sid").alias("id"))
        return blocks.through(rows, inner, every=True)

    def totals(self, type_: str, rel: str, first: bool = False) -> DataFrame:
        """(rid, users): how many subjects each object has; with ``first``, also the smallest id."""
        held = self.blocked(type_, rel)
        if held is not None:
            return blocks.totals(held, first)
        out = self.view(type_, rel).rows.groupBy("rid").agg(F.count("*").alias("users"), F.min("sid").alias("first"))
        return out if first else out.drop("first")

    # ---- recursion

    def _fix(self, ring: frozenset[tuple[str, str]]) -> None:
        """The least fixpoint of relations that depend on one another."""
        for type_, rel in ring:
            rewrite = self.schema.relation(type_, rel).rewrite
            for e in walk(rewrite) if rewrite is not None else ():
                if isinstance(e, Op) and e.kind != "union" or isinstance(e, Arrow) and e.every:
                    if graph.leads_to(self.schema, type_, e, ring):
                        raise Unstratified(f"{type_}#{rel} depends on itself through {getattr(e, 'kind', 'all')}")
        names = sorted(ring)
        for key in names:
            self.views[key] = sets.nobody(self.spark)
        wild, cond = graph.may_hold(self.schema, ring)
        for _ in range(MAX_DEPTH):
            fresh = {key: keep(self._relation(*key).rows) for key in names}
            still = all(self._holds(fresh[key], self.views[key].rows) for key in names)
            for key in names:
                self.views[key] = SubjectSet(fresh[key], wild, cond)
            if still:
                return
        raise DepthError(f"{', '.join('#'.join(k) for k in names)} needs more than {MAX_DEPTH} rounds")

    def _holds(self, rows: DataFrame, old: DataFrame) -> bool:
        """Whether the old rows have all of these entries. Rounds only ever add to entries."""
        had = old.select(*KEYS, F.col("c").alias("had_c"), F.col("e").alias("had_e"))
        same = F.col("c").eqNullSafe(F.col("had_c")) & F.col("e").eqNullSafe(F.col("had_e"))
        return rows.join(had, KEYS, "left").filter(~same).isEmpty()
