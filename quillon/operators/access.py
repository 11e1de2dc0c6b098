"""The questions: may this subject, which resources, which subjects, and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import caveats, k3
from ..model import ELLIPSIS, MAX_DEPTH, WILDCARD, Arrow, DepthError, Itself, Nil, Op, Ref, Schema, walk
from ..plans import graph
from . import blocks, strict
from . import subject_sets as sets
from .filters import page, unexpired
from .fixpoint import closure, keep
from .goals import Goals
from .permissions import Planner, Unstratified

ASKED = ["rid", "stype", "srel", "sid"]
#: Live rows below the asked resources that a check of an unstratified permission may bring to the driver.
STRICT_ROWS = 200_000


def prepared(schema: Schema, rows: DataFrame, now_ns: int | None = None, context: dict | None = None) -> DataFrame:
    """Live rows without expired ones, each with its entry ``k`` for the request's context."""
    return caveats.decided(rows if now_ns is None else unexpired(rows, now_ns), schema, context)


def check(schema: Schema, rows: DataFrame, type_: str, permission: str, asked: DataFrame) -> DataFrame:
    """asked (rid, stype, srel, sid) with verdict (member, caveated, notMember) and the missing inputs.

    rows are ``prepared``. Equal questions are answered once; what is asked goes down the permission (see
    ``goals``). A subject that is the resource's own permission is a member.
    """
    todo = keep(asked.select(*ASKED).distinct())
    if graph.below(schema, {(type_, permission)}) & graph.cycles(schema).keys():
        rows = narrowed(schema, rows, type_, permission, todo.select("rid"))
    try:
        plain = not graph.may_hold(schema, {(type_, permission)})[1]
        found = Goals(schema, rows, plain).granted(type_, permission, todo)
        out = todo.join(found, ASKED, "left") if found is not None else todo.withColumn("k", k3.none())
    except Unstratified:
        out = strict.checked(schema, rows, type_, permission, todo, STRICT_ROWS)
    own = (F.col("stype") == type_) & (F.col("sid") == F.col("rid")) & (F.col("srel") == permission)
    out = out.withColumn("k", F.when(own, k3.always()).otherwise(F.col("k")))
    out = out.select(*ASKED, k3.verdict(F.coalesce("k", k3.of(F.lit(k3.FALSE)))).alias("verdict"), F.when(F.col("k.st") == k3.U, F.col("k.missing")).otherwise(F.array().cast("array<string>")).alias("missing"))
    return asked.join(out, ASKED)


def narrowed(schema: Schema, rows: DataFrame, type_: str, permission: str, resources: DataFrame) -> DataFrame:
    """The rows of objects that lie below the resources (rid): what the permission's usersets and arrows lead to from
    there. Relationships of other objects can't matter, so recursion needn't go through them. Where objects lie more
    than MAX_DEPTH steps below, and where ``self`` takes part (any row may name its objects), the rows as they are."""
    hops = graph.hops(schema, (type_, permission))
    if not hops or any(isinstance(e, Itself) for n in graph.below(schema, {(type_, permission)}) if schema.relation(*n) for e in walk(schema.relation(*n).rewrite)):
        return rows
    name = lambda t, i: F.concat_ws("\x1f", t, i)
    hop = reduce(lambda x, y: x | y, [(F.col("resource_type") == t) & (F.col("resource_rel") == r) & (F.col("subject_type") == st) for t, r, st in hops])
    edges = rows.filter(hop & (F.col("subject_id") != WILDCARD)).select(name("resource_type", "resource_id").alias("src"), name("subject_type", "subject_id").alias("dst"))
    seeds = resources.select(F.lit(0).alias("start"), name(F.lit(type_), "rid").alias("node"))
    try:
        found = closure(edges, seeds).select("node")
    except DepthError:
        return rows
    return keep(rows.join(found, name(rows["resource_type"], rows["resource_id"]) == found["node"], "left_semi"))


def lookup_subjects(schema: Schema, rows: DataFrame, type_: str, permission: str, resources: DataFrame, subject_type: str, subject_rel: str = ELLIPSIS, wildcards: bool = True, limit: int = 0) -> DataFrame:
    """(rid, sid, st, missing, excluded) for resources (rid): subjects of the type, and ``*`` with whom it leaves out.
    A limit counts single subjects only, in id order for each resource."""
    held = Planner(schema, rows, within=resources).blocked(type_, permission, root=True)
    if held is not None:  # without wildcards; only the first of each block can be among the first of a set
        view = sets.SubjectSet(blocks.entries(blocks.leading(held, limit) if limit > 0 else blocks.listed(held)))
    else:  # blocks list nobody below other resources, so they need no such search
        rows = narrowed(schema, rows, type_, permission, resources)
        view = Planner(schema, rows, within=resources).view(type_, permission, root=True)
    found = sets.listed(view).filter((F.col("stype") == subject_type) & (F.col("srel") == subject_rel))
    if not wildcards:
        found = found.filter(F.col("sid") != WILDCARD)
    if limit > 0:
        from pyspark.sql import Window

        order = Window.partitionBy("rid").orderBy((F.col("sid") == WILDCARD).cast("int"), "sid")
        found = found.withColumn("n", F.row_number().over(order)).filter((F.col("n") <= limit) | (F.col("sid") == WILDCARD)).drop("n")
    return found.select("rid", "sid", "st", "missing", "excluded")


def reached(schema: Schema, rows: DataFrame, type_: str, permission: str, subjects: DataFrame) -> DataFrame:
    """(start, rid, sure): resources of the permission that steps from the subjects (stype, sid, srel) lead to; sure
    if no condition, intersection or exclusion lay on some way there. Rounds join only what is new."""
    steps = graph.toward(graph.entries(schema, first=True), (type_, permission))
    tuples = rows.select("resource_type", "resource_id", "resource_rel", "subject_type", "subject_id", "subject_rel", (F.col("k.st") == k3.A).alias("plain"), (F.col("k.st") > k3.FALSE).alias("possible")).filter("possible")
    seed = subjects.select(F.concat_ws("\x1f", "stype", "sid", "srel").alias("start"), F.col("stype").alias("t"), F.col("sid").alias("id"), F.col("srel").alias("r"), F.lit(True).alias("sure"))
    seed = seed.unionByName(seed.filter(F.col("r") == ELLIPSIS).withColumn("id", F.lit(WILDCARD)))
    known = keep(seed.distinct())
    delta = known
    for _ in range(MAX_DEPTH):
        parts = []
        for e in steps:
            at = delta.filter((F.col("t") == e.source[0]) & (F.col("r") == e.source[1]))
            if e.kind in ("computed", "self"):
                parts.append(at.filter(F.col("id") != WILDCARD).select("start", F.lit(e.target[0]).alias("t"), "id", F.lit(e.target[1]).alias("r"), (F.col("sure") & F.lit(e.direct)).alias("sure")))
                continue
            over = e.over if e.kind == "arrow" else e.target[1]
            own = tuples.filter((F.col("resource_type") == e.target[0]) & (F.col("resource_rel") == over) & (F.col("subject_type") == e.source[0]))
            if e.kind == "arrow":
                at = at.filter(F.col("id") != WILDCARD)
            else:
                own = own.filter(F.col("subject_rel") == e.source[1])
                at = at.filter((F.col("id") == WILDCARD) if e.wildcard else (F.col("id") != WILDCARD))
            hit = at.join(own, at["id"] == own["subject_id"])
            parts.append(hit.select("start", F.lit(e.target[0]).alias("t"), F.col("resource_id").alias("id"), F.lit(e.target[1]).alias("r"), (F.col("sure") & F.col("plain") & F.lit(e.direct)).alias("sure")))
        if not parts:
            break
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("start", "t", "id", "r").agg(F.max("sure").alias("sure"))
        old = known.groupBy("start", "t", "id", "r").agg(F.max("sure").alias("was"))
        delta = keep(found.join(old, ["start", "t", "id", "r"], "left").filter("was is null or (sure and not was)").drop("was"))
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
    else:
        raise DepthError(f"more than {MAX_DEPTH} steps")
    return known.filter((F.col("t") == type_) & (F.col("r") == permission)).groupBy("start", F.col("id").alias("rid")).agg(F.max("sure").alias("sure"))


def lookup_resources(schema: Schema, rows: DataFrame, type_: str, permission: str, subjects: DataFrame, after: str | None = None, limit: int = 0) -> DataFrame:
    """(rid, verdict, missing, subjects): resources that any of the subjects may reach, in id order after a cursor;
    a member beats a conditional one, and those subjects' missing inputs are put together. Candidates come
    from the subjects' side; those that aren't sure are checked from the resources' side."""
    found = keep(reached(schema, rows, type_, permission, subjects))
    part = F.split("start", "\x1f")
    asked = found.select("rid", part[0].alias("stype"), part[2].alias("srel"), part[1].alias("sid"), "sure")
    sure = asked.filter("sure").select(*ASKED, F.lit("member").alias("verdict"), F.array().cast("array<string>").alias("missing"))
    open_ = asked.filter("not sure").select(*ASKED)
    if not open_.isEmpty():
        sure = sure.unionByName(check(schema, rows, type_, permission, open_).select(*ASKED, "verdict", "missing"))
    member = F.max(F.col("verdict") == "member")
    out = sure.filter("verdict <> 'notMember'").groupBy("rid").agg(member.alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("names"), F.array_sort(F.collect_set("sid")).alias("subjects"))
    out = out.select("rid", F.when(F.col("m"), "member").otherwise("caveated").alias("verdict"), F.when(F.col("m"), F.array().cast("array<string>")).otherwise(F.col("names")).alias("missing"), "subjects")
    return page(out, ["rid"], None if after is None else [after], limit)


def covered(schema: Schema, rows: DataFrame, type_: str, permission: str, subjects: DataFrame) -> DataFrame:
    """(start, rid) by reachability over stored tuples alone; only for permissions that flatten to them."""
    if not graph.flattens(schema, (type_, permission)):
        raise ValueError(f"{type_}#{permission} is more than stored tuples")
    return reached(schema, rows, type_, permission, subjects).select("start", "rid").distinct()


# ---- expand


def expand(schema: Schema, rows: DataFrame, type_: str, relation: str, resources: DataFrame, recursive: bool = False) -> DataFrame:
    """The permission tree of each resource (rid) as rows (root, path, parent, kind, op, object, subject).

    kind is node (an operation) or leaf (a subject); a leaf's path is its node's. Shallow trees stop at stored
    subjects; recursive ones go on from each userset. A userset that its own path already went through is an
    empty leaf. Each round expands one level of all trees at once.
    """
    columns = "root string, path string, parent string, kind string, op string, object string, subject string"
    out = rows.sparkSession.createDataFrame([], columns)
    todo = resources.select(F.col("rid").alias("root"), F.lit("0").alias("path"), F.lit("").alias("parent"), F.lit(type_).alias("t"), F.lit(relation).alias("r"), F.col("rid").alias("id"), F.array().cast("array<string>").alias("seen"))
    for _ in range(MAX_DEPTH):
        made, more = [], []
        for t, r in _kinds(schema, type_, relation):
            at = todo.filter((F.col("t") == t) & (F.col("r") == r))
            obj = F.concat(F.lit(f"{t}:"), "id", F.lit(f"#{r}"))
            at = at.withColumn("object", obj).filter(~F.array_contains("seen", F.col("object"))).withColumn("seen", F.array_append("seen", F.col("object")))
            found = schema.relation(t, r)
            if found is None:
                continue
            if found.is_permission:
                _grow(schema, rows, t, found.rewrite, at, made, more)
            else:
                made.append(_node(at, "this"))
                own = rows.filter((F.col("resource_type") == t) & (F.col("resource_rel") == r)).select(F.col("resource_id").alias("id"), "subject_type", "subject_id", "subject_rel")
                leaf = at.join(own, "id")
                name = F.concat_ws(":", "subject_type", "subject_id")
                name = F.when(F.col("subject_rel") == ELLIPSIS, name).otherwise(F.concat_ws("#", name, "subject_rel"))
                made.append(leaf.select("root", "path", "parent", F.lit("leaf").alias("kind"), F.lit("").alias("op"), "object", name.alias("subject")))
                if recursive:
                    deeper = leaf.filter(F.col("subject_rel") != ELLIPSIS)
                    more.append(deeper.select("root", F.concat_ws("/", "path", name).alias("path"), F.col("path").alias("parent"), F.col("subject_type").alias("t"), F.col("subject_rel").alias("r"), F.col("subject_id").alias("id"), "seen"))
        for m in made:
            out = out.unionByName(m)
        if not more:
            break
        todo = more[0]
        for m in more[1:]:
            todo = todo.unionByName(m)
        todo = keep(todo)
        if todo.isEmpty():
            break
    return out


def _kinds(schema: Schema, type_: str, relation: str) -> list[tuple[str, str]]:
    return sorted(graph.below(schema, {(type_, relation)}))


def _node(at: DataFrame, op: str) -> DataFrame:
    return at.select("root", "path", "parent", F.lit("node").alias("kind"), F.lit(op).alias("op"), "object", F.lit("").alias("subject"))


def _grow(schema: Schema, rows: DataFrame, type_: str, expr, at: DataFrame, made: list, more: list) -> None:
    """One node for the expression, and what hangs below it."""
    below = lambda i: at.withColumn("parent", F.col("path")).withColumn("path", F.concat("path", F.lit(f"/{i}")))
    if isinstance(expr, Op):
        made.append(_node(at, expr.kind))
        for i, p in enumerate(expr.parts):
            _grow(schema, rows, type_, p, below(i), made, more)
    elif isinstance(expr, Ref):
        made.append(_node(at, "computed"))
        more.append(below(0).select("root", "path", "parent", F.lit(type_).alias("t"), F.lit(expr.name).alias("r"), "id", "seen"))
    elif isinstance(expr, Nil):
        made.append(_node(at, "nil"))
    elif isinstance(expr, Itself):
        made.append(_node(at, "self"))
        made.append(at.select("root", "path", "parent", F.lit("leaf").alias("kind"), F.lit("").alias("op"), "object", F.concat(F.lit(f"{type_}:"), "id").alias("subject")))
    elif isinstance(expr, Arrow):
        made.append(_node(at, "intersection" if expr.every else "union"))
        over = rows.filter((F.col("resource_type") == type_) & (F.col("resource_rel") == expr.over) & (F.col("subject_id") != WILDCARD))
        hit = at.join(over.select(F.col("resource_id").alias("id"), "subject_type", "subject_id"), "id")
        target = F.concat_ws(":", "subject_type", "subject_id")
        more.append(hit.select("root", F.concat_ws("/", "path", target).alias("path"), F.col("path").alias("parent"), F.col("subject_type").alias("t"), F.lit(expr.name).alias("r"), F.col("subject_id").alias("id"), "seen"))
