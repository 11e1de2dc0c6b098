"""Checks of a schema, of relationships against it, and of a schema change against the data."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cel
from ..model import ELLIPSIS, WILDCARD, Arrow, Ref, Schema, SchemaError, walk
from . import graph


def check_schema(schema: Schema) -> Schema:
    """Raise SchemaError for the first fault: unknown names, arrows over permissions or over wildcards, wildcards
    reached through a userset, repeated types, caveats that don't parse, have unused parameters or no boolean."""
    for c in schema.caveats.values():
        used = cel.check(c.body, c.params)
        if unused := [p for p in c.params if p not in used]:
            raise SchemaError(f"caveat {c.name!r}: parameter {unused[0]!r} is not used")
    for d in schema.definitions.values():
        for r in d.relations.values():
            on = f"{d.name}#{r.name}"
            if len(set(map(str, r.allowed))) < len(r.allowed):
                raise SchemaError(f"{on}: a subject type is there twice")
            for a in r.allowed:
                if a.type not in schema.definitions:
                    raise SchemaError(f"{on}: unknown type {a.type!r}")
                if a.rel != ELLIPSIS:
                    inner = schema.relation(a.type, a.rel)
                    if inner is None:
                        raise SchemaError(f"{on}: {a.type} has no relation {a.rel!r}")
                    if graph.may_hold(schema, {(a.type, a.rel)})[0]:
                        raise SchemaError(f"{on}: {a.type}#{a.rel} may hold wildcards, which can't be members of members")
                if a.caveat and a.caveat not in schema.caveats:
                    raise SchemaError(f"{on}: unknown caveat {a.caveat!r}")
            for e in walk(r.rewrite) if r.is_permission else ():
                if isinstance(e, Ref) and e.name not in d.relations:
                    raise SchemaError(f"{on}: {d.name} has no relation {e.name!r}{_hint(e.name, d.relations)}")
                if isinstance(e, Arrow):
                    over = d.relations.get(e.over)
                    if over is None:
                        raise SchemaError(f"{on}: {d.name} has no relation {e.over!r}{_hint(e.over, d.relations)}")
                    if over.is_permission:
                        raise SchemaError(f"{on}: an arrow can't start at permission {e.over!r}")
                    if any(a.wildcard for a in over.allowed):
                        raise SchemaError(f"{on}: an arrow can't go over {e.over!r}, which may hold wildcards")
                    if not any(schema.relation(a.type, e.name) for a in over.allowed):
                        raise SchemaError(f"{on}: no type of {e.over!r} has {e.name!r}")
    return schema


def _hint(name: str, known) -> str:
    near = difflib.get_close_matches(name, list(known), 1)
    return f", did you mean {near[0]!r}?" if near else ""


def relationship_faults(schema: Schema, rows: DataFrame) -> DataFrame:
    """The rows that the schema doesn't allow, with the reason in ``fault``.

    The allowed shapes are a small table that all rows are matched with in one broadcast join (its size is that
    of the schema, which the driver holds).
    """
    spark = rows.sparkSession
    shapes, names = [], []
    for d in schema.definitions.values():
        for r in d.relations.values():
            names.append((d.name, r.name, r.is_permission))
            shapes += [(d.name, r.name, a.type, a.rel, a.wildcard, a.caveat or "", a.expiration) for a in r.allowed]
    shape = spark.createDataFrame(shapes, "resource_type string, resource_rel string, subject_type string, subject_rel string, s_wild boolean, s_caveat string, s_exp boolean")
    known = spark.createDataFrame(names, "resource_type string, resource_rel string, is_permission boolean")
    keyed = rows.withColumn("row_no", F.monotonically_increasing_id()).withColumn("w", F.col("subject_id") == WILDCARD)
    keyed = keyed.join(F.broadcast(known), ["resource_type", "resource_rel"], "left")
    kinds = F.broadcast(shape.groupBy("resource_type", "resource_rel", "subject_type", "subject_rel", "s_wild").agg(F.collect_set(F.struct("s_caveat", "s_exp")).alias("traits")))
    keyed = keyed.join(kinds.withColumnRenamed("s_wild", "w"), ["resource_type", "resource_rel", "subject_type", "subject_rel", "w"], "left")
    trait = F.exists("traits", lambda t: (t["s_caveat"] == F.coalesce("caveat_name", F.lit(""))) & (t["s_exp"] == F.col("expiration_ns").isNotNull()))
    fault = (
        F.when(F.least(*(F.length(c) for c in ("resource_type", "resource_id", "resource_rel", "subject_type", "subject_id", "subject_rel"))) == 0, "a part is empty")
        .when(F.col("resource_id") == WILDCARD, "a resource can't be a wildcard")
        .when(F.col("is_permission").isNull(), "unknown relation")
        .when(F.col("is_permission"), "a permission can't be written to")
        .when(F.col("traits").isNull(), "subject type not allowed")
        .when(~trait, "caveat or expiration not allowed")
    )
    return keyed.withColumn("fault", fault).filter("fault is not null").select(*rows.columns, "fault")


def orphans(old: Schema, new: Schema, rows: DataFrame) -> DataFrame:
    """Live rows that the old schema allowed and the new one doesn't, with the reason."""
    return relationship_faults(new, rows)
