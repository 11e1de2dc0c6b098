"""Conditions of relationships, decided once for each distinct one and request."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Schema
from . import cel, k3

#: Distinct conditions of up to so many bytes are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def decided(rows: DataFrame, schema: Schema, context: dict | None = None) -> DataFrame:
    """The rows with their entry ``k``: unconditional without a caveat, else what the caveat gives for the stored
    context over the request's. Only distinct (caveat, context) pairs are evaluated. An unknown caveat, a context
    of wrong types or an evaluation error raises."""
    if not schema.caveats:
        return rows.withColumn("k", k3.always())
    bodies = {c.name: (c.body, c.params) for c in schema.caveats.values()}
    asked = json.loads(json.dumps(context or {}))
    kind = pa.struct([("st", pa.int32()), ("missing", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, ctx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in bodies:
                    raise cel.CelError(f"unknown caveat {name!r}")
                verdict, missing = cel.decide(*bodies[name], json.loads(ctx) if ctx else None, asked)
                out.append({"st": k3.U if verdict is None else k3.T if verdict else k3.FALSE, "missing": missing})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["cn", "cc", "kk"])

    pairs = rows.filter("caveat_name is not null").select(F.col("caveat_name").alias("cn"), F.coalesce("caveat_ctx", F.lit("")).alias("cc")).distinct()
    table = pairs.mapInArrow(run, f"cn string, cc string, kk {k3.TYPE}")
    size = pairs.agg(F.sum(F.length("cn") + F.length("cc") + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    out = rows.join(table, (F.col("caveat_name") == F.col("cn")) & (F.coalesce("caveat_ctx", F.lit("")) == F.col("cc")), "left")
    return out.withColumn("k", F.when(F.col("caveat_name").isNull(), k3.always()).otherwise(F.col("kk"))).drop("cn", "cc", "kk")
