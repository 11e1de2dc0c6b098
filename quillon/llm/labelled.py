"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut


def sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, most: int, parts: int = 8) -> DataFrame:
    """(text, label, part): about ``most`` documents of each label at most, of those that ``where`` lets learn from.

    A row is in by the hash of its id. Ids of the sample are broadcast, there being 2 * most at most or so; the
    documents are read once and not shuffled but for the sample. ``part`` is a second hash, 0 to 9. Labels
    other than 0 and 1, null ids and unlabelled documents are left out; of several labels of one id the
    largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for k in (0, 1):
        share = F.when(F.col("label") == k, min(1.0, most / max(1, n.get(k, 0)))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)
    ids = known.filter(place < share)
    rows = common.text_of(docs).join(F.broadcast(ids), "doc_id")
    return cut(rows.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(10)).cast("int").alias("part")).repartition(parts))
