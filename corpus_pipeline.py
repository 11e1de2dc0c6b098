"""A training corpus from raw documents: drop toxic ones, keep one of each near-duplicate group, redact secrets,
mix sources to their target weights, encode."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, mixing, near_dedup, secrets, sentencepiece_scan
from quillon.llm import toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from labelled documents of the learning folds."""
    model = tox.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), tox.learners())
    return tox.accepted(docs, model)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group that links of similarity 0.8 or more join."""
    return near_dedup.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): a row for each copy."""
    return sentencepiece_scan.encode(docs).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Learnt models and piece paths are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    base = f"{common.shared_dir(spark)}/quillon-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
