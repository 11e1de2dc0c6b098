"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once (a longer document is a step of its own).
STEP_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, and make sure that a checkpoint folder exists.

    The cluster names the shared folder in ``spark.checkpoint.dir``; only where it is unset and all runs on one
    machine (tests, notebooks) a local folder is made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))


def lean(run: Callable) -> Callable:
    """An Arrow function that, when its task ends, gives the worker's free memory back to the system.

    Workers outlive tasks; without this each keeps the most that any task of the session ever needed.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return bounded


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    prepare(spark)
    named = spark.conf.get("spark.checkpoint.dir", "")
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows in the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) and more columns of the input; a null text counts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches of about ``size`` bytes of text each, with that text as UTF-8."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary() if not pa.types.is_large_string(batch.column(column).type) else pa.large_binary()).to_pylist()
        start = total = 0
        for i, t in enumerate(texts):
            if i > start and total + len(t) > size:
                yield batch.slice(start, i - start), texts[start:i]
                start, total = i, 0
            total += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def lists(values, offsets, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
