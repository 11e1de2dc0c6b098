"""Bulk imports reach the change log."""

import pytest
from pyspark.sql import functions as F

from quillon.model import KEY, TUPLES
from quillon.operators.filters import Filter
from quillon.operators.store import Commit, Conflict, Store
from quillon.streaming import watch


SCHEMA = "definition thing {} definition doc { relation viewer: thing }"


def rows(spark, *ids, relation="viewer"):
    row = {f.name: None for f in TUPLES} | {"resource_type": "doc", "resource_rel": relation, "subject_type": "thing", "subject_id": "x", "subject_rel": "..."}
    return spark.createDataFrame([{**row, "resource_id": i} for i in ids], TUPLES)


def test_log_after_an_import_folds_to_the_live_rows(spark):
    store = Store(spark, SCHEMA)
    revision = store.bulk_import(rows(spark, *"123"), now_ns=5)
    live = store.live().select(*KEY, F.col("created_rev"))
    assert sorted(watch.folded(store.log).select(*KEY, "created_rev").collect()) == sorted(live.collect())
    assert watch.changes(store.log, 0).count() == 3 and store.head == revision


def test_what_the_schema_refuses_changes_nothing(spark):
    with pytest.raises(Conflict, match="no schema"):
        Store(spark).bulk_import(rows(spark, "1"))
    store = Store(spark, SCHEMA)
    with pytest.raises(Conflict, match="unknown relation"):
        store.bulk_import(rows(spark, "1", relation="nosuch"))
    with pytest.raises(Conflict, match="unknown relation"):
        store.commit(Commit(updates=rows(spark, "1", relation="nosuch").withColumn("op", F.lit("touch"))))
    store.commit(Commit(updates=rows(spark, "1").withColumn("op", F.lit("touch")), metadata={"why": 1, "by": "tom"}), 10)
    with pytest.raises(Conflict, match="would be left"):
        store.commit(Commit(schema="definition thing {} definition doc { relation editor: thing }"), 20)
    assert store.head == 10 and len(store.schemas) == 1
    assert [r["tx_metadata"] for r in store.log.collect()] == ['{"by":"tom","why":1}']
    store.commit(Commit(schema="definition thing {} definition doc { relation editor: thing }", delete=Filter(type="doc")), 20)
    assert store.live().count() == 0
    store.collect_garbage(10)
    assert [r["rev"] for r in store.log.collect()] == [20]
