"""Deadlines, guards, stored relations and bounds of a session."""

import time

import pytest
from pyspark.sql import functions as F

from granary.demo import sales_session
from granary.errors import SemanticError
from granary.validate import _deadline


def test_a_deadline_cancels_jobs(spark):
    slow = F.udf(lambda x: time.sleep(2) or x, "long")
    began = time.time()
    with _deadline(spark, 0.5) as over:
        spark.range(40).select(slow("id").alias("v")).agg(F.sum("v")).collect()
    assert over.is_set() and time.time() - began < 15
    with _deadline(spark, 60) as over:
        assert spark.range(5).count() == 5
    assert not over.is_set()
    with pytest.raises(ZeroDivisionError), _deadline(spark, 60):
        raise ZeroDivisionError


def test_published_objects_need_semantic_sql(spark):
    s = sales_session(spark)
    s.publish("sales")
    s.semantic_sql = False
    with pytest.raises(SemanticError) as e:
        s.sql("SELECT * FROM SEMANTIC_SALES.SALES")
    assert e.value.code == "SEMANTIC_SURFACE_001" and s.sql("SELECT 1 AS x").first().x == 1


def test_stored_relations_are_read_back(spark, tmp_path):
    s = sales_session(spark)
    path = s.relations.store("MART", "kept", spark.range(3), f"file://{tmp_path}/kept")
    assert s.relations("MART", "kept").count() == 3 and path in s.relations("MART", "kept").inputFiles()[0].replace("file:///", "file:///")


def test_compiled_plans_are_bounded(spark, monkeypatch):
    from granary import session

    monkeypatch.setattr(session, "MAX_CACHED", 2)
    s = sales_session(spark)
    s.publish("sales")
    for limit in (1, 2, 3):
        assert s.compile({"model": "sales", "object": "SALES", "metrics": ["total_revenue"], "limit": limit}).status == "OK"
    assert len(s.cache) == 2
