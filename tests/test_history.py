"""The two forms of the history over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.sources import history as hs

SF = "/root/testdata/sf0.001"


def test_parts_made_in_place_are_those_that_are_joined(spark):
    columns = hs.history(spark, SF).columns
    assert hs.joined(spark, SF).select(columns).schema["parts"].dataType.elementType == hs.history(spark, SF).schema["parts"].dataType.elementType
    rows = lambda m: sorted(m.select("session_id", "message_id", F.to_json(F.struct(*columns)).alias("x")).collect())
    assert rows(hs.history(spark, SF)) == rows(hs.joined(spark, SF))


def test_history_shuffles_once_and_before_texts_are_made(spark):
    plan = hs.history(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "made" not in plan[plan.index("Exchange hashpartitioning") :]


def test_fields_that_nobody_asks_for_are_not_made(spark):
    plan = hs.parts(spark, SF).select("session_id", "tool")._jdf.queryExecution().optimizedPlan().toString()
    assert "filePath" not in plan and "failed with" not in plan
