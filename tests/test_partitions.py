"""Sessions stay whole where adaptive execution joins small partitions."""

from __future__ import annotations

import duckdb
import pytest

from quillon.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


@pytest.fixture
def small_partitions(spark):
    spark.conf.set(LEAST, "4k")
    yield
    spark.conf.unset(LEAST)


def same_as_twin(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_commands_meet_the_messages_of_their_session(spark, small_partitions):
    same_as_twin(spark, "compressed_ranges")


def test_counts_of_pruned_calls_and_messages(spark, small_partitions):
    same_as_twin(spark, "pruned_counts")


def shuffled(spark, name):
    """What the shuffles of a query carry, where no side of a join is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


def test_a_breakdown_moves_no_texts_of_calls(spark):
    assert not [x for x in shuffled(spark, "context_breakdown") if "AS parts" in x or "p#" in x and ".output" in x]
    same_as_twin(spark, "context_breakdown")


def test_pruned_calls_are_listed_without_a_join(spark):
    assert len(shuffled(spark, "pruned_items")) <= 3
    same_as_twin(spark, "pruned_items")


def test_a_request_decides_from_calls_without_their_outputs(spark):
    from quillon.operators import parts as pt
    from quillon.plans import history_queries as hq
    from quillon.sources import history as hs

    m = hs.history(spark, SF)
    told = pt.tool_calls(pt.with_compaction(pt.told(m), hq.hidden(m)))
    whole = pt.tool_calls(pt.with_compaction(m, hq.hidden(m)))
    assert told.columns == whole.columns and sorted(map(tuple, told.collect())) == sorted(map(tuple, whole.collect()))


def test_calls_of_no_session_are_not_counted_for_session_0(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 5 <> 3 THEN user_id END AS user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.execute(ORACLE_SQL["pruned_counts"]).fetchall()
    got = list(map(tuple, QUERIES["pruned_counts"](spark, str(tmp_path)).collect()))
    assert len(got) == len(want) and set(got) == set(want)
    assert [row[0] for row in got].count(None) == 1
