"""Scans, next-pointers and interval joins against loops, and their plans over long sessions."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import compact as cp
from quillon.operators import derive as dv
from quillon.operators import pressure as pr
from quillon.operators import scans as sc
from quillon.sources.scratch import writer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def messages(spark, seed=1, n=6):
    rng, rows = random.Random(seed), []
    for s in [None, *range(n)]:
        seq = rng.choice([-9, 0, 1])
        for _ in range(rng.randint(0, 60)):
            seq += rng.choice([1, 1, 1, 7, 40])
            rows.append((s, seq, rng.choice(["user", "assistant", "system"]), rng.random() < 0.3, rng.random() < 0.5))
    return spark.createDataFrame([r for r in rows if r[0] is not None], "session_id long, seq long, role string, ignored boolean, step_start boolean")


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_scans_equal_windows(spark, width):
    m = messages(spark).cache()
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(dv.turns(m), sc.turns(m, width)) and same(dv.last_user(m), sc.last_user(m, width))
    assert same(dv.last_user(m.drop("ignored")), sc.last_user(m.drop("ignored"), width))
    assert same(dv.message_refs(m), sc.message_refs(m, width=width)) and same(pr.turn_anchors(m), sc.turn_anchors(m, width))


def test_too_many_references_are_an_error(spark):
    m = messages(spark)
    with pytest.raises(Exception, match="too many"):
        sc.message_refs(m, 5, 4).collect()


@pytest.mark.parametrize("width, interval", [(4, 3), (16, 1), (16, 0), (1000, 12)])
def test_spaced_anchors_equal_the_fold(spark, width, interval):
    m = messages(spark, 5).select("session_id", "seq").cache()
    some = m.unionByName(m.limit(20))  # repeated candidates
    got = sc.spaced_anchors(some, interval, writer(spark, "spaced"), width)
    assert "MapInArrow" not in plan(got) and "Python" not in plan(got)
    want = pr.spaced_anchors(m, interval)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 6


def test_a_long_session_runs_in_many_tasks(spark):
    """Two million messages of one session: no task gets more than some buckets of it."""
    n = 2_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        m = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") % 1000 == 1, "user").otherwise("assistant").alias("role"), (F.col("id") % 3 == 0).alias("step_start"))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        done = sc.prefix_scan(m, sums={"turn": F.col("step_start").cast("long")}, lasts={"user": F.when(F.col("role") == "user", F.col("seq"))})
        checks = done.agg(F.count("*"), F.sum((F.col("turn") != F.floor(F.col("seq") / 3)).cast("int")), F.sum((F.col("user") != F.floor((F.col("seq") - 1) / 1000) * 1000 + 1).cast("int"))).first()
        assert tuple(checks) == (n, 0, 0)
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) >= 8 and max(sizes) < n / 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_ranges_meet_points_by_bins(spark, width):
    rng = random.Random(4)
    ranges = [(rng.randint(1, 4), k, a, a + rng.randint(-3, 60)) for k in range(60) for a in [rng.randint(-20, 200)]]
    points = [(rng.randint(1, 5), rng.randint(-20, 260)) for _ in range(300)]
    r = spark.createDataFrame(ranges, "session_id long, cmd long, start_seq long, end_seq long")
    p = spark.createDataFrame(points, "session_id long, seq long")
    out = cp.in_ranges(r, p, "seq", width)
    got = sorted((x["session_id"], x["cmd"], x["seq"]) for x in out.collect())
    assert got == sorted((s, k, x) for s, k, a, b in ranges for t, x in points if s == t and a <= x <= b)
    assert "_bin" in plan(out.hint("shuffle_hash")) and out.columns == ["session_id", "cmd", "start_seq", "end_seq", "seq"]
    text = plan(out)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and all("_bin" in line for line in text.splitlines() if "Join" in line)
