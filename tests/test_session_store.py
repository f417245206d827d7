"""The data source over a SQLite store, the writer of one file for each session, and the sink for batches."""

import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.sources import session_store as ss
from quillon.sources.tables import STORE


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "a b?.db")
    db = sqlite3.connect(path)
    rng = random.Random(3)
    for t, schema in STORE.items():
        db.execute(f"CREATE TABLE {t} ({', '.join(c.split()[0] for c in schema.split(', '))})")
    db.executemany("INSERT INTO session VALUES (?, ?, ?, ?, ?, ?, ?)", [(f"s{i}", "p", None if i % 3 else "s0", "/w", f"title {i}", i, i) for i in range(20)])
    db.executemany("INSERT INTO part VALUES (?, ?, ?, ?, ?)", [(f"x{i}", f"m{i // 3}", f"s{rng.randint(0, 19)}", json.dumps({"type": "text", "text": "é" * (i % 5)}), i) for i in range(1000)])
    db.execute("DELETE FROM part WHERE rowid % 7 = 0")
    db.commit()
    return path


CONDITIONS = [
    "session_id = 's3'", "session_id IN ('s1', 's2')", "time_created >= 10 AND time_created < 500", "session_id = 's4' AND time_created > 100", "session_id = 'nobody'", "data IS NOT NULL", "id LIKE 'x9%'", "length(data) > 30", "session_id = 's1' OR time_created < 5", "id = message_id",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_give_the_same_rows(spark, file, condition):
    t = ss.stored_table(spark, file, "part", rows=50)
    want = sqlite3.connect(file).execute(f"SELECT * FROM part WHERE {condition}").fetchall()
    assert sorted(map(tuple, t.filter(condition).collect())) == sorted(want)


def test_filters_reach_the_store(spark, file):
    t = ss.stored_table(spark, file, "part", rows=50)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert " Filter" not in plan(t.filter("session_id = 's3' AND time_created < 400"))
    assert " Filter" in plan(t.filter("length(data) > 30"))
    assert t.rdd.getNumPartitions() > 10 and t.filter("session_id = 's3'").rdd.getNumPartitions() < 4


def test_ranges_limits_and_columns(spark, file):
    n = sqlite3.connect(file).execute("SELECT count(*) FROM part").fetchone()[0]
    for rows in (1, 50, 10_000):
        t = ss.stored_table(spark, file, "part", rows=rows)
        assert t.count() == n == t.select("id").distinct().count()
    assert ss.stored_table(spark, file, "part", limit=7).count() == 7
    assert ss.stored_table(spark, file, "session", columns="id, title").filter("id = 's2'").collect() == [("s2", "title 2")]
    assert ss.stored_table(spark, file, "session").filter("parent_id IS NULL").count() == 13 and ss.stored_table(spark, file, "message").count() == 0
    with pytest.raises(Exception, match="no table"):
        ss.stored_table(spark, file, "nothing")
    with pytest.raises(Exception, match="no store"):
        ss.stored_table(spark, file + "x", "part").count()


def test_a_file_for_each_session(spark, tmp_path):
    ss.register(spark)
    path = str(tmp_path / "files")
    save = lambda rows: spark.createDataFrame(rows, "session_id string, content string").repartition(3).write.format("session_files").mode("append").option("path", path).save()
    save([("a/b", '{"n":1}'), ("c", "one"), (None, "x"), ("d", None)])
    save([("c", "two é")])
    read = lambda: {n: open(f"{path}/{n}", encoding="utf-8").read() for n in os.listdir(path)}
    assert read() == {"a%2Fb.json": '{"n":1}', "c.json": "two é"}
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("c", "x")], "session_id string, content string").write.format("session_files").mode("overwrite").option("path", path).save()


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    ss.register(spark)
    path = str(tmp_path / "files")
    rows = spark.createDataFrame([("a", "old")], "session_id string, content string")
    rows.write.format("session_files").mode("append").option("path", path).save()
    bad = spark.range(20).repartition(4).select(F.concat(F.lit("s"), "id").alias("session_id"), F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise("new").cast("string").alias("content"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("session_files").mode("append").option("path", path).save()
    assert os.listdir(path) == ["a.json"]


def test_a_second_attempt_of_a_task_counts_once(tmp_path):
    import pyarrow as pa

    w = ss.FilesWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"session_id": ["a"], "content": ["x"]})
    w.write(iter([batch]))  # the attempt that was lost
    w.commit([w.write(iter([batch])), None])
    assert os.listdir(tmp_path) == ["a.json"]


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    sink = ss.BatchSink(str(tmp_path / "sink"))
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "n long")
    sink(rows(1, 2), 0)
    sink(rows(1, 2), 0)
    with pytest.raises(Exception, match="lost"):
        sink(rows(3).select(F.raise_error(F.lit("lost")).alias("n")), 1)
    sink(rows(3), 1)
    assert sorted(tuple(r) for r in sink.read(spark).collect()) == [(1, 0), (2, 0), (3, 1)]
    assert sorted(os.listdir(tmp_path / "sink")) == ["batch=0", "batch=1"]


def test_a_stream_restarted_before_its_commit(spark, tmp_path):
    """The sink has batch 0 already when the stream runs it once more."""
    sink, source = ss.BatchSink(str(tmp_path / "sink")), str(tmp_path / "in")
    spark.createDataFrame([(1,), (2,)], "n long").coalesce(1).write.parquet(source)
    for cp in ("a", "b"):  # a checkpoint that was lost: the second one starts again
        q = spark.readStream.schema("n long").parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r["n"] for r in sink.read(spark).collect()) == [1, 2]
