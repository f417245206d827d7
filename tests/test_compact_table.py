"""Compaction in SQL gives the blocks of compact."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import compact_table as ct
from quillon.operators import compact as cp
from quillon.operators import parts as pt

from test_context import COLUMNS, MESSAGE, PART_FIELDS
from test_context import sessions as random_sessions
from test_stateful_streams import COMMANDS, commands


def test_sql_gives_the_same_blocks(spark):
    every, *_ = random_sessions(31, 10)
    m = spark.createDataFrame([tuple(r[c] if c != "parts" else [tuple(p[f] for f in PART_FIELDS) for p in r["parts"]] for c in COLUMNS) for rows in every.values() for r in rows], MESSAGE)
    refs = m.filter(~pt.ignored_user()).select("session_id", "seq", F.concat(F.lit("m"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("ref"))
    messages = cp.messages_with_parts(m, refs, ["task"])
    told = spark.createDataFrame(commands(3, every), COMMANDS)
    ct.register(spark)
    cp.compaction_rows(told, messages).createOrReplaceTempView("compaction_rows_")
    for keep, errors in ((False, False), (True, True)):
        got = spark.sql(f"SELECT * FROM compact_sessions(TABLE(compaction_rows_), {keep}, {errors})")
        want = cp.compact(told, messages, keep_user_text=keep, errors=errors)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 5
    joined = spark.sql("SELECT s.session_id, count(b.block_id) AS n FROM (SELECT DISTINCT session_id FROM compaction_rows_) s LEFT JOIN compact_sessions(TABLE(compaction_rows_)) b ON b.session_id = s.session_id GROUP BY 1")
    assert joined.count() == told.select("session_id").distinct().count()


def test_wrong_calls_are_told(spark):
    ct.register(spark)
    with pytest.raises(Exception, match="has no seq"):
        spark.sql("SELECT * FROM compact_sessions(TABLE(SELECT 1 AS session_id))").collect()
    with pytest.raises(Exception, match="true or false"):
        cols = ", ".join(f"NULL AS {c}" for c in ct.NEEDED)
        spark.sql(f"SELECT * FROM compact_sessions(TABLE(SELECT {cols}), 5)").collect()
