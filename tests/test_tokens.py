"""A caller's tokenizer in place of the estimate."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import tokens as tk
from quillon.operators import compact as cp
from quillon.operators import parts as pt

from test_parts import frame, message, part, text, tool


def test_counts_are_remembered_and_bounded():
    asked = []
    c = tk.Counter(lambda texts: asked.extend(texts) or [len(t) for t in texts], 4)
    assert c.counts(["a", None, "bb", "", "a"]) == [1, 0, 2, 0, 1] and asked == ["a", "bb"]
    assert c.counts(["a", "ccc"]) == [1, 3] and asked == ["a", "bb", "ccc"]
    for i in range(100):
        c.counts([f"t{i}"])
    assert len(c.new) + len(c.old) <= 4
    with pytest.raises(ValueError):
        tk.Counter(lambda texts: [], 4).counts(["x"])


def test_one_tokenizer_a_worker(spark):
    def load():
        import os

        return lambda texts: [os.getpid() * 0 + len(t.split()) for t in texts]

    count = tk.tokenizer("one", load)
    df = spark.createDataFrame([("a b",), (None,), ("",), ("x y z",)], "t string").repartition(3)
    assert sorted(r[0] for r in df.select(count(F.col("t"))).collect()) == [0, 0, 2, 3]


def test_operators_take_a_tokenizer(spark):
    count = tk.tokenizer("words", lambda: lambda texts: [len(t.split()) for t in texts])  # a tokenizer of its own: words
    m = frame(
        spark, message(1, "user", text(0, "one two"), text(1, "three")),
        message(2, "assistant", part(0, "step-start"), tool(1, "edit", "c1", given="in put", output="some out put"), tool(2, "read", "c2", given="in", error="it has failed", status="error"), tokens=(20, 5, 0, 3, 0)),
    )
    m = pt.with_compaction(m)
    assert {r["call_id"]: r["token_count"] for r in pt.tool_calls(m, count).collect()} == {"c1": 5, "c2": 3}
    assert {r["seq"]: r["n"] for r in m.select("seq", pt.message_tokens(count=count).alias("n")).collect()} == {1: 3, 2: 8}
    assert {r["call_id"]: r["token_count"] for r in pt.tool_calls(m).collect()} == {"c1": 5, "c2": 3 + 0 * 1}  # 19 and 13 characters, a quarter each
    none = m.filter("false")
    b = pt.breakdown(m, none.select("session_id", F.lit("c").alias("call_id")), none.select("session_id", "message_id"), count).first()
    assert (b["total"], b["system"], b["user"], b["tool_tokens"], b["assistant"]) == (28, 20, 3, 6, 0)
    rows = cp.messages_with_parts(m, m.select("session_id", "seq", F.lit("m0001").alias("ref")), count=count)
    assert {r["seq"]: r["tokens"] for r in rows.collect()} == {1: 3, 2: 8}
    plan = pt.tool_calls(m)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
