"""Streams with keyed state: every cut into batches, and a restart in between, gives what a batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import compact as cp
from quillon.operators import parts as pt
from quillon.operators import strategies as st
from quillon.streaming import stateful as sf

from test_context import COLUMNS, MESSAGE, PART_FIELDS
from test_context import sessions as random_sessions


@pytest.fixture(autouse=True)
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    sf.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def run(query, source, batches, out, checkpoint):
    """One start of the query for each table in batches; each takes what is new and ends."""
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(source)
        q = query().writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None


@pytest.fixture(scope="module")
def history(spark):
    every, *_ = random_sessions(21, 12)
    return spark.createDataFrame([tuple(r[c] if c != "parts" else [tuple(p[f] for f in PART_FIELDS) for p in r["parts"]] for c in COLUMNS) for rows in every.values() for r in rows], MESSAGE).cache()


def test_decisions_over_restarts(spark, history, tmp_path):
    rows = sf.call_rows(history).cache()
    source = str(tmp_path / "in")
    batches = [rows.filter(c) for c in ("seq <= 5", "seq > 5 and seq <= 9", "seq > 9")]
    read = lambda: sf.decide_calls(spark.readStream.schema(rows.schema).parquet(source))
    run(read, source, batches, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in sf.settled(spark.read.parquet(str(tmp_path / "out"))).collect()}
    calls = pt.tool_calls(pt.with_compaction(history))
    want = {tuple(r) for r in st.deduplicate(calls).collect()}
    assert got == want and len(want) > 5
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "cp"))
    open_ = {(r["key"]["session_id"] if "session_id" in r["key"] else r["key"][0], r["user_map_key"]["sig"]) for r in state.collect()}
    assert len(open_) >= calls.select("session_id", F.sha2(pt_signature(), 256)).distinct().count() > 0


def pt_signature():
    from quillon.functions.text import signature

    return signature(F.col("tool"), F.col("parameters"))


def test_late_calls_and_compaction(spark, tmp_path):
    schema = "session_id long, seq long, part_seq int, created long, kind string, call_id string, sig string, token_count long"
    call = lambda s, n, at, name: (s, n, 1, at, "call", name, "x", 3)
    cut = lambda s, n, at: (s, n, -1, at, "cut", None, None, None)
    batches = [[call(1, 5, 50, "late"), call(2, 1, 10, "old")], [call(1, 3, 30, "early"), call(2, 2, 20, "new"), cut(2, 3, 15)], [call(1, 7, 70, "last"), call(2, 4, 12, "too old"), call(2, 5, 40, "newest"), cut(2, 2, 99)]]
    source = str(tmp_path / "in")
    run(lambda: sf.decide_calls(spark.readStream.schema(schema).parquet(source)), source, [spark.createDataFrame(b, schema) for b in batches], str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["session_id"], r["call_id"], r["by"]) for r in out.filter("kind = 'pruned'").collect()) == [(1, "early", "late"), (1, "late", "last"), (2, "new", "newest"), (2, "old", "new")]
    assert sorted((r["session_id"], r["call_id"]) for r in sf.settled(out).collect()) == [(1, "early"), (1, "late"), (2, "new")]


def test_protected_turns_wait(spark, tmp_path):
    schema = "session_id long, seq long, part_seq int, created long, kind string, call_id string, sig string, token_count long"
    step = lambda n: (1, n, 0, n, "step", None, None, None)
    call = lambda n: (1, n, 1, n, "call", f"c{n}", "x", 1)
    source, seen = str(tmp_path / "in"), []
    for k, batch in enumerate([[step(1), call(1)], [step(2), call(2)], [step(3)], [step(4), call(4)]]):
        run(lambda: sf.decide_calls(spark.readStream.schema(schema).parquet(source), protect_turns=2), source, [spark.createDataFrame(batch, schema)], str(tmp_path / "out"), str(tmp_path / "cp"))
        seen.append(sorted(r["call_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [[], [], ["c1"], ["c1", "c2"]]


COMMANDS = "session_id long, cmd long, topic string, start_id string, end_id string, summary string"


def commands(seed, sessions, n=8):
    """Ranges over messages and blocks, some of them wrong."""
    rng, out = random.Random(seed), []
    for s in sessions:
        for cmd in range(1, n + 1):
            a, b = sorted(rng.sample(range(1, 12), 2))
            start, end = (f"m{a:04}", f"m{b:04}") if rng.random() < 0.7 else (f"b{rng.randint(1, 3)}", f"m{b:04}")
            out.append((s, cmd, f"t{cmd}", start, end, rng.choice(["plain", "with (b1)", "(b2) {block_1}", ""])))
    return out


@pytest.mark.parametrize("cuts", [[(99, 99)], [(6, 0), (99, 3), (99, 8)]])
def test_compaction_in_any_batches(spark, history, tmp_path, cuts):
    refs = history.filter(~pt.ignored_user()).select("session_id", "seq", F.concat(F.lit("m"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("ref"))
    messages = cp.messages_with_parts(history, refs, ["task"]).cache()
    ids = [r[0] for r in history.select("session_id").distinct().collect()]
    told = spark.createDataFrame(commands(2, ids), COMMANDS)
    want = {(r["session_id"], r["block_id"]): r for r in cp.compact(told, messages, keep_user_text=True).collect()}
    m_in, c_in = str(tmp_path / "m"), str(tmp_path / "c")

    def query():
        stream = lambda path, schema: spark.readStream.schema(schema).parquet(path)
        return sf.compact_stream(stream(m_in, messages.schema), stream(c_in, told.schema), keep_user_text=True)

    done = (0, 0)
    for seq, cmd in cuts:
        messages.filter(f"seq > {done[0]} and seq <= {seq}").coalesce(1).write.mode("append").parquet(m_in)
        told.filter(f"cmd > {done[1]} and cmd <= {cmd}").coalesce(1).write.mode("append").parquet(c_in)
        q = query().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        done = (seq, cmd)
    got = {(r["session_id"], r["block_id"]): r for r in sf.blocks_now(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == want and len(want) > 20 and any(r["consumed"] for r in want.values())


def test_compaction_goes_on_from_stored_blocks(spark, history, tmp_path):
    refs = history.filter(~pt.ignored_user()).select("session_id", "seq", F.concat(F.lit("m"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("ref"))
    messages = cp.messages_with_parts(history, refs).cache()
    ids = [r[0] for r in history.select("session_id").distinct().collect()]
    told = spark.createDataFrame(commands(5, ids), COMMANDS)
    want = {(r["session_id"], r["block_id"]): r for r in cp.compact(told, messages).collect()}
    first = cp.compact(told.filter("cmd <= 4"), messages).cache()
    c_in = str(tmp_path / "c")
    told.filter("cmd > 4").coalesce(1).write.parquet(c_in)
    q = sf.compact_stream(None, spark.readStream.schema(told.schema).parquet(c_in), first, messages).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    changed = {(r["session_id"], r["block_id"]): r for r in sf.blocks_now(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert {(r["session_id"], r["block_id"]): r for r in first.collect()} | changed == want


def test_many_commands_cost_what_they_hold():
    """10,000 commands over 100,000 messages, each over ten of them, and every tenth over the nine blocks before it."""
    import time

    def seconds(n):
        s = cp.Session(cp.Wording(), False)
        for i in range(1, 10 * n + 1):
            s.add(i, f"m{i}", 1, False, None, [f"c{i}"], [])
        s.named = lambda ref: int(ref[1:])
        start = time.perf_counter()
        for k in range(n):
            a, b = (10 * (k - 9) + 1, 10 * k + 10) if k % 10 == 9 else (10 * k + 1, 10 * k + 10)
            s.place = lambda name: (int(name), None)
            assert "error" not in s.run(1, k, "t", str(a), str(b), "x")
        assert len(s.anchors) == n // 10 and sum(s.holders.values()) == 10 * n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(10_000) < 25 * max(0.05, seconds(1000))
