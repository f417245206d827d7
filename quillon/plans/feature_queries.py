"""Queries over stored states, long sessions, streams and the table function, and their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import compact_table as ct
from quillon.operators import blocks as bl
from quillon.operators import compact as cp
from quillon.operators import nudges as nd
from quillon.operators import parts as pt
from quillon.operators import resume as rs
from quillon.operators import scans as sc
from quillon.plans import context as cx
from quillon.plans.history_oracles import with_
from quillon.plans.history_queries import anchors, refs, stored_blocks
from quillon.sources import history as hs
from quillon.sources import states as ss
from quillon.sources import tables as tb
from quillon.sources.scratch import folder, writer
from quillon.sources.state_store import StateStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def known(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return known


def _saved(m: DataFrame) -> DataFrame:
    """States taken to be saved: of three sessions in four, with every 13th call pruned; a third of them know an old compaction, a third none."""
    calls = m.select("session_id", F.explode(pt.of_type("tool")).alias("p")).filter("p.call_id is not null").select("session_id", "p.call_id")
    some = calls.filter(F.pmod(F.substring("call_id", 2, 12).cast("long"), F.lit(13)) == 0).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("call_id", F.lit(7).cast("long").alias("n")))).alias("tools"))
    own = m.select("session_id").distinct().join(some, "session_id", "left").filter(F.pmod("session_id", F.lit(4)) > 0)
    none = F.array().cast("array<string>")
    messages = F.from_json(F.lit('{"byMessageId":{"x":{"tokenCount":1}},"blocksById":{},"activeBlockIds":[],"activeByAnchorMessageId":{},"nextBlockId":1}'), ss.MESSAGES)
    tools = F.coalesce("tools", F.create_map().cast("map<string,bigint>"))
    old = F.when(F.pmod("session_id", F.lit(3)) == 0, F.lit(1)).when(F.pmod("session_id", F.lit(3)) == 1, F.lit(4_000_000_000_000)).cast("long")
    return own.select(
        F.col("session_id").cast("string").alias("sessionId"), F.lit(None).cast("string").alias("sessionName"), F.struct(tools.alias("tools"), messages.alias("messages")).alias("prune"),
        F.struct(none.alias("contextLimitAnchors"), F.array(F.lit("old")).alias("turnNudgeAnchors"), none.alias("iterationNudgeAnchors")).alias("nudges"),
        F.struct(F.lit(0).cast("long").alias("pruneTokenCounter"), F.size(tools).cast("long").alias("totalPruneTokens")).alias("stats"), F.lit(None).cast("string").alias("lastUpdated"), old.alias("lastCompaction"),
    )


def _store(spark: SparkSession, m: DataFrame) -> DataFrame:
    """The saved states, once through a store: all of them, then those of every second session again."""
    store, states = StateStore(spark, f"{folder(spark, 'states')}/store", 8), _saved(m)
    store.save(states)
    store.save(states.filter(F.pmod(F.col("sessionId").cast("long"), F.lit(2)) == 0))
    return store.load()


SAVED = """
    gone AS (SELECT session_id, call_id FROM parts WHERE type = 'tool' AND call_id IS NOT NULL AND CAST(substr(call_id, 2) AS BIGINT) % 13 = 0 AND session_id % 4 > 0),
    saved AS (SELECT s.session_id, count(g.call_id) AS tools FROM (SELECT DISTINCT session_id FROM msgs WHERE session_id % 4 > 0) s LEFT JOIN gone g USING (session_id) GROUP BY 1)"""


@query(
    with_(
        SAVED, "kept AS (SELECT *, max(seq) FILTER (WHERE role = 'assistant' AND compressed) OVER (PARTITION BY session_id) AS behind FROM m)",
        "walk AS (SELECT *, lead(role) OVER w AS next_role, lead(message_id) OVER w AS next_id FROM kept WHERE NOT ignored AND seq > coalesce(behind, -1) WINDOW w AS (PARTITION BY session_id ORDER BY seq))",
        "ends AS (SELECT session_id, message_id AS id FROM walk WHERE role = 'assistant' AND next_role = 'user' UNION SELECT session_id, next_id FROM walk WHERE role = 'assistant' AND next_role = 'user')",
        "counted AS (SELECT session_id, count(*) AS n FROM ends GROUP BY 1)",
        "real AS (SELECT session_id, max(last_compaction) AS last_compaction, bool_or(role = 'user' AND NOT ignored) AS any_user FROM m GROUP BY 1)",
        "steps AS (SELECT session_id, count(*) FILTER (WHERE type = 'step-start') AS turn FROM started GROUP BY 1)",
        """j AS (SELECT r.session_id, r.last_compaction, s.tools IS NULL AS is_new, s.tools IS NOT NULL AND r.last_compaction > CASE r.session_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4000000000000 ELSE r.last_compaction END AS cleared, s.tools, coalesce(c.n, 0) AS n, coalesce(t.turn, 0) AS turn
            FROM real r LEFT JOIN saved s USING (session_id) LEFT JOIN counted c USING (session_id) LEFT JOIN steps t USING (session_id) WHERE any_user)""",
    )
    + "SELECT CAST(session_id AS VARCHAR) AS session_id, is_new, cleared, turn, CASE WHEN is_new OR cleared THEN 0 ELSE tools END AS n_tools, CASE WHEN cleared THEN 0 WHEN is_new THEN n ELSE n + 1 END AS n_anchors, last_compaction FROM j"
)
def resumed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRN-17, SRC-11, SNK-1: what each session goes on with, from a store of states."""
    m = hs.history(spark, sf_dir)
    out = rs.resume(_store(spark, m), m)
    n = lambda c: F.size(c).cast("long")
    return out.select(F.col("sessionId").alias("session_id"), "is_new", "cleared", "turn", n(F.map_keys("prune.tools")).alias("n_tools"), n("nudges.turnNudgeAnchors").alias("n_anchors"), F.col("lastCompaction").alias("last_compaction"))


@query(with_(SAVED) + "SELECT CAST(sum(tools) AS BIGINT) AS tokens, CAST(sum(tools) AS BIGINT) AS tools, count(*) AS messages, count(*) AS sessions FROM saved WHERE tools > 0")
def saved_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9 over a store of states."""
    return ss.statistics(_store(spark, hs.history(spark, sf_dir)))


@query(with_(SAVED) + "SELECT CAST(session_id AS VARCHAR) AS session_id, call_id, 7 AS token_count FROM gone")
def saved_pruned_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRN-18 over a store of states."""
    return ss.pruned_tools(_store(spark, hs.history(spark, sf_dir)))


@query(
    """SELECT session_id, call_id, CAST(sum(CAST(step_start AS INT)) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn
    FROM (SELECT user_id AS session_id, event_id AS call_id, event_type = 'click' AS step_start, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""
)
def scanned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4 by a prefix scan over buckets."""
    return sc.turns(tb.calls(spark, sf_dir), 16).select("session_id", "call_id", "turn")


@query(
    with_()
    + """SELECT session_id, seq, coalesce(last_value(CASE WHEN role = 'user' AND NOT ignored THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS last_user_seq,
        count(*) FILTER (WHERE NOT ignored) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM m"""
)
def scanned_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7, WIN-8 by a prefix scan over buckets."""
    m = hs.history(spark, sf_dir).select("session_id", "seq", "role", pt.ignored_user().alias("ignored"))
    return sc.last_user(m, 16)


@query(
    with_().replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """, third AS (SELECT session_id, seq FROM msgs WHERE message_id % 3 = 0),
    walk AS (
        SELECT session_id, min(seq) AS seq FROM third GROUP BY 1
        UNION ALL SELECT w.session_id, (SELECT min(s.seq) FROM third s WHERE s.session_id = w.session_id AND s.seq >= w.seq + 4) FROM walk w WHERE EXISTS (SELECT 1 FROM third s WHERE s.session_id = w.session_id AND s.seq >= w.seq + 4)
    ) SELECT * FROM walk"""
)
def pointed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10 by doubled pointers: every third message, four apart."""
    m = hs.messages(spark, sf_dir).filter(F.pmod("message_id", F.lit(3)) == 0)
    return sc.spaced_anchors(m, 4, writer(spark, "pointed"), 16)


@query(
    """WITH calls AS (SELECT user_id AS session_id, event_id AS call_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
    b AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS block_id FROM calls WHERE event_type = 'signup'),
    r AS (SELECT session_id, call_id AS cmd, seq - 20 AS a, seq AS z FROM calls WHERE call_id % 7 = 0)
    SELECT r.session_id, cmd, string_agg(block_id, ',' ORDER BY b.seq) AS required FROM r JOIN b ON b.session_id = r.session_id AND b.seq BETWEEN a AND z GROUP BY 1, 2"""
)
def blocks_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-6, JOIN-5 by an interval join: the blocks that the twenty calls before every seventh one hold."""
    c = tb.calls(spark, sf_dir)
    ranges = c.filter(F.pmod("call_id", F.lit(7)) == 0).select("session_id", F.col("call_id").alias("cmd"), (F.col("seq") - 20).alias("start_seq"), F.col("seq").alias("end_seq"), F.lit(None).cast("string").alias("issues"))
    out = cp.required_blocks(ranges, tb.blocks(c).select("session_id", "block_id", "anchor_seq"))
    return out.select("session_id", "cmd", F.array_join(F.col("required").cast("array<string>"), ",").alias("required"))


STORED = """
    framed AS (SELECT session_id, seq, message_id, list(message_id) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ids FROM msgs),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS block_id FROM framed WHERE message_id % 23 = 0),
    valid AS (SELECT *, CASE WHEN block_id % 3 = 0 THEN block_id - 1 END AS eats FROM numbered WHERE message_id % 7 > 0 AND message_id % 11 > 0),
    active AS (SELECT * FROM valid v WHERE NOT EXISTS (SELECT 1 FROM valid e WHERE e.session_id = v.session_id AND e.eats = v.block_id))"""


@query(with_(STORED) + "SELECT DISTINCT session_id, unnest(ids) AS message_id FROM active")
def messages_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-8, CMP-9: the messages that saved blocks cover now."""
    m = hs.history(spark, sf_dir)
    return cx.in_force(stored_blocks(m), m)[0]


@query(
    with_(STORED, "per AS (SELECT session_id, count(*) AS n, string_agg('b' || block_id, ', ' ORDER BY block_id) AS names FROM active GROUP BY 1)")
    + "SELECT s.session_id, '<note>compress now' || chr(10) || chr(10) || 'Blocks in force: ' || coalesce(n, 0) || ' (' || coalesce(names, 'none') || ')' || chr(10) || '</note>' AS context, '[compress soon]' AS iteration FROM (SELECT DISTINCT session_id FROM msgs) s LEFT JOIN per USING (session_id)"
)
def guided_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDG-5, NDG-6: the hints of each session, with guidance on its blocks in force."""
    m = hs.history(spark, sf_dir)
    origin = m.select("session_id", F.col("message_id").cast("string").alias("compress_message_id"), F.lit(True).alias("origin_present"))
    b = bl.activity(stored_blocks(m).join(origin, ["session_id", "compress_message_id"], "left").na.fill(False, ["origin_present"])).filter("active")
    whole, texts = cx.hints(m.select("session_id").distinct(), b, cx.Wording())
    return whole.select("session_id", texts["context"].alias("context"), texts["iteration"].alias("iteration"))


@query(
    with_()
    + """SELECT DISTINCT session_id, seq, kind FROM (SELECT session_id, seq, 'context' AS kind FROM m WHERE message_id % 8 = 0 AND seq % 5 = 0 UNION ALL SELECT session_id, seq, 'turn' FROM m WHERE message_id % 9 = 0 AND seq % 5 = 0
        UNION ALL SELECT session_id, seq, 'iteration' FROM m WHERE message_id % 10 = 0 AND seq % 5 = 0 UNION ALL SELECT session_id, max(seq), 'turn' FROM m WHERE NOT ignored GROUP BY 1)"""
)
def kept_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-7: stored anchors and new ones, each once."""
    m = hs.history(spark, sf_dir)
    return nd.merged_anchors(anchors(m).filter(F.pmod("seq", F.lit(5)) == 0), pt.last_message(m).select("session_id", "seq", F.lit("turn").alias("kind")))


@query("SELECT event_id AS call_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 AND event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS block_id FROM events")
def block_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-21: what arguments of commands name: bN, N, or nothing."""
    c = tb.calls(spark, sf_dir)
    kind = F.pmod("call_id", F.lit(3))
    said = F.when(kind == 0, F.concat(F.lit(" B"), "path")).when(kind == 1, F.col("path")).otherwise(F.concat(F.lit("c"), "path"))
    return c.select("call_id", bl.block_number(said).alias("block_id"))


@query()
def compacted_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT: the blocks of three commands for each session, by the table function in SQL."""
    m = hs.history(spark, sf_dir)
    steps = [(1, "first", "m0002", "m0004", "part one"), (2, "second", "b1", "m0006", "then"), (3, "third", "m0008", "m0009", "last")]
    rows = spark.createDataFrame(steps, "cmd long, topic string, start_id string, end_id string, summary string")
    told = m.select("session_id").distinct().crossJoin(F.broadcast(rows))
    ct.register(spark)
    table = cp.compaction_rows(told, cp.messages_with_parts(m, refs(m)))
    return spark.sql("SELECT session_id, block_id, start_seq, end_seq, anchor_seq, active, n_messages, compressed_tokens FROM compact_sessions(TABLE({rows}))", rows=table)

