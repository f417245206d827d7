"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import blocks as bl
from quillon.operators import compact as cp
from quillon.operators import derive as dv
from quillon.operators import nudges as nd
from quillon.operators import parts as pt
from quillon.operators import permissions as pm
from quillon.operators import pressure as pr
from quillon.operators import reports as rp
from quillon.operators import rewrite as rw
from quillon.operators import strategies as st
from quillon.plans import history_queries
from quillon.sources import history as hs
from quillon.sources import tables as tb
from quillon.sources.scratch import writer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COMPRESS = ["compress"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _simple(name: str, make: Callable[[DataFrame], DataFrame], source: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(source(spark, sf_dir))


for _name, _make in {
    "distance_since_compress": lambda c: rp.distances(c, COMPRESS).select("session_id", "seq", "distance"),
    "turn_counts": dv.turn_counts,
    "call_turns": lambda c: dv.turns(c).select("session_id", "call_id", "turn"),
    "dedup_calls": st.deduplicate,
    "purge_errors": st.purge_errors,
    "supersede_writes": st.supersede_writes,
    "eligible_calls": lambda c: st.eligible_calls(c, 2).select("session_id", "call_id", "turn"),
    "sweep_last_n": lambda c: st.sweep_last(c, 5, st.deduplicate(c), COMPRESS),
    "block_activity": lambda c: bl.activity(tb.blocks(c)).select("session_id", "block_id", "active"),
    "block_anchor_owners": lambda c: bl.anchor_owners(tb.blocks(c)),
    "block_guidance": lambda c: pr.block_guidance(bl.activity(tb.blocks(c)).filter("active")),
    "recompressible_blocks": lambda c: bl.recompressible(tb.blocks(c)).select("session_id", "block_id"),
}.items():
    _simple(_name, _make, tb.calls)


@query
def block_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.ancestors(tb.blocks(tb.calls(spark, sf_dir)), writer(spark, "ancestors"))


@query
def over_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.over_limits(pt.current_tokens(hs.history(spark, sf_dir)), F.lit(200), pr.resolved_limit(F.lit("25%"), F.lit(400)))


@query
def decompress_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tb.blocks(tb.calls(spark, sf_dir))
    newest = bl.activity(b).filter("active").groupBy("session_id").agg(F.max("block_id").alias("block_id"))
    return bl.activity_diff(b, bl.decompress(b, newest))


@query
def recompress_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tb.blocks(tb.calls(spark, sf_dir))
    return bl.activity_diff(b, bl.recompress(b, bl.recompressible(b)))


for _name, _make in {
    "message_refs": dv.message_refs,
    "last_user_message": dv.last_user,
    "turn_anchors": pr.turn_anchors,
    "iteration_anchors": lambda m: pr.iteration_anchors(m, 1, 3),
}.items():
    _simple(_name, _make, tb.messages)


@query
def scrub_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tb.messages(spark, sf_dir)
    tagged = m.withColumn("text", F.concat(F.lit("<note a=1>x\ny</note>"), F.col("text"), F.lit("<mid>m0001</mid>")))
    return rw.scrub_messages(tagged, "note", "mid").select("session_id", "seq", tx.token_count(F.col("text")).alias("tokens"), F.md5("text").alias("digest"))


@query
def inject_message_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tb.messages(spark, sf_dir)
    return pr.inject_refs(m, dv.message_refs(m), "mid").select("session_id", "seq", F.md5("text").alias("digest"))


@query
def inject_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tb.messages(spark, sf_dir)
    return pr.inject_text(m, pr.turn_anchors(m), "[compress soon]").select("session_id", "seq", F.md5("text").alias("digest"))


@query
def strip_stale_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tb.messages(spark, sf_dir).withColumn("model", F.concat(F.lit("model-"), F.pmod("seq", F.lit(4)).cast("string"))).withColumn("metadata", F.col("role"))
    return rw.strip_stale_metadata(m).select("session_id", "seq", "metadata")


@query
def recent_sessions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.list_sessions(tb.sessions(spark, sf_dir), limit=10).select("id", "directory", "time_updated")


@query
def session_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.list_sessions(tb.sessions(spark, sf_dir), roots=True, start=5, search="the", limit=20).select("id", "parent_id", "title")


@query
def session_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.search_sessions(tb.sessions(spark, sf_dir), "THE AND").select("id", "title")


@query
def sessions_last_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.last_used(tb.sessions(spark, sf_dir))


@query
def message_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, 3, 1), (1, 10**9, 0), (2, 1, 0)], "pos int, session_id long, seq long")
    return rp.lookup_messages(wanted, tb.messages(spark, sf_dir))


@query
def sessions_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.joined(spark, sf_dir).select("session_id", "message_id", "role", F.size("parts").cast("long").alias("n_parts"))


@query
def glob_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tb.read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", F.lit("^https?://"), F.lit("")).alias("path"))
    return paths.select("page_id", tx.path_protected(F.array("path"), ["**/*1", "*/p?", "**/a/**"]).alias("protected"))


RULES = pm.flatten_rules({"*": "ask", "read": {"*": "allow"}}, {"write": {"src*": "deny"}, "b?sh": {"*1*": "deny"}, "none": {"*": "perhaps"}}, {"read": {"*7": "deny"}})


@query
def permission_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tb.calls(spark, sf_dir).select(F.col("call_id").alias("request_id"), F.col("tool").alias("permission"), F.concat(F.lit("src/"), F.col("path")).alias("target"))
    return asked.select("request_id", pm.last_match(F.col("permission"), F.col("target"), RULES).alias("said")).select("request_id", "said.pattern", "said.action")


@query
def agent_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = nd.current_model(hs.history(spark, sf_dir))
    rules = {"agent-1": {"*": "deny"}, "agent-0": {"*": "deny", "compress": {"*": "allow"}}}
    return last.select("session_id", pm.effective_by_agent(F.col("agent"), "ask", "compress", {"read": "allow"}, rules).alias("permission"))


@query
def tool_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.calls(spark, sf_dir)
    return c.select("call_id", tx.signature(F.col("tool"), F.col("parameters")).alias("signature"))


@query
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.messages(spark, sf_dir).select("session_id", "seq", tx.stable_id("msg_", F.concat_ws(":", F.col("session_id").cast("string"), F.col("seq").cast("string"))).alias("id"))


@query
def formatted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.calls(spark, sf_dir)
    ms = F.col("input") * F.lit(1000) * (F.col("cache_read") + 1)
    return c.select("call_id", tx.format_tokens(F.col("input") * 37).alias("tokens"), tx.format_duration(ms).alias("duration"), F.length(tx.bar(F.col("input"), F.lit(500), 20)).cast("long").alias("bar"))


@query
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tb.messages(spark, sf_dir)
    return m.select("session_id", "seq", tx.token_count(F.col("text")).alias("tokens"), F.md5(tx.truncate(F.col("text"), 40)).alias("short"))


def _one_range(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = tb.messages(spark, sf_dir)
    cmds = m.select("session_id").distinct().select("session_id", F.lit(1).cast("long").alias("cmd"), F.lit("m0002").alias("start_id"), F.lit(" M0003").alias("end_id"))
    none = spark.createDataFrame([], "session_id long, block_id long, anchor_seq long")
    return m, cp.resolve_ranges(cmds, dv.message_refs(m), none)


@query
def range_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_range(spark, sf_dir)[1]


@query
def range_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, ranges = _one_range(spark, sf_dir)
    summaries = ranges.filter("issues is null").select("session_id", F.col("start_seq").alias("anchor_seq"), F.lit("summary").alias("summary"))
    return rw.collapse_ranges(m, cp.range_messages(ranges, m), summaries).select("session_id", "seq", "rank", "role")


@query
def compressed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, ranges = _one_range(spark, sf_dir)
    return cp.range_messages(ranges, m).groupBy("session_id").agg(F.sum("token_count").alias("compressed_tokens"), F.count("*").alias("n_messages"))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [(1, "one", "m0001", "m0002", "first part"), (2, "two", "b1", "m0003", "second (b1) part (b1) (b9)"), (3, "three", "m0004", "m0004", "third"), (4, "four", "b2", "b3", "all of it {block_2}")]
    return tb.messages(spark, sf_dir).select("session_id").distinct().crossJoin(F.broadcast(spark.createDataFrame(steps, "cmd long, topic string, start_id string, end_id string, summary string")))


def _nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = tb.messages(spark, sf_dir)
    rows = cp.plain_messages(m, dv.message_refs(m))
    return cp.compact(_commands(spark, sf_dir), rows), rows


@query
def nested_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.array_join(F.col("consumed").cast("array<string>"), ",").alias("consumed")
    return _nested(spark, sf_dir)[0].select("session_id", "block_id", "start_seq", "end_seq", "active", plain, "summary", "n_messages", "compressed_tokens")


@query
def effective_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.effective_ids(_nested(spark, sf_dir)[0])


@query
def covered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cp.covered_messages(*_nested(spark, sf_dir))
    listed = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("all_blocks", "active_blocks")]
    return out.select("session_id", "seq", *listed, "tokens")


@query
def placeholder_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir)[0].select("session_id", "block_id", "summary", F.size("consumed").cast("long").alias("n_consumed"), F.size("missing").cast("long").alias("n_missing"))


@query
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.calls(spark, sf_dir)
    gone = st.deduplicate(c).select("session_id", "call_id").union(st.purge_errors(c).select("session_id", "call_id")).distinct()
    active = bl.activity(tb.blocks(c)).filter("active").groupBy("session_id").agg(F.count("*").alias("active_blocks"), F.sum("compressed_tokens").alias("block_tokens"))
    per = gone.groupBy("session_id").agg(F.countDistinct("call_id").alias("pruned_calls"))
    both = per.join(active, "session_id", "full").na.fill(0)
    return both.agg(F.count("*").alias("sessions"), F.sum("pruned_calls").alias("pruned_calls"), F.sum("active_blocks").alias("active_blocks"), F.sum("block_tokens").alias("block_tokens"))


QUERIES |= history_queries.QUERIES
