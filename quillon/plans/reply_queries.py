"""Queries over replies to commands, references, times and lookups, and their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import blocks as bl
from quillon.operators import derive as dv
from quillon.operators import labels as lb
from quillon.operators import parts as pt
from quillon.operators import render as rd
from quillon.operators import reports as rp
from quillon.operators import strategies as st
from quillon.plans import history_oracles as ho
from quillon.plans import oracles as oc
from quillon.plans.history_queries import hidden
from quillon.sources import history as hs
from quillon.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def known(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return known


@query("SELECT user_id AS session_id, CAST(floor(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) + 0.5) AS BIGINT) AS failed, CAST(floor(100.0 * count(*) FILTER (WHERE event_type = 'click') / count(*) + 0.5) AS BIGINT) AS asked FROM events GROUP BY 1")
def whole_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-9: of each session's messages, how many failed and how many are the user's."""
    e = tb.read(spark, sf_dir, "events")
    share = lambda kind: lb.percent(F.count(F.when(F.col("event_type") == kind, 1)), F.count("*"))
    return e.groupBy(F.col("user_id").alias("session_id")).agg(share("error").alias("failed"), share("click").alias("asked"))


@query(
    """SELECT event_id AS message_id, CASE WHEN n BETWEEN 1 AND 9999 THEN '<mid>m' || lpad(CAST(n AS VARCHAR), 4, '0') || '</mid>' END AS tag, CASE WHEN n >= 1 THEN '(b' || n || ')' END AS marker
    FROM (SELECT event_id, event_id * 7 - 50 AS n FROM events)"""
)
def reference_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2: tags and markers of numbers, also of those that have none."""
    n = F.col("message_id") * 7 - 50
    return hs.messages(spark, sf_dir).select("message_id", tx.ref_tag(tx.message_ref(n), "mid").alias("tag"), tx.block_marker(n).alias("marker"))


@query(ho.with_() + "SELECT message_id, strftime(make_timestamp(created * 1000), '%Y-%m-%dT%H:%M:%S') AS made, CASE WHEN completed <> 0 THEN strftime(make_timestamp(completed * 1000), '%Y-%m-%dT%H:%M:%S') END AS done FROM msgs")
def message_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-16: when messages were made and done, as ISO text."""
    return hs.messages(spark, sf_dir).select("message_id", tx.iso_time(F.col("created")).alias("made"), tx.iso_time(F.col("completed")).alias("done"))


@query(
    """SELECT doc_id, md5(CASE WHEN len(lines) > 4 THEN array_to_string(lines[1:3], chr(10)) || chr(10) || '... and ' || (len(lines) - 3) || ' more' ELSE text END) AS first,
        md5(CASE WHEN instr(text, chr(10)) > 0 AND length(substr(text, instr(text, chr(10)))) > 200 THEN substr(text, 1, instr(text, chr(10)) + 196) || '...' ELSE text END) AS section
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)"""
)
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: the first lines of texts, and texts whose part from the first line break on is cut."""
    text = F.col("text")
    return tb.read(spark, sf_dir, "documents").select("doc_id", F.md5(lb.first_lines(text, 4)).alias("first"), F.md5(lb.short_section(text, "\n", 200)).alias("section"))


@query(
    ho.with_()
    + """SELECT session_id, seq, 'm' || lpad(CAST(least(5, n) + row_number() OVER (PARTITION BY session_id ORDER BY seq) AS VARCHAR), 4, '0') AS ref
    FROM (SELECT session_id, seq, count(*) OVER (PARTITION BY session_id) AS n FROM msgs) WHERE seq > 7"""
)
def allocated_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2: references of what comes after a session's seventh message, the first five having theirs."""
    m = hs.messages(spark, sf_dir)
    return dv.allocate_refs(m.filter("seq > 7").select("session_id", "seq"), dv.message_refs(m.filter("seq <= 5")))


def _tokens_said(n: str) -> str:
    tenths = f"CAST(floor({n} / 1e2 + 0.5e0) AS BIGINT)"
    return f"CASE WHEN {n} >= 1000 THEN ({tenths} // 10) || CASE WHEN {tenths} % 10 = 0 THEN '' ELSE '.' || ({tenths} % 10) END || 'K' ELSE CAST({n} AS VARCHAR) END"


def _part_said(column: str, label: str, mark: str) -> str:
    share = f"(CASE WHEN total > 0 THEN CAST({column} AS DOUBLE) / total ELSE 0.0 END)"
    shown = rf"regexp_replace(printf('%.1f', {share} * 100e0), '(\d)(\d\d\d)\.', '\1,\2.')"
    return f"'{label:<10}' || lpad({shown}, 5, ' ') || '% │' || rpad(repeat('{mark}', CAST(floor({share} * 30 + 0.5e0) AS BIGINT)), 30, ' ') || '│ ' || {_tokens_said(column)}"


@query(
    f"""SELECT session_id, md5(concat_ws(chr(10), {", ".join(_part_said(n, n.removesuffix("_tokens"), mark) for n, mark in rd.MARKS)},
        CASE WHEN tools_pruned > 0 THEN 'pruned: ' || tools_pruned || ' calls, ' || messages_pruned || ' messages (' || {_tokens_said("(tools_pruned * 100)")} || ')' END,
        'context: ' || {_tokens_said("total")}, CASE WHEN tools_pruned > 0 THEN 'without pruning: ' || {_tokens_said("(total + tools_pruned * 100)")} END)) AS reply
    FROM ({ho.ORACLE_SQL["context_breakdown"]})"""
)
def context_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDG-12: the reply that shows how a session's context divides, a hundred tokens taken to be saved by each pruned call."""
    m = hs.history(spark, sf_dir)
    found = pt.breakdown(pt.with_compaction(m, hidden(m)), st.deduplicate(pt.tool_calls(pt.with_compaction(m))), hidden(m))
    return rd.context_reply(found, F.col("tools_pruned") * 100).select("session_id", F.md5("reply").alias("reply"))


WANTED = ["17", "none", "4", "9000", "23", "5001", "17"]


@query(
    ho.with_(
        "newest AS (SELECT session_id FROM msgs GROUP BY 1 ORDER BY max(created) DESC, session_id DESC LIMIT 40)",
        f"wanted AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(WANTED))}) AS t(pos, id))",
        "held AS (SELECT CAST(message_id AS VARCHAR) AS id, session_id, role, (SELECT count(*) FROM parts p WHERE p.message_id = msgs.message_id) AS n_parts FROM msgs WHERE session_id IN (SELECT session_id FROM newest))",
    )
    + "SELECT pos, id, session_id, role, n_parts, CASE WHEN session_id IS NULL THEN 'message_not_found' END AS error FROM wanted LEFT JOIN held USING (id)"
)
def found_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-8, PRD-21, SRC-6: messages looked up by id among the forty newest sessions, with the number of their parts."""
    m = hs.history(spark, sf_dir).withColumn("message_id", F.col("message_id").cast("string"))
    sessions = hs.messages(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(F.max("created").alias("time_updated"))
    out = rp.find_messages(WANTED, m, sessions, 40)
    return out.select("pos", "id", "session_id", "role", F.when(F.col("session_id").isNotNull(), F.size("parts").cast("long")).alias("n_parts"), "error")


@query(
    oc.with_(oc.CALLS, oc.BLOCKS, oc.ACTIVE)
    + f"""SELECT session_id, string_agg('b' || block_id || ': part ' || block_id || ' (' || {_tokens_said("compressed_tokens")} || ')', chr(10) ORDER BY block_id) AS reply FROM active WHERE active GROUP BY 1"""
)
def block_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-22: the active blocks that a command can name, as the reply says them."""
    b = bl.activity(tb.blocks(tb.calls(spark, sf_dir))).filter("active")
    return rd.blocks_reply(b.withColumn("topic", F.concat(F.lit("part "), F.col("block_id").cast("string"))))
