"""Reports over sessions and their calls: WIN-6, PRD-15, PRD-16, JOIN-8 (see usage for those over steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distances(steps: DataFrame, tools: list[str]) -> DataFrame:
    """WIN-6: steps since the last call of the tools: null before any, 0 right after; a calling step is measured too."""
    before = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("tool").isin(tools), F.col("seq"))).over(before)
    return steps.withColumn("distance", F.col("seq") - last - 1)


def search_sessions(sessions: DataFrame, term: str, exact: bool = False) -> DataFrame:
    """PRD-15: titles that equal or contain the term, without regard to case, newest first."""
    t = F.lower("title")
    return sessions.filter(t == term.lower() if exact else t.contains(term.lower())).orderBy(F.desc("time_updated"), F.desc("id"))


def last_used(sessions: DataFrame) -> DataFrame:
    """PRD-16: seconds of the last update, else of the creation, else 0."""
    pick = F.coalesce(F.nullif("time_updated", F.lit(0)), F.nullif("time_created", F.lit(0)), F.lit(0))
    return sessions.select("id", (pick / F.lit(1000.0)).alias("last_used"))


def lookup_messages(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """JOIN-8: the wanted messages in the order asked for; missing ones say so."""
    found = wanted.join(messages, ["session_id", "seq"], "left")
    return found.select("pos", "session_id", "seq", "role", F.when(F.col("role").isNull(), "not found").alias("error")).orderBy("pos")


def find_messages(wanted: list[str], messages: DataFrame, sessions: DataFrame, scan: int = 200) -> DataFrame:
    """JOIN-8, PRD-21, SRC-6: the wanted messages with their parts, in the order asked for, from the ``scan`` newest sessions (0: all); missing ones say so."""
    newest = sessions.orderBy(F.desc("time_updated"), F.desc("id"))
    newest = newest.limit(scan) if scan > 0 else newest
    asked = messages.sparkSession.createDataFrame(list(enumerate(wanted)), "pos int, message_id string")
    among = messages.join(newest.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    found = F.broadcast(asked).join(among, "message_id", "inner")  # as many rows as were asked for
    out = asked.join(found.drop("message_id"), "pos", "left")
    return out.select("pos", F.col("message_id").alias("id"), "session_id", "role", "parts", F.when(F.col("session_id").isNull(), "message_not_found").alias("error")).orderBy("pos")
