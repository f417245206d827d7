"""Derived columns of sessions: turns, references, last messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def together(rows: DataFrame, key: str) -> DataFrame:
    """The rows with all of a key in one partition.

    They are dealt by a hash of the key: a shuffle by the key itself is left out
    where the rows (a union, a join) are said to lie by it already, and adaptive
    execution then may still move them apart, as a Python function states no need.
    """
    return rows.repartition(F.xxhash64(key))


def ignored(parts: Column) -> Column:
    """PRD-4: all parts ignored, or none there."""
    return F.forall(parts, lambda p: p["ignored"])


def ignored_text(parts: Column) -> Column:
    """PRD-5: no parts at all; or some text parts, all of them ignored."""
    texts = F.filter(parts, lambda p: p["type"] == "text")
    return (F.size(parts) == 0) | ((F.size(texts) > 0) & F.forall(texts, lambda p: p["ignored"]))


def last_compaction(messages: DataFrame) -> DataFrame:
    """AGG-16: created of the positionally last summary message of a session, else 0."""
    is_summary = (F.col("role") == "assistant") & F.col("summary")
    return messages.groupBy("session_id").agg(F.coalesce(F.max_by(F.when(is_summary, F.col("created")), F.when(is_summary, F.col("seq"))), F.lit(0)).alias("last_compaction"))


def turns(calls: DataFrame) -> DataFrame:
    """WIN-4: adds turn, the step starts before and at a call."""
    run = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return calls.withColumn("turn", F.sum(F.col("step_start").cast("long")).over(run))


def turn_counts(calls: DataFrame) -> DataFrame:
    """AGG-13: step starts of a session."""
    return calls.groupBy("session_id").agg(F.sum(F.col("step_start").cast("long")).alias("turns"))


def message_refs(messages: DataFrame, subagent: Column | None = None, most: int = 9999) -> DataFrame:
    """WIN-1: m0001 and so on in message order, without system messages and a subagent's first user message; beyond ``most`` is an error."""
    subagent = F.lit(False) if subagent is None else subagent
    first = F.min(F.when(F.col("role") == "user", F.col("seq"))).over(W.partitionBy("session_id"))
    m = messages.withColumn("skip", (subagent & F.col("seq").eqNullSafe(first)) | ~F.col("role").isin("user", "assistant"))
    n = F.row_number().over(W.partitionBy("session_id").orderBy("seq"))
    safe = F.when(n <= most, n).otherwise(F.raise_error(F.lit("too many messages for references")).cast("int"))
    return m.filter("not skip").select("session_id", "seq", F.concat(F.lit("m"), F.lpad(safe.cast("string"), 4, "0")).alias("ref"))


def allocate_refs(new: DataFrame, taken: DataFrame, most: int = 9999) -> DataFrame:
    """WIN-2: references for new messages after the highest one taken; beyond ``most`` is an error."""
    top = taken.groupBy("session_id").agg(F.max(F.substring("ref", 2, 4).cast("int")).alias("top"))
    n = F.row_number().over(W.partitionBy("session_id").orderBy("seq")) + F.coalesce("top", F.lit(0))
    safe = F.when(n <= most, n).otherwise(F.raise_error(F.lit("too many messages for references")).cast("int"))
    return new.join(top, "session_id", "left").select("session_id", "seq", F.concat(F.lit("m"), F.lpad(safe.cast("string"), 4, "0")).alias("ref"))


def last_user(messages: DataFrame) -> DataFrame:
    """WIN-7, WIN-8, WIN-13: for each message the seq of the last user message up to it (-1 without one), and how many messages follow it; ignored ones (where there is such a column) count as neither."""
    shown = ~F.col("ignored") if "ignored" in messages.columns else F.lit(True)
    order = W.partitionBy("session_id").orderBy("seq")
    carried = F.last(F.when((F.col("role") == "user") & shown, F.col("seq")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.count(F.when(shown, 1)).over(order.rowsBetween(1, W.unboundedFollowing))
    return messages.select("session_id", "seq", F.coalesce(carried, F.lit(-1)).alias("last_user_seq"), after.alias("after"))
