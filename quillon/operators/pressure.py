"""Context pressure: limits, nudge anchors, and text put at them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.derive import together


def resolved_limit(value: Column, model_limit: Column) -> Column:
    """NDG-2: a number, or a percentage (rounded to a whole one and held to 0..100) of the model's limit; unknown limits give null."""
    percent = F.regexp_extract(value, r"^(-?[0-9.]+)%$", 1)
    share = F.least(F.greatest(F.floor(percent.cast("double") + F.lit(0.5)), F.lit(0)), F.lit(100))
    return F.when(percent != "", F.floor(share / 100 * model_limit + F.lit(0.5)).cast("long")).otherwise(value.cast("long"))


def over_limits(current: DataFrame, most: Column, least: Column) -> DataFrame:
    """NDG-1: above the maximum (unknown: no), at or above the minimum (unknown: yes)."""
    tokens = F.col("current_tokens")
    return current.select("session_id", "current_tokens", F.coalesce(tokens > most, F.lit(False)).alias("over_max"), F.coalesce(tokens >= least, F.lit(True)).alias("over_min"))


def turn_anchors(messages: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """WIN-9: both messages of every assistant message directly followed by a user message.

    after (session_id, from_seq) starts each session behind its last compression.
    """
    m = messages.filter(F.col("role").isin("user", "assistant"))
    if after is not None:
        m = m.join(after, "session_id", "left").filter(F.col("from_seq").isNull() | (F.col("seq") > F.col("from_seq")))
    order = W.partitionBy("session_id").orderBy("seq")
    m = m.withColumn("before", F.lag("role").over(order)).withColumn("next", F.lead("role").over(order))
    hit = ((F.col("role") == "user") & (F.col("before") == "assistant")) | ((F.col("role") == "assistant") & (F.col("next") == "user"))
    return m.filter(hit).select("session_id", "seq", "role")


def spaced_anchors(candidates: DataFrame, interval: int) -> DataFrame:
    """WIN-10: in order, each candidate that is the first or at least ``interval`` behind the last one taken.

    A choice depends on the one before, so the sorted rows of a session are
    read once, in order; what is kept in memory is the last choice.
    """


    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for batch in batches:
            kept = []
            for i, (session, seq) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if i == 0 and now is None or (session,) != now or seq - last >= interval:
                    now, last = (session,), seq
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = candidates.select("session_id", F.col("seq").cast("long").alias("seq"))
    return together(rows, "session_id").sortWithinPartitions("session_id", "seq").mapInArrow(fold, rows.schema)


def iteration_anchors(messages: DataFrame, threshold: int, interval: int) -> DataFrame:
    """NDG-3, WIN-10: messages at least ``threshold`` behind their last user message, thinned to the interval."""
    order = W.partitionBy("session_id").orderBy("seq")
    last = F.last(F.when(F.col("role") == "user", F.col("seq")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    late = messages.withColumn("since", F.col("seq") - last).filter(F.col("since") >= threshold)
    return spaced_anchors(late, interval)


def block_guidance(active: DataFrame) -> DataFrame:
    """NDG-5: how many blocks a session has active, and their names in order."""
    ids = F.sort_array(F.collect_set("block_id"))
    return active.groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("b"), x.cast("string"))), ", ").alias("names"))


def inject_text(messages: DataFrame, anchors: DataFrame, text: str) -> DataFrame:
    """NDG-4: text at anchored messages: after a user's, before an assistant's."""
    m = messages.join(anchors.select("session_id", "seq").distinct().withColumn("at", F.lit(True)), ["session_id", "seq"], "left")
    new = F.when(F.col("at") & (F.col("role") == "user"), F.concat("text", F.lit("\n" + text))).when(F.col("at") & (F.col("role") == "assistant"), F.concat(F.lit(text + "\n"), F.col("text")))
    return m.withColumn("text", F.coalesce(new, F.col("text"))).drop("at")


def inject_refs(messages: DataFrame, refs: DataFrame, id_tag: str) -> DataFrame:
    """NDG-7, NDG-8: a message's reference as a tag at its end, once."""
    tag = F.concat(F.lit(f"<{id_tag}>"), F.col("ref"), F.lit(f"</{id_tag}>"))
    m = messages.join(refs, ["session_id", "seq"], "left")
    return m.withColumn("text", F.when(F.col("ref").isNotNull() & ~F.contains("text", tag), F.concat("text", F.lit("\n"), tag)).otherwise(F.col("text"))).drop("ref")
