"""Applies pruning decisions to parts and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import scrub_tags

def scrub_messages(messages: DataFrame, block_tag: str, id_tag: str) -> DataFrame:
    """PRN-15: injected tags leave the texts."""
    return messages.withColumn("text", scrub_tags(F.col("text"), block_tag, id_tag))


def strip_stale_metadata(messages: DataFrame) -> DataFrame:
    """PRN-14: metadata of assistant messages from another model than the session's last user message's."""
    last = F.max(F.when(F.col("role") == "user", F.struct("seq", "model"))).over(W.partitionBy("session_id"))
    m = messages.withColumn("now", last["model"])
    stale = (F.col("role") == "assistant") & F.col("now").isNotNull() & ~F.col("model").eqNullSafe(F.col("now"))
    return m.withColumn("metadata", F.when(~stale, F.col("metadata"))).drop("now")


def collapse_ranges(messages: DataFrame, covered: DataFrame, summaries: DataFrame) -> DataFrame:
    """PRN-13, JOIN-3, SET-1: covered messages leave; a summary stands right before the message it is anchored to.

    A summary needs text and a user message at or before its anchor.
    """
    left = messages.join(covered, ["session_id", "seq"], "left_anti").select("session_id", "seq", F.lit(1).alias("rank"), "role", "text")
    first_user = messages.filter("role = 'user'").groupBy("session_id").agg(F.min("seq").alias("first_user"))
    shown = summaries.filter("summary <> ''").join(first_user, "session_id").filter("first_user <= anchor_seq")
    new = shown.select("session_id", F.col("anchor_seq").alias("seq"), F.lit(0).alias("rank"), F.lit("user").alias("role"), F.col("summary").alias("text"))
    return left.unionByName(new)


def scrub_parts(messages: DataFrame, block_tag: str, id_tag: str) -> DataFrame:
    """PRN-15: injected tags leave the texts, and the outputs of completed calls."""

    def clean(p: Column) -> Column:
        p = p.withField("text", F.when(p["type"] == "text", scrub_tags(p["text"], block_tag, id_tag)).otherwise(p["text"]))
        done = (p["type"] == "tool") & (p["status"] == "completed")
        return p.withField("output", F.when(done, scrub_tags(p["output"], block_tag, id_tag)).otherwise(p["output"]))

    return messages.withColumn("parts", F.transform("parts", clean))


def minimize(messages: DataFrame) -> DataFrame:
    """SNK-2, SNK-3: messages for a snapshot: role, time and model, and parts without step parts, ignored or empty texts; empty messages leave.

    A part keeps the fields of its type.  The metadata of a tool's state come as
    they are, as the rows have no second place for them.
    """
    none = F.lit(None)
    kept = F.filter("parts", lambda p: ~p["type"].isin("step-start", "step-finish") & ~((p["type"] == "text") & (F.coalesce(p["ignored"], F.lit(False)) | (F.coalesce(p["text"], F.lit("")) == ""))))
    tool = lambda p, c: F.when(p["type"] == "tool", p[c]).otherwise(none).alias(c)
    small = F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), *[tool(p, c) for c in ("tool", "status", "input", "output", "error", "metadata")]))
    out = messages.select("session_id", "seq", "role", "created", "agent", F.concat_ws("/", "provider", "model").alias("model"), small.alias("parts"))
    return out.filter(F.size("parts") > 0)
