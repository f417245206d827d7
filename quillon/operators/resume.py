"""PRN-17: stored states against the messages that are there now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.parts import has_compress, ignored_user, with_compaction
from quillon.sources.states import MESSAGES, NUDGES


def turn_ends(messages: DataFrame) -> DataFrame:
    """session_id, ids: every assistant's message that a real user's directly follows, and that one, behind the last message that has compressed."""
    real = messages.select("session_id", "seq", "message_id", "role", ((F.col("role") == "user") & ignored_user()).alias("ignored"), has_compress().alias("compressed"))
    own = W.partitionBy("session_id")
    last = F.coalesce(F.max(F.when((F.col("role") == "assistant") & F.col("compressed"), F.col("seq"))).over(own), F.lit(-1))
    behind = real.withColumn("_last", last).filter("seq > _last and not ignored and role in ('user', 'assistant')")
    order = own.orderBy("seq")
    pairs = behind.withColumns({"_role": F.lead("role").over(order), "_id": F.lead("message_id").over(order)}).filter("role = 'assistant' and _role = 'user'")
    both = pairs.select("session_id", F.explode(F.array(F.col("message_id").cast("string"), F.col("_id").cast("string"))).alias("id"))
    return both.groupBy("session_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def now_of(messages: DataFrame) -> DataFrame:
    """session_id, last_compaction and turn of the sessions with a real user's message; others are not looked at."""
    m = with_compaction(messages).withColumn("_real", (F.col("role") == "user") & ~ignored_user())
    steps = F.when(F.col("created") >= F.col("last_compaction"), F.size(F.filter("parts", lambda p: p["type"] == "step-start"))).otherwise(0)
    per = m.groupBy("session_id").agg(F.max("last_compaction").alias("last_compaction"), F.sum(steps).cast("long").alias("turn"), F.bool_or("_real").alias("_real"))
    return per.filter("_real").drop("_real")


def _united(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def resume(states: DataFrame, messages: DataFrame) -> DataFrame:
    """The state that each session of ``messages`` goes on with.

    A session without a stored state starts with an empty one.  A session is
    opened by what is stored: its prunes and blocks, and its turn anchors
    together with the ends of turns.  Where the messages hold a
    newer compaction than the state knows (``lastCompaction``), prunes, blocks
    and anchors go and the statistics stay; a state that does not know one, as
    older ones do not, is taken to be of now.

    Returns the columns of states, and is_new, cleared and turn (the
    session's step starts outside compacted messages).  Sessions of states
    without messages, or whose messages have no real user, are left out.
    """
    key = F.col("session_id").cast("string")
    now = now_of(messages).withColumn("session_id", key)
    users = turn_ends(messages).withColumn("session_id", key)
    j = now.join(states.withColumnRenamed("sessionId", "session_id"), "session_id", "left").join(users, "session_id", "left")
    fresh = F.col("prune").isNull()
    cleared = ~fresh & (F.col("last_compaction") > F.coalesce("lastCompaction", F.col("last_compaction")))
    ids = lambda c: F.array().cast("array<string>") if c is None else F.coalesce(F.col(c), F.array().cast("array<string>"))
    blank = F.from_json(F.lit('{"byMessageId":{},"blocksById":{},"activeBlockIds":[],"activeByAnchorMessageId":{},"nextBlockId":1}'), MESSAGES)
    no_prune = F.struct(F.create_map().cast("map<string,bigint>").alias("tools"), blank.alias("messages"))
    no_nudges = F.from_json(F.lit('{"contextLimitAnchors":[],"turnNudgeAnchors":[],"iterationNudgeAnchors":[]}'), NUDGES)
    kept = F.struct(ids("nudges.contextLimitAnchors").alias("contextLimitAnchors"), _united(F.col("nudges.turnNudgeAnchors"), F.col("ids")).alias("turnNudgeAnchors"), ids("nudges.iterationNudgeAnchors").alias("iterationNudgeAnchors"))
    started = F.struct(ids(None).alias("contextLimitAnchors"), ids("ids").alias("turnNudgeAnchors"), ids(None).alias("iterationNudgeAnchors"))
    none_yet = F.from_json(F.lit('{"pruneTokenCounter":0,"totalPruneTokens":0}'), "struct<pruneTokenCounter:bigint,totalPruneTokens:bigint>")
    return j.select(
        F.col("session_id").alias("sessionId"), "sessionName", F.when(fresh | cleared, no_prune).otherwise(F.col("prune")).alias("prune"), F.when(cleared, no_nudges).when(fresh, started).otherwise(kept).alias("nudges"),
        F.coalesce("stats", none_yet).alias("stats"), "lastUpdated", F.col("last_compaction").alias("lastCompaction"), fresh.alias("is_new"), cleared.alias("cleared"), "turn",
    )
