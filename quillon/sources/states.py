"""Saved states of sessions: one JSON file for each, read back field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a stored file, as they are named there.
BLOCK = (
    "struct<active:boolean,deactivatedByUser:boolean,compressedTokens:double,topic:string,startId:string,endId:string,anchorMessageId:string,compressMessageId:string,includedBlockIds:array<bigint>,consumedBlockIds:array<bigint>,"
    "parentBlockIds:array<bigint>,directMessageIds:array<string>,directToolIds:array<string>,effectiveMessageIds:array<string>,effectiveToolIds:array<string>,createdAt:bigint,deactivatedAt:bigint,deactivatedByBlockId:bigint,summary:string>"
)
MESSAGE = "struct<tokenCount:bigint,allBlockIds:array<bigint>,activeBlockIds:array<bigint>>"
MESSAGES = f"struct<byMessageId:map<string,{MESSAGE}>,blocksById:map<string,{BLOCK}>,activeBlockIds:array<bigint>,activeByAnchorMessageId:map<string,bigint>,nextBlockId:bigint>"
NUDGES = "struct<contextLimitAnchors:array<string>,turnNudgeAnchors:array<string>,iterationNudgeAnchors:array<string>>"
STATE = f"sessionId string, sessionName string, prune struct<tools:map<string,bigint>,messages:{MESSAGES}>, nudges {NUDGES}, stats struct<pruneTokenCounter:bigint,totalPruneTokens:bigint>, lastUpdated string, lastCompaction bigint"


def read(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11, SRC-12: the states of all files; those that do not parse, or lack what counts, are skipped."""
    rows = spark.read.schema(STATE + ", _corrupt string").option("mode", "PERMISSIVE").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null and prune is not null and stats is not null").drop("_corrupt")


def write(states: DataFrame, path: str) -> None:
    """SNK-1: states as JSON, one folder for each session, with the time of writing; folders of other sessions stay as they are."""
    stamped(states).withColumn("session", F.col("sessionId")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").json(path)


def stamped(states: DataFrame) -> DataFrame:
    """States with the time of writing."""
    return states.withColumn("lastUpdated", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def empty(spark: SparkSession) -> DataFrame:
    """PRN-19: no states, with their schema."""
    return spark.createDataFrame([], STATE)


def statistics(states: DataFrame) -> DataFrame:
    """AGG-9: tokens, tools and messages over the sessions that have pruned anything."""
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(F.map_keys(c))), F.lit(0))
    some = states.filter("stats.totalPruneTokens <> 0 and prune is not null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return some.agg(
        total(F.col("stats.totalPruneTokens")).alias("tokens"), total(size(F.col("prune.tools"))).alias("tools"), total(size(F.col("prune.messages.byMessageId"))).alias("messages"), F.count("*").alias("sessions")
    )


def pruned_tools(states: DataFrame) -> DataFrame:
    """PRN-18: a row for each pruned call; entries without a number leave."""
    return states.select(F.col("sessionId").alias("session_id"), F.explode("prune.tools").alias("call_id", "token_count")).filter("token_count is not null")


def _ids(c: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<bigint>")), lambda x: x > 0))


def _texts(c: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def pruned_messages(states: DataFrame) -> DataFrame:
    """PRN-18: a row for each covered message; block numbers are positive and distinct, a missing count is 0."""
    m = states.select(F.col("sessionId").alias("session_id"), F.explode("prune.messages.byMessageId").alias("message_id", "x")).filter("x is not null")
    return m.select("session_id", "message_id", F.coalesce("x.tokenCount", F.lit(0)).alias("token_count"), _ids(F.col("x.allBlockIds")).alias("all_blocks"), _ids(F.col("x.activeBlockIds")).alias("active_blocks"))


def blocks(states: DataFrame) -> DataFrame:
    """PRN-18: a row for each stored block with a positive number; missing texts are empty, and tokens not below 0."""
    b = states.select(F.col("sessionId").alias("session_id"), F.explode("prune.messages.blocksById").alias("key", "x"), F.coalesce("prune.messages.activeBlockIds", F.array().cast("array<bigint>")).alias("_on"))
    b = b.withColumn("block_id", F.regexp_extract("key", r"^\s*(\d{1,18})", 1).try_cast("long")).filter("block_id > 0 and x is not null")
    text = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(""))
    flag = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(False))
    lists = {"included": _ids, "consumed": _ids, "parents": _ids}
    return b.select(
        "session_id", "block_id", (flag("active") | F.array_contains("_on", F.col("block_id"))).alias("active"), flag("deactivatedByUser").alias("deactivated_by_user"), F.greatest(F.lit(0.0), F.when(F.isnan("x.compressedTokens"), 0.0).otherwise(F.coalesce("x.compressedTokens", F.lit(0.0)))).cast("long").alias("compressed_tokens"),
        text("topic").alias("topic"), text("startId").alias("start_id"), text("endId").alias("end_id"), text("anchorMessageId").alias("anchor_message_id"), text("compressMessageId").alias("compress_message_id"),
        *[f(F.col(f"x.{n[:-1] if n == 'parents' else n}BlockIds")).alias(n) for n, f in lists.items()],
        *[_texts(F.col(f"x.{a}{b}Ids")).alias(f"{a}_{b.lower()}s") for a in ("direct", "effective") for b in ("Message", "Tool")], F.coalesce("x.createdAt", F.lit(0)).alias("created"), text("summary").alias("summary"),
    )


def next_block(states: DataFrame) -> DataFrame:
    """PRN-18: the number that a session's next block gets: beyond the stored counter and every block, 1 at least."""
    last = F.array_max(F.transform(F.map_keys("prune.messages.blocksById"), lambda k: k.try_cast("long")))
    return states.select(F.col("sessionId").alias("session_id"), F.greatest(F.lit(1), F.coalesce("prune.messages.nextBlockId", F.lit(1)), F.coalesce(last + 1, F.lit(1))).cast("long").alias("next_block"))


def anchors(states: DataFrame) -> DataFrame:
    """SRC-11: the stored anchors, each once."""
    kinds = {"context": "contextLimitAnchors", "turn": "turnNudgeAnchors", "iteration": "iterationNudgeAnchors"}
    lists = F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[_texts(F.col(f"nudges.{c}")) for c in kinds.values()]))
    return states.select(F.col("sessionId").alias("session_id"), F.explode(lists).alias("kind", "ids")).select("session_id", "kind", F.explode("ids").alias("message_id"))
