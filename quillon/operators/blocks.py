"""Activity of compression blocks, their ancestors, and taking them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def activity(blocks: DataFrame) -> DataFrame:
    """CMP-9: adds active.

    A block is valid if its message is there and the user has not taken it back.
    A valid block that no later valid block consumes is active.
    """
    valid = blocks.filter("origin_present and not deactivated_by_user")
    eaten = valid.select("session_id", F.explode("consumed").alias("block_id"), F.struct("created", F.col("block_id").alias("by")).alias("at"))
    last = eaten.groupBy("session_id", "block_id").agg(F.max("at").alias("at"))
    j = blocks.join(last, ["session_id", "block_id"], "left")
    own = F.struct("created", F.col("block_id").alias("by"))
    free = F.col("at").isNull() | (F.col("at") <= own)
    return j.withColumn("active", F.col("origin_present") & ~F.col("deactivated_by_user") & free).drop("at")


def anchor_owners(blocks: DataFrame) -> DataFrame:
    """CMP-9: each anchor's latest valid block, if it is active; an older one is not put back."""
    b = activity(blocks).filter("origin_present and not deactivated_by_user")
    newest = F.row_number().over(W.partitionBy("session_id", "anchor_seq").orderBy(F.desc("created"), F.desc("block_id")))
    return b.withColumn("rn", newest).filter("rn = 1 and active").select("session_id", "anchor_seq", "block_id")


def ancestors(blocks: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """CMP-20: the nearest active block above each inactive one, the smallest of several, and how many steps up it is.

    The front goes one step up at a time until it is empty.  ``written`` writes
    a table under a name and reads it back, so a step never plans those before
    it.  What a block has seen stays out, so cycles end.
    """
    a = written(activity(blocks).select("session_id", "block_id", "active", "consumed"), "activity")
    edges = a.select("session_id", F.explode("consumed").alias("child"), F.col("block_id").alias("parent"), F.col("active").alias("on")).filter("child <> parent").distinct()
    edges = written(edges, "edges")
    front = written(a.filter("not active").select("session_id", "block_id", F.col("block_id").alias("child")), "front0")
    seen, found, level = front, None, 0
    while not front.isEmpty():
        level += 1
        up = written(front.join(edges, ["session_id", "child"]).select("session_id", "block_id", "parent", "on").distinct(), f"up{level}")
        hit = up.filter("on").groupBy("session_id", "block_id").agg(F.min("parent").alias("ancestor")).withColumn("depth", F.lit(level))
        found = hit if found is None else written(found.unionByName(hit), f"found{level}")
        left = up.join(hit, ["session_id", "block_id"], "left_anti").select("session_id", "block_id", F.col("parent").alias("child")).distinct()
        front = written(left.join(seen, ["session_id", "block_id", "child"], "left_anti"), f"front{level}")
        seen = written(seen.unionByName(front), f"seen{level}")
    if found is None:
        return a.filter("false").select("session_id", "block_id", F.col("block_id").alias("ancestor"), F.lit(0).alias("depth"))
    return found


def decompress(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """CMP-18: the targets (session_id, block_id) marked as taken back by the user."""
    hit = targets.select("session_id", "block_id").distinct().withColumn("hit", F.lit(True))
    return blocks.join(hit, ["session_id", "block_id"], "left").withColumn("deactivated_by_user", F.col("deactivated_by_user") | F.coalesce("hit", F.lit(False))).drop("hit")


def recompress(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """CMP-19: the inverse, for blocks whose message is there and that the user has taken back."""
    hit = targets.select("session_id", "block_id").distinct().withColumn("hit", F.lit(True))
    back = F.coalesce("hit", F.lit(False)) & F.col("origin_present") & F.col("deactivated_by_user")
    return blocks.join(hit, ["session_id", "block_id"], "left").withColumn("deactivated_by_user", F.col("deactivated_by_user") & ~back).drop("hit")


def recompressible(blocks: DataFrame) -> DataFrame:
    """PRD-23: taken back by the user, not active, and with their message."""
    return activity(blocks).filter("deactivated_by_user and not active and origin_present")


def activity_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """SET-5, AGG-18: blocks that went on or off between two tables, with their tokens."""
    a = activity(before).select("session_id", "block_id", F.col("active").alias("was"), "compressed_tokens")
    b = activity(after).select("session_id", "block_id", F.col("active").alias("now"))
    return a.join(b, ["session_id", "block_id"]).filter("was <> now").select("session_id", "block_id", F.when(F.col("now"), "on").otherwise("off").alias("change"), "compressed_tokens")


def inside_active(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """CMP-18: blocks that cannot be taken back by themselves, with the active block that holds them."""
    return blocks.select("session_id", "block_id").join(above.select("session_id", "block_id", F.col("ancestor").alias("held_by")), ["session_id", "block_id"])


def available(blocks: DataFrame) -> DataFrame:
    """PRD-22: the active blocks in order."""
    return activity(blocks).filter("active").orderBy("session_id", "block_id")


def block_number(argument: Column) -> Column:
    """CMP-21: ``bN`` or a positive whole number; anything else is null."""
    digits = F.regexp_extract(F.lower(F.trim(argument)), r"^b?([1-9]\d{0,17})$", 1)
    return F.when(digits != "", digits.cast("long"))


def token_balance(total: Column, diff_off: Column, diff_on: Column) -> Column:
    """CMP-18, CMP-19: a session's saved tokens after blocks went off and on, from 0."""
    return F.greatest(F.lit(0), total - diff_off + diff_on)
