"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of slots.  The bytes of each slot are summed,
and a small map says which shard holds which slot.  The map is the only thing
that a rebalancing edits: records never hash anew.  Everything runs as
DataFrame operations; the map, ``slots`` rows at most, is one array folded by
a higher-order function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, counted_copies, each_copy, pick

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, nth, virtual_slot of every row.

    The slot hashes doc_id, the text's checksum and which of its copies a row
    is, so rows with a null or repeated doc_id spread, and so do equal rows.  A
    null text counts as empty.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = pick(docs, "doc_id", "text").select("doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"))
    every = each_copy(counted_copies(rows), "doc_id", "text_crc32")
    return every.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "nth"), F.lit(slots)).cast("int"))


def slot_bytes(records: DataFrame) -> DataFrame:
    """virtual_slot, slot_bytes, slot_rows; summed before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def _all_slots(spark: SparkSession, per_slot: DataFrame, slots: int) -> DataFrame:
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(per_slot.select("virtual_slot", "slot_bytes")), "virtual_slot", "left").na.fill(0, ["slot_bytes"])


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """One row with the rows as an array, largest slots first; a map has ``slots`` rows at most."""
    key = F.struct((-F.col("slot_bytes")).alias("neg"), "virtual_slot", *columns)
    return rows.agg(F.sort_array(F.collect_list(key)).alias("slots"))


def build_map(spark: SparkSession, per_slot: DataFrame, shards: int, slots: int = SLOTS, version: int = 1) -> DataFrame:
    """A first map: slots from the largest down, each to the shard with the fewest bytes so far."""
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.lit(0).cast("long").alias("b"), i.alias("s")))
    start = F.struct(load.alias("load"), F.array().cast("array<int>").alias("to"))

    def place(acc: Column, x: Column) -> Column:
        low = F.array_min(acc["load"])
        rest = F.transform(acc["load"], lambda y: F.when(y["s"] == low["s"], F.struct((y["b"] - x["neg"]).alias("b"), y["s"].alias("s"))).otherwise(y))
        return F.struct(rest.alias("load"), F.concat(acc["to"], F.array(low["s"])).alias("to"))

    folded = _lists(_all_slots(spark, per_slot, slots)).select("slots", F.aggregate("slots", start, place)["to"].alias("to"))
    return folded.select(F.explode(F.arrays_zip("slots", "to")).alias("z")).select(
        F.lit(version).alias("version"), F.col("z.slots.virtual_slot").alias("virtual_slot"), F.col("z.to").alias("shard"), (-F.col("z.slots.neg")).alias("slot_bytes")
    )


def rebalance_map(spark: SparkSession, old: DataFrame, per_slot: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The next version of a map, for new slot sizes or another number of shards.

    Slots of shards that are gone, and the largest slots of each shard beyond an
    equal share of the bytes, move to the emptiest shards; all others stay.
    """
    now = old.select("version", "virtual_slot", "shard").join(F.broadcast(_all_slots(spark, per_slot, slots)), "virtual_slot")
    total = now.agg(F.sum("slot_bytes").alias("total"))
    by_size = W.partitionBy("shard").orderBy("slot_bytes", "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    kept = now.crossJoin(F.broadcast(total)).withColumn("run", F.sum("slot_bytes").over(by_size))
    share = F.ceil(F.col("total") / F.lit(shards))
    stays = (F.col("shard") < shards) & (F.col("run") <= share)
    kept = kept.withColumn("stay", F.when(stays, F.col("shard")).otherwise(F.lit(-1)))
    base = kept.filter("stay >= 0").groupBy("stay").agg(F.sum("slot_bytes").alias("b"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("stay")).join(base, "stay", "left").na.fill(0, ["b"])
    load = every.agg(F.collect_list(F.struct("b", F.col("stay").alias("s"))).alias("load"))
    rows = kept.agg(F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("neg"), "virtual_slot", "stay"))).alias("slots"), (F.max("version") + 1).alias("version"))

    def place(acc: Column, x: Column) -> Column:
        low = F.array_min(acc["load"])
        moved = x["stay"] < 0
        rest = F.transform(acc["load"], lambda y: F.when(moved & (y["s"] == low["s"]), F.struct((y["b"] - x["neg"]).alias("b"), y["s"].alias("s"))).otherwise(y))
        return F.struct(rest.alias("load"), F.concat(acc["to"], F.array(F.when(moved, low["s"]).otherwise(x["stay"]))).alias("to"))

    start = F.struct(F.col("load"), F.array().cast("array<int>").alias("to"))
    folded = rows.crossJoin(F.broadcast(load)).select("slots", "version", F.aggregate("slots", start, place)["to"].alias("to"))
    return folded.select("version", F.explode(F.arrays_zip("slots", "to")).alias("z")).select(
        "version", F.col("z.slots.virtual_slot").alias("virtual_slot"), F.col("z.to").alias("shard"), (-F.col("z.slots.neg")).alias("slot_bytes")
    )


class MapStore:
    """Slot maps as one Parquet folder for each version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, slot_map: DataFrame, version: int) -> DataFrame:
        slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        rows = self.spark.read.schema("virtual_slot int, shard int, slot_bytes long").parquet(f"{self.root}/version={version}")
        return rows.select(F.lit(version).alias("version"), "*")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the row's place in its shard from 0 on without gaps.

    Places are counted within each virtual slot and shifted by the rows of the
    shard's earlier slots, so no task sees more than one virtual slot at a time.
    """
    rows = records.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"))
    placed = slot_map.select("virtual_slot", "shard").join(F.broadcast(rows), "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "nth")
    return (
        records.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(placed), "virtual_slot")
        .withColumn("slot", F.col("start") + F.col("place") - 1)
        .drop("start", "place")
    )


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Puts every row of docs into a shard; law ``bytes``.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: it
    belongs to another law) and virtual_slot.  Null doc_id: kept, hashed like
    any value.  Null or empty text: size 8.  Repeated rows: each is placed.
    Empty table: no rows.  The broadcast sides have ``slots`` rows at most.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    records = scratch.save(with_slots(docs, slots), "records")
    slot_map = MapStore(spark, scratch.path("map")).write(build_map(spark, slot_bytes(records), shards, slots), 1)
    return assign(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
