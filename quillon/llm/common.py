"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

U64 = np.uint64


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name.

    Extra columns are dropped before anything is computed, so a column called
    ``TEXT`` or ``n_words`` cannot clash with what an operator adds.  Of equal
    names the first counts.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    lower = [c.lower() for c in df.columns]
    found = [df.columns.index(n) if n in df.columns else lower.index(n.lower()) for n in names]
    return df.toDF(*places).select(*[F.col(places[i]).alias(n) for i, n in zip(found, names, strict=True)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    That is ``spark.checkpoint.dir``.  Where it is unset, a local session gets a
    folder of its own; a cluster uses the SQL warehouse, which is shared too.
    """
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if conf.get("spark.master", "local").startswith("local") and "cluster" not in conf.get("spark.master", ""):
        return "file://" + os.path.join(tempfile.gettempdir(), "quillon-work")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillon-work"


class Scratch:
    """Tables written between the steps of one operator.

    A written table cuts the lineage: a lost executor costs a re-read, not the
    steps before it.  ``drop`` frees a table as soon as no later step reads it,
    ``keep`` all but those that the lazy result reads.  What is left goes when
    the application ends, or before that by ``release``.
    """

    #: Folders of this process that still hold tables.
    roots: ClassVar[set[str]] = set()

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes df, split into a folder for each value of ``by``, and reads it back."""
        kept = df.schema
        if self.root not in Scratch.roots:
            Scratch.roots.add(self.root)
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files.mkdirs(at)  # only what is there is deleted at the end
            files.deleteOnExit(at)
        self.names.add(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        return self.spark.read.schema(kept).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drops every table but the named ones."""
        self.drop(*(self.names - set(names)))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators of this process have written.

    For the owner of a long session, after results have been read: results are
    lazy, so those not read yet are gone too.
    """
    for root in list(Scratch.roots):
        _delete(spark, root)
        Scratch.roots.discard(root)


#: Rows of one key that a join leaves in one task at least, and keys that are broadcast at most.
HOT_ROWS, MOST_HOT = 1024, 100_000


def join_few(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row for each key, so that no task gets all rows of a frequent key.

    A key is frequent if it has more than HOT_ROWS rows and more than a
    MOST_HOT-th of all rows, so at most MOST_HOT keys are; their rows of few are
    broadcast.  All others meet by a shuffle.  rows is a written table, as it is
    read several times.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT_ROWS)
    least = -(-rows.count() // MOST_HOT)
    hot = counts.filter(F.col("_rows") > least).select(key).toArrow()  # MOST_HOT rows at most
    if not hot.num_rows:
        return rows.join(few, key, how)
    keys = rows.sparkSession.createDataFrame(hot)
    cold = rows.join(F.broadcast(keys), key, "left_anti").join(few, key, how)
    few_hot = few.join(F.broadcast(keys), key, "left_semi")
    return cold.unionByName(rows.join(F.broadcast(keys), key, "left_semi").join(F.broadcast(few_hot), key, how))


#: Bits of a filter for keys, a fixed size: two for each key.  Beyond some ten million keys it lets more and more through, and what it lets through is joined.
FILTER_BITS = 1 << 24


def filter_places(key: str) -> list[Column]:
    """The two bits of a key."""
    h = F.xxhash64(key)
    return [F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 32), F.lit(FILTER_BITS))]


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """The filter of some keys, as bytes; put together by the executors in pieces, of which there are FILTER_BITS in all."""
    at = keys.select(F.explode(F.array(*[b + 1 for b in filter_places(key)])).alias("bit")).select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in at.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).collect():
        start = (r["bucket"] - 1) * 4096
        filled[start : start + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return filled


#: Keys that a join with wide rows broadcasts at most: some 50 MB.
MOST_KEYS = 1_000_000


def join_wide(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Wide rows joined with ``keys``, a written table of narrow rows with few rows for each key.

    Up to MOST_KEYS rows of keys are counted and broadcast, so wide rows stay
    where they are; beyond that both sides are shuffled, once.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, key, how)


#: Copies of a row that are told apart in one piece of work.
COPIES = 4096


def counted_copies(rows: DataFrame) -> DataFrame:
    """Each different row once, with the number of its copies; counted before the shuffle."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def each_copy(rows: DataFrame, *key: str, most: int | None = None) -> DataFrame:
    """Rows with ``copies`` as that many rows, numbered by nth from 0.

    A row with many copies becomes blocks of ``most``, which are dealt out by
    key and block before they become rows, so no task makes them all.
    """
    most = most or COPIES
    one = rows.filter(F.col("copies") == 1).withColumn("nth", F.lit(0).cast("long"))
    many = rows.filter(F.col("copies") > 1).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / most))))
    many = many.repartition(F.xxhash64(*key, "block"))
    many = many.withColumn("nth", F.explode(F.sequence(F.col("block") * most, F.least("copies", (F.col("block") + 1) * most) - 1)))
    return one.unionByName(many.drop("block")).drop("copies")


#: Counters of a count sketch: one for each so many bytes of text, between two bounds.
COUNTER_BYTES, COUNTERS, MOST_COUNTERS = 1 << 19, 1 << 18, 1 << 24


def text_bytes(docs: DataFrame) -> int:
    """About how many bytes of text there are: the planner's estimate, or a sum where it has none."""
    known = int(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def counters(size: int, each: int = COUNTER_BYTES) -> int:
    """Counters for so many bytes of text, one for ``each``, so that a list not known to be long is short."""
    return min(MOST_COUNTERS, max(COUNTERS, 1 << (max(1, size // each) - 1).bit_length()))


def trim() -> None:
    """Gives freed memory back, as a worker that goes on to another operator would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its memory given back at the end of each partition."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and their n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that working memory does not follow the batch size.

    A single row is never split, so a longer text makes a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(buffers(batch.column(batch.schema.get_field_index(column)))[1])
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where the first ``width`` columns change; a group may come in several pieces."""
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(width)]
        if batch.num_rows:
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                yield tuple(int(k[a]) for k in keys), batch.slice(a, b - a)


def whole_groups(batches: Iterator[pa.RecordBatch], width: int, least: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches in stretches of ``least`` rows or more, cut only where the first ``width`` columns change."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < least:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in whole[:width]]))
        held = [whole]
        if len(new):
            cut = new[-1] + 1
            yield [c[:cut] for c in whole]
            held, rows = [[c[cut:].copy() for c in whole]], rows - int(cut)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
