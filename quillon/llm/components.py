"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, join_few

#: Edges that one task contracts at a time.
TASK_EDGES = 500_000
STARS = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, contracted by union-find into (node, smallest node) in portions of bounded size."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            parent.setdefault(ra, ra)
            parent.setdefault(rb, rb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 2 * most:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(edges: DataFrame, scratch: Scratch, name: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """node and comp, the smallest node it is connected to, for every node with an edge to a smaller one.

    edges has two long columns.  Edges are first contracted within tasks.  While
    there is more than one task, alternate large and small stars follow: each
    node hands its neighbours the smallest it knows, until nothing changes.
    """
    pairs = edges.toDF("u", "v").filter("u <> v")
    pairs = scratch.save(pairs, f"{name}-edges")
    tasks = -(-max(1, pairs.count()) // task_edges)
    contract = lambda df: df.mapInArrow(lambda it: _forest(it, task_edges), STARS)
    now = scratch.save(contract(pairs.coalesce(1) if tasks == 1 else pairs.repartition(tasks, F.least("u", "v"))), f"{name}-0")
    scratch.drop(f"{name}-edges")
    seen, round_ = None, 0
    while tasks > 1:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_few(both, low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-large{round_}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("z")).select(F.col("z.x").alias("u"), F.col("z.y").alias("v")).filter("u <> v").distinct()
        now = scratch.save(small, f"{name}-{round_ + 1}")
        scratch.drop(f"{name}-large{round_}", f"{name}-{round_}")
        # whole numbers that change with any row, so equal sums mean that nothing moved
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (mark["n"], mark["s"]):
            break
        seen, round_ = (mark["n"], mark["s"]), round_ + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))

