"""Exact top-k search by a three-phase uniform threshold.

The dimensions are cut into lists, the candidates are dealt into tiles of
bounded size, and the queries go to every tile.  Phase one gathers each list's
best entries of a tile and its smallest score; the best exact totals of these
entries, over all tiles, give a safe cutoff for each query.  The cutoffs go to
every tile with the queries, and phase two collects each entry that reaches its
share of the cutoff in some list; the others cannot reach it in sum.  Stretches
of a tile whose norms keep them below the cutoff are not multiplied at all.
Phase three resolves the exact totals of the collected entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, groups, pick

#: Candidates of a tile at least and at most, and tiles that are made before they grow; queries and candidates multiplied at once.
LEAST_TILE, MOST_TILE, TILES = 1024, 1 << 17, 64
QUERY_ROWS, CANDIDATE_ROWS = 1024, 1024
#: Squared norms, and so scores, stay below this.
MOST_SCORE = 1 << 60
NEVER = -MOST_SCORE * 2


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and q, floor(scale * x) of each component, taken as a double; null vectors and those with null or non-finite components leave."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    whole = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite)
    return pick(vectors, "vec_id", "embedding").filter(whole).select("vec_id", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they hold every sum, else in 64-bit integers."""
    top = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 1 << 52 else a @ b.T


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """For each row the columns of the k highest scores, ties to the first."""
    n = score.shape[1]
    if n <= k:
        return np.argsort(-score, axis=1, kind="stable")
    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    above = score > edge
    tied = score == edge
    keep = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(keep)[1].reshape(len(score), k)


def _lists(dims: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dims, min(lists, max(1, dims)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


class Tile:
    """The candidates of one tile, in stretches of falling norm, each in order of ids."""

    def __init__(self, pieces: list[pa.RecordBatch], dims: int, lists: int):
        ids = np.concatenate([b.column(3).to_numpy() for b in pieces]) if pieces else np.zeros(0, np.int64)
        x = np.concatenate([_matrix(b.column(4), dims) for b in pieces]) if pieces else np.zeros((0, dims), np.int64)
        self.cuts = _lists(dims, lists)
        order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        self.stretches = []
        for i in range(0, len(order), CANDIDATE_ROWS):
            at = order[i : i + CANDIDATE_ROWS]
            at = at[np.argsort(ids[at], kind="stable")]
            self.stretches.append((ids[at], x[at], norms(x[at], self.cuts).max(axis=0)))


def norms(x: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """The norm of each row in each list."""
    return np.stack([np.sqrt((x[:, c].astype(np.float64) ** 2).sum(axis=1)) for c in cuts], axis=1)


def _gather(tile: Tile, q_ids: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch | None:
    """Phase one: the best exact totals of each list's leading entries, and each list's least score."""
    if not tile.stretches:
        return None
    cuts = tile.cuts
    low = np.full((len(q_ids), len(cuts)), -NEVER)
    lead = [(np.zeros((len(q_ids), 0), np.int64), np.zeros((len(q_ids), 0), np.int64), np.zeros((len(q_ids), 0), np.int64)) for _ in cuts]
    for number, (ids, x, _) in enumerate(tile.stretches):
        own = q_ids[:, None] == ids[None, :]
        parts = [_product(q[:, c], x[:, c]) for c in cuts]
        low = np.minimum(low, np.stack([p.min(axis=1) for p in parts], axis=1))
        total = np.where(own, NEVER, sum(parts))
        for j, p in enumerate(parts):
            p = np.where(own, NEVER, p)
            at = _best(p, k)
            place = at + number * CANDIDATE_ROWS
            score, best, where = (np.concatenate([a, np.take_along_axis(b, c, 1)], 1) for a, b, c in ((lead[j][0], p, at), (lead[j][1], total, at), (lead[j][2], place, np.arange(at.shape[1])[None, :].repeat(len(at), 0))))
            keep = _best(score, k)
            lead[j] = tuple(np.take_along_axis(v, keep, 1) for v in (score, best, where))
    best, where = np.concatenate([x[1] for x in lead], 1), np.concatenate([x[2] for x in lead], 1)
    order = np.argsort(where, axis=1, kind="stable")
    best, where = np.take_along_axis(best, order, 1), np.take_along_axis(where, order, 1)
    again = np.concatenate([np.zeros((len(where), 1), bool), where[:, 1:] == where[:, :-1]], axis=1)
    best = -np.sort(-np.where(again, NEVER, best), axis=1)[:, :k]
    return pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(list(best), pa.list_(pa.int64())), pa.array(list(low), pa.list_(pa.int64()))], ["vec_id", "scores", "low"])


def _collect(tile: Tile, q_ids: np.ndarray, q: np.ndarray, k: int, cut: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phases two and three."""
    cuts = tile.cuts
    share = low + np.where(cut == NEVER, NEVER // (2 * len(cuts)), (cut - low.sum(axis=1)) // len(cuts))[:, None]
    length = norms(q, cuts)
    for ids, x, longest in tile.stretches:
        near = np.flatnonzero((length * longest).sum(axis=1) * (1 + 1e-9) + 1 >= cut)
        if not len(near):
            continue
        parts = [_product(q[near][:, c], x[:, c]) for c in cuts]
        enough = np.zeros(parts[0].shape, bool)
        for j, p in enumerate(parts):
            enough |= p >= share[near, j : j + 1]
        enough &= q_ids[near][:, None] != ids[None, :]
        rows, columns = np.nonzero(enough)
        total = sum(p[rows, columns] for p in parts)  # phase three: only the collected entries get a total
        keep = total >= cut[near][rows]
        rows, columns, total = rows[keep], columns[keep], total[keep]
        order = np.lexsort((ids[columns], -total, rows))
        rows, columns, total = rows[order], columns[order], total[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1]) if len(rows) else np.zeros(0, int)
        nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        keep = nth < k
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[near][rows[keep]]), pa.array(ids[columns[keep]]), pa.array(total[keep])], ["query_id", "vec_id", "score"])


def _by_tile(k: int, lists: int, phase: int):
    """Rows come sorted by dims and tile, candidates before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tile = None, [], None
        for (dims, number, kind), piece in groups(batches, 3):
            if (dims, number) != now:
                now, held, tile = (dims, number), [], None
            if kind == 0:
                held.append(piece)
                continue
            if tile is None:
                tile, held = Tile(held, dims, lists), []
            for i in range(0, piece.num_rows, QUERY_ROWS):
                some = piece.slice(i, QUERY_ROWS)
                q_ids, q = some.column(3).to_numpy(), _matrix(some.column(4), dims)
                if phase == 1:
                    if (found := _gather(tile, q_ids, q, k)) is not None:
                        yield found
                else:
                    cut = some.column(5).fill_null(NEVER).to_numpy(zero_copy_only=False).astype(np.int64)
                    yield from _collect(tile, q_ids, q, k, cut, _matrix(some.column(6), len(tile.cuts)))

    return run


def _refuse_wide(vectors: DataFrame) -> None:
    """A score of two vectors is at most the product of their norms."""
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = vectors.agg(F.max(square).alias("n")).first()["n"]
    if longest is not None and longest >= MOST_SCORE:
        raise ValueError(f"a vector's product with itself is {longest:.3g}; scores must stay below 2^60")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, lists: int = 4) -> DataFrame:
    """The k candidates of highest integer inner product for each query.

    queries and candidates have vec_id and q (see quantized).  Candidates with
    the query's own vec_id, or another number of dimensions, are not compared.
    Repeated query ids: the row with the smallest vector counts.  Repeated
    candidate rows all count.  Ties go to the smaller vec_id.  Fewer than k
    candidates: all.  Vectors without components score 0 with each other.
    Vectors whose product with themselves reaches 2^60 are refused with an
    error, as scores could pass 64 bits.  Returns query_id, rank (from 1),
    vec_id, score.

    Each phase is one job over all queries and tiles.  The candidates are
    shuffled once in each; a query is sent once to each tile.
    """
    scratch = Scratch(queries.sparkSession, "topk")
    c = scratch.save(candidates.select("vec_id", "q"), "candidates")
    q = scratch.save(queries.groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    _refuse_wide(c)
    _refuse_wide(q)
    tile_rows = min(MOST_TILE, max(LEAST_TILE, -(-c.count() // TILES)))
    tiles = max(1, -(-c.count() // tile_rows))
    none: list[Column] = [F.lit(None).cast("long").alias("cut"), F.lit(None).cast("array<long>").alias("low")]
    # a written table is always split alike within a job, so a row's place in it names its tile
    dealt = c.select(F.size("q").alias("dims"), F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("kind"), "vec_id", "q", *none)

    def tiled(asked: DataFrame) -> DataFrame:
        sent = asked.select(F.size("q").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(1).alias("kind"), "vec_id", "q", "cut", "low")
        return dealt.unionByName(sent).repartition("dims", "tile").sortWithinPartitions("dims", "tile", "kind", "vec_id")

    parts = tiled(q.select("vec_id", "q", *none)).mapInArrow(_by_tile(k, lists, 1), "vec_id long, scores array<long>, low array<long>")
    least = [F.min(F.get("low", F.lit(j))).alias(f"l{j}") for j in range(lists)]
    merged = parts.groupBy("vec_id").agg(F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("scores"), *least)
    kth = F.get("scores", F.lit(k - 1))
    cutoffs = merged.select("vec_id", F.when(kth > F.lit(NEVER), kth).alias("cut"), F.filter(F.array(*[f"l{j}" for j in range(lists)]), lambda x: x.isNotNull()).alias("low"))
    asked = scratch.save(q.join(cutoffs, "vec_id"), "cutoffs")
    found = tiled(asked).mapInArrow(_by_tile(k, lists, 2), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows with an id divisible by ``every``; candidates are all rows."""
    q = quantized(vectors)
    return top_k(q.filter(F.pmod("vec_id", F.lit(every)) == 0), q, k)
