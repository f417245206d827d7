"""Hard-negative mining with a pivot table.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) for rows and 0 for anchors,
so that a falling Euclidean distance is a rising inner product.  The distances
of every row and anchor to a few pivots are worked out once and stored.  By the
triangle inequality they bracket the distance of an anchor and a row, and so
their score; whole stretches of rows are bracketed by the range of their stored
distances first.  What the brackets cannot settle is checked exactly.

Rows are dealt into tiles by label, a frequent label into several; anchors go,
in blocks, to the tiles of their own label for the positives, and with these to
all tiles for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, groups, pick
from quillon.llm.topk import _matrix, _product

#: Pivots, and the sample that they are chosen from; both bound what the driver holds, and results do not depend on them.
PIVOTS, SAMPLE = 16, 4096
#: Rows of a tile at least and at most, tiles that are made before they grow, and anchors of a block.
LEAST_TILE, MOST_TILE, TILES, MOST_ANCHORS = 1024, 1 << 17, 64, 1 << 17
#: Anchors and rows that are bracketed at once.
ANCHOR_ROWS, STRETCH = 256, 512
#: Scores stay below this.
MOST_SCORE = 1 << 60
NEVER = -MOST_SCORE * 2
#: A bracket is wider by this share of the squared lengths, as distances are rounded.
MARGIN = 1e-9


def labelled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and q, floor(scale * x) of each component; rows with a null id, label or vector, or null or non-finite components, leave."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, finite)
    rows = pick(vectors, "vec_id", "embedding", "label").filter(whole)
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))


@dataclass(frozen=True)
class Pivots:
    """Chosen rows of each number of dimensions, with M^2, the largest squared norm of all rows."""

    top: float
    rows: dict[int, np.ndarray]

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of rows, or of anchors, to each pivot."""
        p = self.rows.get(x.shape[1])
        if p is None:
            return np.zeros((len(x), 0))
        x = x.astype(np.float64)
        norms = (x**2).sum(axis=1)
        own = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.top - norms, 0))
        theirs = np.sqrt(np.maximum(self.top - (p**2).sum(axis=1), 0))
        square = norms[:, None] + (p**2).sum(axis=1) - 2 * (x @ p.T) + (own[:, None] - theirs) ** 2
        return np.sqrt(np.maximum(square, 0))


def choose(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> Pivots:
    """Pivots that are far from each other, out of the rows of a sample with the least hashes."""
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(square).alias("n")).first()["n"] or 0.0
    if top >= MOST_SCORE:
        raise ValueError(f"a vector's product with itself is {top:.3g}; scores must stay below 2^60")
    few = rows.orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(sample).select("q").toArrow().column("q").to_pylist()
    chosen = {}
    for dims in {len(q) for q in few}:
        own = [q for q in few if len(q) == dims]
        x = np.array(own, np.float64).reshape(len(own), dims)
        picked = [0]
        near = ((x - x[0]) ** 2).sum(axis=1)
        while len(picked) < min(count, len(x)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        chosen[dims] = x[picked]
    return Pivots(top, chosen)


def _stored(rows: DataFrame, pivots: Pivots, anchors: bool) -> DataFrame:
    """Adds near, the distances to the pivots of a row's number of dimensions."""
    at = rows.columns.index("q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths):
                some = batch.filter(pa.array(lengths == dims))
                d = pivots.distances(_matrix(some.column(at), int(dims)), anchors)
                near = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, near], [*some.schema.names, "near"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", near array<double>")


class Stretch:
    """Some rows of a tile: their ids, labels, vectors and distances to pivots, and the ranges of these."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, near: np.ndarray):
        self.ids, self.labels, self.x, self.near = ids, labels, x, near
        self.least, self.most = near.min(axis=0), near.max(axis=0)
        self.label = (labels.min(), labels.max())


def _stretches(pieces: list[pa.RecordBatch], dims: int) -> list[Stretch]:
    """The rows of a tile by label and nearest pivot, cut."""
    if not pieces:
        return []
    column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in pieces])
    ids, labels = column(4), column(5)
    x = np.concatenate([_matrix(b.column(6), dims) for b in pieces])
    near = np.concatenate([_floats(b.column(7)) for b in pieces])
    keys = (ids, near.min(axis=1), near.argmin(axis=1), labels) if near.shape[1] else (ids, labels)
    order = np.lexsort(keys)
    return [Stretch(ids[at], labels[at], x[at], near[at]) for at in (order[i : i + STRETCH] for i in range(0, len(order), STRETCH))]


def _floats(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column.flatten()) else np.zeros((len(column), 0))


class Anchors:
    """A block of anchors: ids, labels, vectors, distances to pivots, and the squared length of anchor and row together."""

    def __init__(self, batch: pa.RecordBatch, dims: int, top: float):
        self.ids, self.labels = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        self.x, self.near = _matrix(batch.column(6), dims), _floats(batch.column(7))
        self.square = (self.x.astype(np.float64) ** 2).sum(axis=1) + top

    def bracket(self, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of the anchors ``at`` with rows whose distances to each pivot lie between least and most (rows x pivots)."""
        short = np.zeros((len(at), len(least)))
        long = np.full((len(at), len(least)), np.inf)
        for p in range(self.near.shape[1]):
            d = self.near[at, p][:, None]
            np.maximum(short, np.maximum(d - most[:, p], least[:, p] - d), out=short)
            np.minimum(long, d + most[:, p], out=long)
        square = self.square[at][:, None]
        slack = square * MARGIN + 1
        return (square - long**2) / 2 - slack, (square - short**2) / 2 + slack


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by falling score, then id."""
    order = np.lexsort((ids, -score, group))
    if not len(order):
        return order
    group = group[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[nth < k]


class Best:
    """The k best of each group so far, and the score that a new one must reach."""

    def __init__(self, size: int, k: int):
        self.k, self.cut = k, np.full(size, NEVER)
        self.group = self.score = self.ids = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        keep = _first(group, score, ids, self.k)
        self.group, self.score, self.ids = group[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.diff(np.append(self.group, -1)))  # the last of each group
        n = np.diff(np.append(-1, full))
        self.cut[self.group[full]] = np.where(n == self.k, self.score[full], NEVER)


def _tops(score: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
    """open_ without what lies below a row's k-th highest open score."""
    if score.shape[1] <= k:
        return open_
    masked = np.where(open_, score, NEVER)
    return open_ & (masked >= -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k])


def _positives(stretches: list[Stretch], a: Anchors, k: int) -> Best:
    """The first k rows of an anchor's own label."""
    best = Best(len(a.ids), k)
    for s in stretches:
        at = np.flatnonzero((a.labels >= s.label[0]) & (a.labels <= s.label[1]))
        if not len(at):
            continue
        at = at[a.bracket(at, s.least[None], s.most[None])[1][:, 0] >= best.cut[at]]
        if not len(at):
            continue
        open_ = (a.labels[at][:, None] == s.labels) & (a.ids[at][:, None] != s.ids)
        open_ &= a.bracket(at, s.near, s.near)[1] >= best.cut[at][:, None]
        some = open_.any(axis=1)
        at, open_ = at[some], open_[some]
        if not len(at):
            continue
        score = _product(a.x[at], s.x)
        rows, columns = np.nonzero(_tops(score, open_ & (score >= best.cut[at][:, None]), k))
        best.add(at[rows], score[rows, columns], s.ids[columns])
    return best


def _negatives(stretches: list[Stretch], a: Anchors, k: int, low: np.ndarray, high: np.ndarray) -> Best:
    """The first k rows of other labels within each window; windows (anchors x positives) of absent positives are empty."""
    width = low.shape[1]
    best = Best(low.size, k)
    for s in stretches:
        at = np.flatnonzero(~((s.label[0] == s.label[1]) & (a.labels == s.label[0])))
        need = np.maximum(low, best.cut.reshape(low.shape))
        floor, ceiling = need.min(axis=1), high.max(axis=1)
        under, over = a.bracket(at, s.least[None], s.most[None])
        at = at[(over[:, 0] >= floor[at]) & (under[:, 0] <= ceiling[at])]
        if not len(at):
            continue
        under, over = a.bracket(at, s.near, s.near)
        open_ = (a.labels[at][:, None] != s.labels) & (over >= floor[at][:, None]) & (under <= ceiling[at][:, None])
        some = open_.any(axis=1)
        at, open_ = at[some], open_[some]
        if not len(at):
            continue
        score = _product(a.x[at], s.x)
        found = []
        for j in range(width):
            inside = open_ & (score <= high[at, j][:, None]) & (score >= need[at, j][:, None])
            rows, columns = np.nonzero(_tops(score, inside, k)) if inside.any() else (np.zeros(0, np.int64),) * 2
            found.append((at[rows] * width + j, score[rows, columns], s.ids[columns]))
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return best


def _cells(top: float, k: int, least_percent: int, positives: int):
    """Rows come sorted by dims, tile and block, candidates before anchors; with ``positives`` 0 the anchors' positives are looked for, else the negatives between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, stretches = None, [], None
        for (dims, tile, block, kind), piece in groups(batches, 4):
            if (dims, tile, block) != now:
                now, held, stretches = (dims, tile, block), [], None
            if kind == 0:
                held.append(piece)
                continue
            if stretches is None:
                stretches, held = _stretches(held, dims), []
            if not stretches:
                continue
            for i in range(0, piece.num_rows, ANCHOR_ROWS):
                some = piece.slice(i, ANCHOR_ROWS)
                a = Anchors(some, dims, top)
                if not positives:
                    best = _positives(stretches, a, k)
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[best.group]), pa.array(best.ids), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score"])
                    continue
                given = some.column(8).to_pylist()
                score = np.array([[p["positive_score"] for p in g] + [NEVER] * (positives - len(g)) for g in given], np.int64)
                named = np.array([[p["positive_id"] for p in g] + [0] * (positives - len(g)) for g in given], np.int64)
                there = score > NEVER
                low = np.where(there, score // 100 * least_percent - (-least_percent * (score % 100)) // 100, -NEVER)
                best = _negatives(stretches, a, k, low, np.where(there, score, NEVER))
                row, j = best.group // positives, best.group % positives
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.ids[row]), pa.array(j.astype(np.int32)), pa.array(named[row, j]), pa.array(best.ids), pa.array(score[row, j]), pa.array(best.score)],
                    ["anchor_id", "nth", "positive_id", "negative_id", "positive_score", "negative_score"],
                )

    return run


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of other labels that are not too close to tell from positives.

    rows have vec_id, label and q (see labelled); anchors are some of the rows.
    A score is the integer inner product with the anchor; higher ones come
    first, of ties the smaller vec_id.  An anchor's positives are its first
    ``positives`` other rows of the same label; its negatives for a positive are
    the first ``negatives`` rows of another label with
    least_percent * positive_score <= 100 * negative_score <= 100 * positive_score.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.

    A positive without a row in its window, and an anchor without positives,
    give no rows; so does a positive with a score below 0, whose window is
    empty.  Rows with an anchor's own vec_id, or another number of dimensions,
    are not compared with it.  Repeated anchors: the one with the smallest label
    and vector counts; other repeated rows all count, and a positive that
    repeats has its negatives each time.  Vectors without components score 0.
    Vectors whose product with themselves reaches 2^60 are refused with an
    error.  Empty tables give no rows.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    plain = scratch.save(rows.select("vec_id", "label", "q"), "plain")
    pivots = choose(plain)
    c = scratch.save(_stored(plain, pivots, False), "rows")
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("a")).select("vec_id", "a.label", "a.q")
    asked = scratch.save(_stored(one, pivots, True), "anchors")

    total, wanted = c.count(), asked.count()
    tile_rows = min(MOST_TILE, max(LEAST_TILE, -(-total // TILES)))
    blocks = max(1, -(-wanted // MOST_ANCHORS))
    frequent = c.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > tile_rows // 2)
    frequent = frequent.withColumn("tiles", F.ceil(F.col("n") / tile_rows).cast("int")).toArrow().to_pylist()  # 2 * total / tile_rows rows at most
    shared = max(1, -(-(total - sum(f["n"] for f in frequent)) * 2 // tile_rows))  # tiles of the other labels, by hash
    start, first = shared, []
    for f in sorted(frequent, key=lambda f: f["label"]):
        first.append((f["label"], start, f["tiles"]))
        start += f["tiles"]
    places = F.broadcast(rows.sparkSession.createDataFrame(first, "label long, first int, tiles int"))
    other = F.pmod(F.xxhash64("label"), F.lit(shared)).cast("int")

    # a written table is always split alike within a job, so a row's place in it names its tile
    dealt = c.withColumn("place", F.monotonically_increasing_id()).join(places, "label", "left")
    dealt = dealt.withColumn("tile", F.when(F.col("first").isNull(), other).otherwise(F.col("first") + F.pmod("place", F.col("tiles")).cast("int")))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = "array<struct<positive_id:bigint,positive_score:bigint>>"
    base = [F.size("q").alias("dims"), "tile", "block"]
    here = dealt.select(*base, F.lit(0).alias("kind"), "vec_id", "label", "q", "near", F.lit(None).cast(found).alias("found"))

    def cells(sent: DataFrame) -> DataFrame:
        sent = sent.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select(*base, F.lit(1).alias("kind"), "vec_id", "label", "q", "near", "found")
        return here.unionByName(sent).repartition("dims", "tile", "block").sortWithinPartitions("dims", "tile", "block", "kind", "vec_id")

    own = asked.join(places, "label", "left").withColumn("found", F.lit(None).cast(found))
    own = own.withColumn("tile", F.explode(F.when(F.col("first").isNull(), F.array(other)).otherwise(F.sequence(F.col("first"), F.col("first") + F.col("tiles") - 1))))
    some = cells(own).mapInArrow(_cells(pivots.top, positives, least_percent, 0), "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    some = some.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= positives)
    merged = some.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "positive_id", "positive_score"))), lambda p: F.struct(p["positive_id"].alias("positive_id"), p["positive_score"].alias("positive_score"))).cast(found).alias("found"))
    known = scratch.save(asked.join(merged.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "positives")

    every = known.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(start - 1))))
    out = cells(every).mapInArrow(
        _cells(pivots.top, negatives, least_percent, positives), "anchor_id long, nth int, positive_id long, negative_id long, positive_score long, negative_score long"
    )
    order = W.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_table(vectors: DataFrame, every: int = 100, noisy: int = 7, labels: int = 10) -> DataFrame:
    """Anchors are the rows with an id divisible by ``every``; the labels of rows divisible by ``noisy`` are moved on by one first."""
    rows = labelled(vectors)
    moved = F.when(F.pmod("vec_id", F.lit(noisy)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine(rows, rows.filter(F.pmod("vec_id", F.lit(every)) == 0))
