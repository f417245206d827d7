"""Size-aware n-gram Jaccard join.

Two texts link when their sets of 5-word shingles overlap in three quarters of
their union or more.  Shingles have one order for all texts, rare before
frequent by a count sketch, so linked sets share one of their first shingles.

- Light sets, up to a size chosen by cost, are met by all 2-subsets of a prefix
  one longer: linked sets share two of these shingles.
- Heavy sets scan inverted lists of their prefix; light sets near the boundary
  stand in the lists as well, for pairs across it.

Texts with equal sets are one node.  In every list a chain of neighbours is
checked first and what links is joined to components.  Pairs of a list that are
still in different components, and could link by sizes, places and bitmaps, put
their components into one cluster.  In each cluster the sets outside its largest
component scan inverted lists of all shingles, which counts overlaps exactly.
No link between components is lost, and pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import U64, Scratch, counters, filter_places, groups, join_few, join_wide, key_filter, mix64, pick, slices, text_bytes, trimmed, whole_groups
from quillon.llm.components import components
from quillon.llm.shingles import shingle_sets, signatures

#: Counters in one row of the sketch.
ROW = 64
#: Sizes above this are never light.
MOST_LIGHT = 64
#: Entries of one block of a list.
BLOCK = 8192
#: Bytes of text for one counter: some 5500 shingles, so a counter that is not frequent tells that its lists fit in a block.
COUNTER_TEXT = 1 << 15
#: Places in a prefix whose lists give chains.
CHAIN_PLACES = 12
#: The columns of documents.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def prefix(n: int) -> int:
    """Shingles of a set of n of which a linked set holds one: n - ceil(3n / 4) + 1."""
    return n // 4 + 1


def needed(total: np.ndarray) -> np.ndarray:
    """Least overlap of two linked sets with ``total`` shingles in sum: ceil(3 total / 7)."""
    return -(-3 * total // 7)


def bitmap(hashes: np.ndarray) -> bytes:
    """Each shingle flips one bit of at least two for each; sets that differ little have bitmaps that differ no more."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(a: np.ndarray, size: int) -> np.ndarray:
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only if the bitmaps differ in more bits than linked sets differ in shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return differ <= na + nb - 2 * int(-(-3 * (na + nb) // 7))


SETS = "kind int, doc_id {}, n int, sig long, alt long, bits binary, block int, counts array<int>"


def _scan(width: int):
    """A row for each text, and the partition's part of a count sketch of ``width`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(width, np.int64), set()
        names = [x.split()[0] for x in SETS.split(", ")]
        id_type = pa.int64()
        for batch in slices(batches):
            id_type = batch.column(0).type
            n, sigs, bits = [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                sig = signatures(s)
                sigs.append(sig)
                new = len(s) > 0 and sig not in seen
                bits.append(bitmap(s) if new else None)
                if new:
                    seen.add(sig)
                    at = (s & U64(width - 1)).astype(np.int64)
                    np.add.at(counts, at, 1) if len(s) < 64 else _add(counts, at)
            m = len(n)
            first, second = (pa.array([x[k] for x in sigs], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column(0), pa.array(n, pa.int32()), first, second, pa.array(bits, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int32()))], names)
        rows = counts.reshape(-1, ROW)
        filled = np.flatnonzero(rows.any(axis=1))
        for k in range(0, len(filled), 1 << 14):
            some = filled[k : k + (1 << 14)]
            m = len(some)
            values = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * ROW, pa.int32()), pa.array(rows[some].ravel(), pa.int32()))
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, id_type), pa.nulls(m, pa.int32()), none, none, pa.nulls(m, pa.binary()), pa.array(some, pa.int32()), values], names)

    return run


def _add(counts: np.ndarray, at: np.ndarray) -> None:
    at, times = np.unique(at, return_counts=True)
    counts[at] += times


class Order:
    """The order of shingles: a class of frequency from the sketch, then the hash."""

    def __init__(self, counts: np.ndarray):
        mean = counts.mean()
        self.edge = int(mean + 4 * mean**0.5) + 2
        # counters of ordinary shingles say nothing about the length of a list (beyond half a terabyte, or on very short words)
        self.coarse = self.edge > BLOCK
        over = np.maximum(counts // self.edge, 1)
        self.classes = np.where(counts > self.edge, np.floor(np.log2(over)) + 1, 0).astype(np.uint8)
        # of an occurrence, how many others its shingle has, beyond what counters share by chance
        total = max(1.0, float(counts.sum()))
        self.others = max(0.0, float((counts.astype(float) ** 2).sum()) / total - mean - 1)

    def _class(self, hashes: np.ndarray) -> np.ndarray:
        return self.classes[(hashes & U64(len(self.classes) - 1)).astype(np.int64)]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The sorted shingles of a set, the rare classes first and each class by hash; all 64 bits count."""
        rank = self._class(hashes)
        return (hashes[np.argsort(rank, kind="stable")] if rank.any() else hashes).view(np.int64)

    def parts(self, keys: np.ndarray) -> np.ndarray:
        """Into how many parts the list of a shingle is dealt: its length is known only to be less than its counter.

        One where counters are coarse: then lists are counted (see Join.dealt).
        """
        rank = self._class(keys.view(U64)).astype(np.int64)
        return np.maximum(1, (np.int64(self.edge) << rank) // BLOCK * ((rank > 0) & (not self.coarse)))


def boundary(sizes: dict[int, int], others: float) -> int:
    """The largest light size, by the cost of all postings and of what they meet.

    A set of n costs C(p, 2) postings as a light one, p being one more than its
    prefix; in the lists it costs its prefix, each posting with as many others
    as the sketch expects.  Sets above three quarters of the boundary stand in
    the lists as well.
    """
    pairs = lambda n: (n // 4 + 2) * (n // 4 + 1) // 2 if n > 1 else 0
    scan = lambda n: prefix(n) * (1 + others / 2)
    cost = lambda x: sum(c * ((pairs(n) if n <= x else 0) + (scan(n) if 4 * n > 3 * x else 0)) for n, c in sizes.items() if n <= 2 * MOST_LIGHT)
    return min(range(1, MOST_LIGHT + 1), key=cost)


POSTINGS = "key long, part int, sig long, n int, pos int"
LISTS = "kind int, key long, part int, sig long, n int, pos int, other long, m int"


def named(s: np.ndarray, clash: frozenset[int]) -> int:
    """The number that stands for a set: its first signature, or the second where the first stands for several sets."""
    first, second = signatures(s)
    return second if first in clash else first


def _post(order: Order, light: int, clash: frozenset[int]):
    """Postings; pos is -1 for a pair of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = [x.split()[0] for x in POSTINGS.split(", ")]
        for batch in slices(batches, 4 << 20):
            keys, sigs, sizes, places = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                if n < 2 or (sig := named(s, clash)) in seen:
                    continue
                seen.add(sig)
                k = order.keys(s)
                if n <= light:
                    p = k[: n // 4 + 2].view(U64)
                    i, j = np.triu_indices(len(p), 1)
                    pair = mix64(p[i] * U64(0x9E3779B97F4A7C15) + mix64(p[j]))
                    keys.append(pair.view(np.int64))
                    places.append(np.full(len(i), -1, np.int32))
                    sigs.append(sig)
                    sizes.append((n, len(i)))
                if 4 * n > 3 * light:
                    m = prefix(n)
                    keys.append(k[:m])
                    places.append(np.arange(m, dtype=np.int32))
                    sigs.append(sig)
                    sizes.append((n, m))
            if not keys:
                continue
            key, place = np.concatenate(keys), np.concatenate(places)
            times = np.array([m for _, m in sizes])
            sig = np.repeat(np.array(sigs, np.int64), times)
            n = np.repeat(np.array([n for n, _ in sizes], np.int32), times)
            parts = np.where(place >= 0, order.parts(key), 1)
            part = np.where(parts > 1, 1 + (sig.view(U64) % parts.view(U64)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part, pa.int32()), pa.array(sig), pa.array(n, pa.int32()), pa.array(place, pa.int32())], names)

    return run


def _could(na, nb, pa_, pb_, listed) -> np.ndarray:
    """Sizes and places that leave room for the overlap, if this is the first shingle that both hold."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    room = 1 + np.minimum(na - pa_, nb - pb_) - 1
    return (4 * small >= 3 * large) & (~listed | (room >= needed(na + nb)))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists with two members or more, and the pairs of neighbours in them; rows come sorted by list."""
    for stretch in whole_groups(batches, 2):
        yield from _lists_of(*(x.astype(np.int64) for x in stretch))


def _lists_of(key: np.ndarray, part: np.ndarray, sig: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    mixed = mix64(sig.view(U64) ^ mix64(key.view(U64)))  # another order in each list, so that chains differ
    order = np.lexsort((mixed, part, key))
    key, part, sig, n, pos = (x[order] for x in (key, part, sig, n, pos))
    same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    keep = ~np.concatenate([[False], same & (sig[1:] == sig[:-1])])
    key, part, sig, n, pos = (x[keep] for x in (key, part, sig, n, pos))
    same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    inside = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (part > 0)
    chained = np.flatnonzero(same & (pos[1:] < CHAIN_PLACES) & (pos[:-1] < CHAIN_PLACES) & _could(n[1:], n[:-1], pos[1:], pos[:-1], pos[1:] >= 0))
    a, b = np.minimum(sig[chained], sig[chained + 1]), np.maximum(sig[chained], sig[chained + 1])
    na = np.where(a == sig[chained], n[chained], n[chained + 1])
    nb = n[chained] + n[chained + 1] - na
    names, m = [x.split()[0] for x in LISTS.split(", ")], len(a)
    if m:
        _, first = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
        a, b, na, nb, m = a[first], b[first], na[first], nb[first], len(first)
        nulls = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m), pa.int32()), nulls, pa.nulls(m, pa.int32()), pa.array(a), pa.array(na, pa.int32()), pa.nulls(m, pa.int32()), pa.array(b), pa.array(nb, pa.int32())], names)
    at = np.flatnonzero(inside)
    at = at[(part[at] > 0) | _partnered(key[at], part[at], n[at], pos[at])]
    for i in range(0, len(at), 1 << 16):
        x = at[i : i + (1 << 16)]
        m = len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m), pa.int32()), pa.array(key[x]), pa.array(part[x], pa.int32()), pa.array(sig[x]), pa.array(n[x], pa.int32()), pa.array(pos[x], pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names)


def _partnered(key: np.ndarray, part: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which members of lists have another whose size and place leave room for a link."""
    out = np.zeros(len(key), bool)
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(edge, len(key)))
    for width in np.unique(size).tolist():
        starts = edge[size == width]
        step = max(1, (1 << 18) // (width * width))
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None] + np.arange(width)
            for i in range(0, width, 256):  # rows of long lists in portions
                a, b = at[:, i : i + 256, None], at[:, None, :]
                could = _could(n[a], n[b], pos[a], pos[b], pos[a] >= 0) & (a != b)
                out[at[:, i : i + 256]] = could.any(axis=2)
    return out


PAIRS = "a long, b long, na int, nb int"
#: Shingles of one block of a cluster.
CLUSTER_SHINGLES = 2_000_000


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow a link."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):  # bitmaps of long texts are long
            batch = whole.slice(i, 1024)
            rows = zip(*(batch.column(i).to_pylist() for i in (4, 5, 2, 3)), strict=True)
            keep = pa.array([may_link(*x) for x in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4]).filter(keep)


EDGES = "u long, v long"


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _near(now: tuple, held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
    """Components of one block of a list that some pair may link, as the edges of a forest."""
    t = pa.Table.from_batches(held)
    n, pos, comp, own = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "comp", "own"))
    if (comp == comp[0]).all():
        return []
    raw = t.column("bits").to_pylist()
    width = np.array([len(x) // 8 for x in raw])
    place, rows = np.zeros(len(raw), int), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        rows[w] = np.frombuffer(b"".join([raw[x] for x in at]), np.uint64).reshape(len(at), w)
    listed, across = pos >= 0, now[1] != now[2]
    _, label, counts = np.unique(comp, return_inverse=True, return_counts=True)
    large = label == counts.argmax()
    label, out, index = label.copy(), [], np.arange(len(comp))
    for i in np.flatnonzero(~large):  # the members of the largest component are met from the other side
        mask = (label != label[i]) & (large | (index > i)) & _could(n[i], n, pos[i], pos, listed[i])
        if across:
            mask &= own != own[i]
        j = np.flatnonzero(mask)
        if not len(j):
            continue
        most = n[i] + n[j] - 2 * needed(n[i] + n[j])
        mine = rows[width[i]][place[i]]
        for w in np.unique(width[j]).tolist():
            at = width[j] == w
            other, one = rows[w][place[j[at]]], mine
            while other.shape[1] > len(one):
                half = other.shape[1] // 2
                other = other[:, :half] ^ other[:, half:]
            differ = np.bitwise_count(other ^ folded(one, other.shape[1])).sum(axis=1, dtype=np.int64)
            for x in j[at][differ <= most[at]]:
                if label[x] != label[i]:
                    out.append((int(comp[i]), int(comp[x])))
                    label[label == label[x]] = label[i]
    return out


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted and are bounded, so one is held at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for at, piece in groups(batches, 3):
        if at != now:
            if held and (found := _near(now, held)):
                yield _edges(found)
            held, now = [], at
        held.append(piece)
    if held and (found := _near(now, held)):
        yield _edges(found)


class Block:
    """Inverted lists of the sets in one block of a cluster."""

    def __init__(self, held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        self.comp = t.column("comp").to_numpy().astype(np.int64)
        self.minor = t.column("minor").to_numpy(zero_copy_only=False).astype(bool)
        keys = t.column("keys").combine_chunks()
        self.size = keys.value_lengths().to_numpy().astype(np.int64)
        self.flat, self.ends = keys.flatten().to_numpy(), np.concatenate([[0], np.cumsum(self.size)])
        order = np.argsort(self.flat, kind="stable")
        self.keys, self.owner = self.flat[order], np.repeat(np.arange(len(self.size)), self.size)[order]

    def linked(self, keys: np.ndarray, comp: int) -> list[tuple[int, int]]:
        """Other components with a set that links to the given one, by counting along the lists of all its shingles."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        times = high - low
        total = int(times.sum())
        if not total:
            return []
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        overlap = np.bincount(self.owner[at], minlength=len(self.size))
        hit = (7 * overlap >= 3 * (self.size + len(keys))) & (self.comp != comp)
        return [(comp, int(c)) for c in np.unique(self.comp[hit])]


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of a cluster.  A block's sets come first, then sets of small components to be met with it, one after the other."""
    held: list[pa.RecordBatch] = []
    now, block = None, None

    def inside(b: Block) -> list[tuple[int, int]]:
        return [x for i in np.flatnonzero(b.minor) for x in b.linked(b.flat[b.ends[i] : b.ends[i + 1]], int(b.comp[i]))]

    for at, piece in groups(batches, 3):
        if at[:2] != now:
            if held and (found := inside(Block(held))):
                yield _edges(found)
            held, now, block = [], at[:2], None
        if at[2] == 0:
            held.append(piece)
            continue
        if block is None and held:
            block = Block(held)
            held = []
            if found := inside(block):
                yield _edges(found)
        if block is not None:
            keys, comps = piece.column(5), piece.column(3).to_numpy()
            flat, ends = keys.flatten().to_numpy(), np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy().astype(np.int64))])
            found = [x for i in range(len(comps)) for x in block.linked(flat[ends[i] : ends[i + 1]], int(comps[i]))]
            if found:
                yield _edges(found)
    if held and (found := inside(Block(held))):
        yield _edges(found)


class Join:
    """One run of the join over a table with doc_id (of any type that sorts) and text."""

    def __init__(self, docs: DataFrame):
        self.docs = pick(docs, "doc_id", "text")
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")

    def scan(self) -> None:
        """Sizes, signatures and bitmaps of all sets, and the order of shingles."""
        width = counters(text_bytes(self.docs), COUNTER_TEXT)
        found = self.scratch.save(self.docs.mapInArrow(trimmed(_scan(width)), SETS.format(self.docs.schema["doc_id"].dataType.simpleString())), "sets", "kind")
        sets = found.filter("kind = 0")
        self.clash = self.clashes(sets)
        sig = F.when(F.col("sig").isin(list(self.clash)), F.col("alt")).otherwise(F.col("sig")) if self.clash else F.col("sig")
        sets = sets.withColumn("sig", sig)
        self.rows = sets.select("doc_id", "n", "sig")
        # one row for each set, written, so that what needs one reads no other rows
        self.reps = self.scratch.save(self.rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "reps")
        self.bits = sets.filter("bits is not null").select("sig", "bits").groupBy("sig").agg(F.first("bits").alias("bits"))
        counts = np.zeros(width, np.int64)
        summed = found.filter("kind = 1").select("block", F.posexplode("counts")).groupBy((F.col("block") * ROW + F.col("pos")).alias("at")).agg(F.sum("col").alias("n"))
        table = summed.toArrow()  # MOST_COUNTERS rows at most
        counts[table.column("at").to_numpy()] = table.column("n").to_numpy()
        sizes = {r["size"]: r["count"] for r in self.rows.groupBy(F.least("n", F.lit(2 * MOST_LIGHT + 1)).alias("size")).count().collect()}
        self.order = Order(counts)
        self.light = boundary({n: c for n, c in sizes.items() if n > 1}, self.order.others)

    def clashes(self, sets: DataFrame) -> frozenset[int]:
        """First signatures that stand for several sets; of m sets about m^2 / 2^65 are, three of 10^10."""
        twice = sets.groupBy("sig").agg(F.min("alt").alias("low"), F.max("alt").alias("high")).filter("low <> high").select("sig")
        return frozenset(r["sig"] for r in twice.collect())

    def dealt(self, posts: DataFrame) -> DataFrame:
        """Postings with the lists of more than BLOCK entries dealt into parts, by exact counts that are added up before they are shuffled."""
        posts = self.scratch.save(posts, "postings")
        long = posts.filter("pos >= 0").groupBy("key").count().filter(F.col("count") > BLOCK)
        long = self.scratch.save(long.select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("parts")), "long")
        part = F.when((F.col("pos") >= 0) & F.col("parts").isNotNull(), 1 + F.pmod("sig", "parts")).otherwise(0)
        return join_wide(posts, long, "key", "left").select("key", part.cast("int").alias("part"), "sig", "n", "pos")

    def lists(self) -> None:
        order, light = self.order, self.light
        posts = self.docs.mapInArrow(trimmed(_post(order, light, self.clash)), POSTINGS)
        posts = (self.dealt(posts) if order.coarse else posts).repartition("key", "part").sortWithinPartitions("key", "part")
        found = self.scratch.save(posts.mapInArrow(trimmed(_lists), LISTS), "lists", "kind")
        chained = found.filter("kind = 0").select(F.col("sig").alias("a"), F.col("other").alias("b"), F.col("n").alias("na"), F.col("m").alias("nb"))
        self.entries = found.filter("kind = 1").select("key", "part", "sig", "n", "pos")
        # parts of one list meet through the least member of each
        heads = self.entries.filter("part > 0").groupBy("key", "part").agg(F.min(F.struct("sig", "n")).alias("h"))
        first = heads.groupBy("key").agg(F.min("h").alias("f"))
        across = heads.join(first, "key").filter("h.sig <> f.sig").select(F.col("f.sig").alias("a"), F.col("h.sig").alias("b"), F.col("f.n").alias("na"), F.col("h.n").alias("nb"))
        self.chained = self.checked_bits(chained.unionByName(across).distinct())

    def checked_bits(self, pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(self.bits.toDF("a", "bits_a"), "a")
        both = with_a.join(self.bits.toDF("b", "bits_b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
        return both.mapInArrow(_filtered, PAIRS)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """sig and keys of the sets with the wanted signatures, and of some others.

        Sets are made again for one text of each signature; a filter of fixed
        size on doc_id keeps most others out, and a join drops the rest.
        """
        reps = self.reps.join(wanted.select("sig").distinct(), "sig", "left_semi")
        filled = key_filter(reps, "doc_id")
        sent, order, clash = self.spark.sparkContext.broadcast(filled), self.order, self.clash

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in slices(batches):
                hit = np.ones(batch.num_rows, bool)
                for k in (1, 2):
                    place = batch.column(k).to_numpy(zero_copy_only=False)
                    hit &= (sent.value[place >> 3] >> (place & 7) & 1).astype(bool)
                sigs, found = [], []
                for x in shingle_sets(batch.column(0).filter(pa.array(hit))):
                    if len(x) and (sig := named(x, clash)) not in seen:
                        seen.add(sig)
                        sigs.append(sig)
                        found.append(order.keys(x))
                if sigs:
                    edges = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(found)))], ["sig", "keys"])

        b1, b2 = filter_places("doc_id")
        return self.docs.select("text", b1.alias("b1"), b2.alias("b2")).mapInArrow(trimmed(make), "sig long, keys array<long>").groupBy("sig").agg(F.first("keys").alias("keys"))

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """a and b of the pairs that link, by the sets themselves."""
        pairs = self.scratch.save(pairs, f"{name}-pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("sig")))
        both = pairs.join(sets.toDF("a", "keys_a"), "a").join(sets.toDF("b", "keys_b"), "b")
        overlap = F.size(F.array_intersect("keys_a", "keys_b"))
        return self.scratch.save(both.filter(7 * overlap >= 3 * (F.col("na") + F.col("nb"))).select("a", "b"), f"{name}-links")

    def near(self, comps: DataFrame) -> DataFrame:
        """Edges between components that some pair of a list may link, as far as sizes, places and bitmaps tell; a forest for each block.

        Of a list's members those of its largest component never meet each
        other: they go to the blocks of the others alone, and so a list that is
        nearly one component costs its length.
        """
        e = self.entries.drop("part").join(comps, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", "pos", F.coalesce("comp", "sig").alias("comp"))
        e = self.scratch.save(e, "open")
        by_comp = e.groupBy("key", "comp").agg(F.count("*").alias("c"))
        open_ = by_comp.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
        one = F.col("c") <= BLOCK  # a list that fits in one block is not divided
        open_ = open_.select("key", F.col("top.comp").alias("large"), F.when(one, 1).otherwise(F.ceil((F.col("c") - F.col("top.c")) / BLOCK)).alias("small_blocks"), F.when(one, 0).otherwise(F.ceil(F.col("top.c") / BLOCK)).alias("large_blocks"))
        small, all_ = F.col("small_blocks"), F.col("small_blocks") + F.col("large_blocks")
        e = join_few(e, open_, "key").withColumn("minor", (F.col("comp") != F.col("large")) | (F.col("large_blocks") == 0))
        hashed = F.xxhash64("sig")
        e = e.withColumn("own", F.when(F.col("minor"), F.pmod(hashed, small)).otherwise(small + F.pmod(hashed, F.col("large_blocks"))))
        e = e.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("minor"), all_).otherwise(small) - 1)))
        e = e.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig", "n", "pos", "comp", "own").join(self.bits, "sig")
        dealt = e.select("key", "i", "j", "n", "pos", "comp", "own", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return dealt.mapInArrow(trimmed(_within), EDGES).distinct()

    def rest(self, comps: DataFrame) -> DataFrame:
        """Links between components.

        Components that may be linked form clusters.  Each set of a cluster goes
        once to a block of it, and the sets outside the cluster's largest
        component to all its blocks; there they scan the inverted lists.
        """
        near = components(self.near(comps), self.scratch, "near-comps").toDF("comp", "cluster")
        near = near.unionByName(near.select(F.col("cluster").alias("comp"), "cluster")).distinct()
        sizes = self.reps.join(comps, F.col("sig") == F.col("node"), "left")
        sizes = self.scratch.save(sizes.select("sig", "n", F.coalesce("comp", "sig").alias("comp")), "sizes")
        members = self.scratch.save(join_few(sizes, near, "comp").select("sig", "n", "comp", "cluster"), "members")
        by_comp = members.groupBy("cluster", "comp").agg(F.sum("n").alias("total"))
        shape = by_comp.groupBy("cluster").agg(F.max_by("comp", F.struct("total", "comp")).alias("large"), F.ceil(F.sum("total") / CLUSTER_SHINGLES).alias("blocks"))
        m = join_few(members, shape, "cluster").withColumn("minor", F.col("comp") != F.col("large")).join(self.sets(members), "sig")
        home = F.pmod(F.xxhash64("sig"), F.col("blocks"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.col("minor") & (j != home))
        at = F.explode(F.concat(F.array(F.struct(home.alias("j"), F.lit(0).alias("probe"))), F.transform(others, lambda j: F.struct(j.alias("j"), F.lit(1).alias("probe"))))).alias("at")
        dealt = m.select("cluster", at, "comp", "minor", "keys").select("cluster", "at.j", "at.probe", "comp", "minor", "keys")
        return dealt.repartition("cluster", "j").sortWithinPartitions("cluster", "j", "probe").mapInArrow(trimmed(_clusters), EDGES)

    def components(self) -> DataFrame:
        """node and comp of every signature that links to a smaller one."""
        self.scan()
        self.lists()
        first = self.verify(self.chained, "near")
        comps = components(first, self.scratch, "first")
        stars = comps.unionByName(self.rest(comps).toDF("node", "comp"))
        found = self.scratch.save(components(stars, self.scratch, "all"), "components")
        self.scratch.keep("sets", "reps", "components")
        return found

    def result(self) -> DataFrame:
        comps = self.components()
        least = self.reps.withColumnRenamed("doc_id", "least").join(comps, F.col("sig") == F.col("node"), "left")
        least = least.select("sig", "least", F.coalesce("comp", "sig").alias("comp"))
        ids = least.groupBy("comp").agg(F.min("least").alias("component_id"))
        by_sig = least.join(ids, "comp").select("sig", "component_id")
        joined = join_few(self.rows.filter("n > 0"), by_sig, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        empty = self.rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return joined.unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row.

    Null and empty texts, and texts without words, have no shingles, link with
    nothing and are their own component.  Rows with equal shingles are linked,
    repeated rows among them.  A null doc_id is no component's smallest; a
    component of null ids alone has a null id.  Empty table: no rows.
    """
    return Join(docs).result()


def row_key() -> Column:
    """128 bits that name a row by its doc_id and text."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit(":"), F.col("text")), F.lit("")))
    return F.unhex(F.md5(both))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The columns of documents; of each component one row stays, the first by doc_id and then by text.

    Rows are told apart by doc_id and text together, so different texts under
    one doc_id, or without one, are judged each in its own component.  A row
    with a null doc_id stays only where its component has no other.  Rows
    without shingles link with nothing and all stay.
    """
    d = pick(docs, *DOCUMENT).withColumn("key", row_key())
    join = Join(d.select(F.col("key").alias("doc_id"), "text"))
    comps = join.components()
    scratch = join.scratch
    sigs = join.rows.filter("n > 0").select(F.col("doc_id").alias("key"), "sig").distinct()
    rows = d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
    rows = scratch.save(rows.join(sigs, "key").select("key", "doc_id", "times", "sig"), "by-key")
    rows = scratch.save(join_few(rows, comps.toDF("sig", "comp"), "sig", "left").select("key", "doc_id", "times", F.coalesce("comp", "sig").alias("comp")), "rows")
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("least"))
    fate = join_few(rows, least, "comp").withColumn("first", F.col("doc_id").eqNullSafe(F.col("least")))
    tied = fate.filter("first").groupBy("comp").agg(F.sum("times").alias("rows")).filter("rows > 1").select("comp", F.lit(True).alias("tied"))
    fate = scratch.save(fate.select("key", "comp", "first"), "first")
    fate = join_few(fate, tied, "comp", "left").filter("tied or not first").select("key", "comp", "first")
    fate = scratch.save(fate, "fate")
    told = scratch.save(fate.select("key"), "told")
    tied = scratch.save(fate.filter("first").select("key", "comp"), "tied")
    scratch.keep("told", "tied")
    one = W.partitionBy("comp").orderBy("text", "lang", "source", "n_chars")
    of_tied = join_wide(d, tied, "key", "inner").withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    return join_wide(d, told, "key", "left_anti").select(*DOCUMENT).unionByName(of_tied.select(*DOCUMENT))
