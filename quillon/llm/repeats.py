"""Exact removal of repeated byte strings, by bucketed suffix sorting.

Every string of LENGTH bytes belongs to the bucket of its least hashed k-gram,
so equal strings meet in one bucket.  Strings that follow each other in one
bucket form a run.  Runs of one text batch with equal bytes are repeats as a
whole.  Across batches, runs of one bucket with the same 128-bit fingerprint
form a class, and the bytes of two of its runs go to the sorter; of the other
runs those go that share their bucket with another class.  The strings sent are
sorted as suffixes, one bucket at a time, with long ties settled by the ranks
of a difference cover (see suffixes), and what the sorter finds for a class
holds for its runs.  A bucket that a count sketch shows to be large is dealt
out by fingerprint where runs meet, and by a second least k-gram where bytes
are sorted, so no task gets a whole large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, Scratch, buffers, counters, join_few, mix64, pick, slices, text_bytes, whole_groups
from quillon.llm.suffixes import repeated

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
#: Runs of a bucket, or classes of it, that stay together; bytes sorted at once, scanned at once, and remembered by a sending task.
BUCKET_RUNS, SORTED_BYTES, SCANNED_BYTES, SENT_BYTES = 1024, 1 << 20, 1 << 20, 1 << 25
#: Counters in one row of the sketch, and multiples of the mean from which a counter is large.
ROW, LARGE = 64, 8

_rng = np.random.Generator(np.random.PCG64(7919))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = _tables(1 << max(21, (n - 1).bit_length()))
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], dtype=U64, out=sums[1:])
    return sums


def hashes(sums: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of the strings of some size at some places."""
    return mix64((sums[at + size] - sums[at]) * powers(len(sums))[1][at])


def _least(x: np.ndarray, width: int, pick_=np.minimum) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick_(x[: len(x) - step], x[step:])
        have += step
    return x


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every run: text number, first and last start in it, bucket, and whether it may repeat within itself."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    if len(data) < LENGTH:
        return empty
    sums = prefix_sums(data)
    n = len(data) - GRAM + 1
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * powers(n)[1])
    least = _least(grams, SPAN)
    valid = np.zeros(len(least) + 1, np.int8)
    ends = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    some = ends > offsets[:-1]
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, np.minimum(ends[some], len(least)), -1)
    inside = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty
    value = least[starts]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    s, e, bucket = starts[first], starts[np.append(first[1:], len(starts)) - 1], value[first]
    doc = np.searchsorted(offsets, s, "right") - 1
    # k-grams that are the least of some string; two of one run next to each other
    shown = np.where(inside, least, U64(0))
    padded = np.concatenate([np.zeros(SPAN - 1, U64), shown, np.zeros(SPAN - 1, U64)])
    anchors = np.flatnonzero(_least(padded, SPAN, np.maximum) == grams)
    a1, a2 = anchors[:-1], anchors[1:]
    twice = (grams[a1] == grams[a2]) & (a2 - a1 <= SPAN)
    itself = e - s >= SPAN
    run_of = np.searchsorted(s, [a1[twice], np.maximum(a2[twice] - SPAN + 1, 0)], "right") - 1
    itself[np.unique(run_of[run_of >= 0])] = True
    return doc, s - offsets[doc], e - offsets[doc], bucket.view(np.int64), itself


def _count(width: int):
    """A count sketch of buckets over the runs of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for batch in slices(batches, SCANNED_BYTES):
            bucket = runs(*buffers(batch.column(0)))[3]
            at, times = np.unique(bucket & (width - 1), return_counts=True)
            counts[at] += times
        rows = counts.reshape(-1, ROW)
        filled = np.flatnonzero(rows.any(axis=1))
        for k in range(0, len(filled), 1 << 14):
            some = filled[k : k + (1 << 14)]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * ROW, pa.int32()), pa.array(rows[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), values], ["block", "counts"])

    return run


class Large:
    """Into how many parts the runs of a bucket are dealt, by its counter; 0 for a bucket that stays together."""

    def __init__(self, counts: np.ndarray):
        edge = max(BUCKET_RUNS, LARGE * counts.mean())
        self.parts = np.where(counts > edge, np.minimum(-(-counts // BUCKET_RUNS), 60_000), 0).astype(np.uint16)

    def of(self, key: np.ndarray) -> np.ndarray:
        return self.parts[key & (len(self.parts) - 1)].astype(np.int64)


RUNS = "key long, part int, f1 long, f2 long, kind int, gid long, s int, e int, times int"
RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]
#: Set in ``times`` of a run that may repeat within itself.
ITSELF = 4


def _run_rows(key, part, f1, f2, kind, gid, s, e, times) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(gid)), t) for x, t in zip((key, part, f1, f2, kind, gid, s, e, times), types, strict=True)], RUN_NAMES)


def _scan(large: Large):
    """Runs by bucket.  What repeats within a batch, byte by byte, is settled here: its intervals are rows of kind 0, and one run of it goes on with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found, texts = [], []
            for batch in slices([whole], SCANNED_BYTES):
                data, offsets = buffers(batch.column(1))
                doc, s, e, bucket, itself = runs(data, offsets)
                raw, low = memoryview(data), offsets[doc] + s
                pieces = list(zip(low.tolist(), (offsets[doc] + e + LENGTH).tolist(), strict=True))
                prints = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in pieces]), np.int64).reshape(-1, 2)
                texts += [raw[a:b] for a, b in pieces]
                found.append((batch.column(0).to_numpy(zero_copy_only=False)[doc], s, e, bucket, prints[:, 0], prints[:, 1], itself))
            if not texts:
                continue
            gid, s, e, key, f1, f2, itself = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((f2, f1, key))
            gid, s, e, key, f1, f2, itself = (x[order] for x in (gid, s, e, key, f1, f2, itself))
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])])
            at = np.flatnonzero(first)
            times = np.diff(np.append(at, len(gid)))
            again = np.repeat(times > 1, times)
            head = np.repeat(at, times)
            if any(texts[order[i]] != texts[order[head[i]]] for i in np.flatnonzero(again & ~first)):
                raise ValueError("two different runs have one fingerprint of 128 bits")
            if again.any():
                g, a, b = joined(gid[again], s[again], e[again])
                yield _run_rows(mix64(g.view(U64)).view(np.int64), 0, 0, 0, 0, g, a, b, 0)
            parts = large.of(key[at])
            part = np.where(parts > 0, 1 + (f1[at].view(U64) % np.maximum(parts, 1).view(U64)).astype(np.int64), 0)
            yield _run_rows(key[at], part, f1[at], f2[at], 1, gid[at], s[at], e[at], np.minimum(times, 2) + ITSELF * itself[at])

    return run


def joined(gid: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of one text as one."""
    order = np.lexsort((s, gid))
    gid, s, e = gid[order], s[order], e[order]
    new = np.concatenate([[True], (gid[1:] != gid[:-1]) | (s[1:] > e[:-1] + 1)]) if len(gid) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return gid[at], s[at], np.maximum.reduceat(e, at) if len(at) else e


MET = "kind int, gid long, s int, e int, key long, f1 long, f2 long, needed boolean, cls boolean, dealt boolean"
SETTLED, ASKED, MEMBER = 0, 1, 2


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled intervals, the runs whose bytes the sorter needs, and the runs of classes with several runs; rows come sorted by bucket and fingerprint."""
    names = [x.split()[0] for x in MET.split(", ")]

    def rows(kind, g, a, b, k, f1, f2, need, cls, dealt):
        n, types = len(g), [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, n), t) for x, t in zip((kind, g, a, b, k, f1, f2, need, cls, dealt), types, strict=True)], names)

    for key, part, f1, f2, kind, gid, s, e, times in whole_groups(batches, 2):
        x = kind == 0
        if x.any():
            g, a, b = joined(gid[x], s[x], e[x])
            yield rows(SETTLED, g, a, b, 0, 0, 0, False, False, False)
        key, part, f1, f2, gid, s, e, times = (v[~x] for v in (key, part, f1, f2, gid, s, e, times))
        if not len(key):
            continue
        bucket = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        first = bucket.copy()
        first[1:] |= (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
        at, edge = np.flatnonzero(first), np.flatnonzero(bucket[first])
        several = np.diff(np.append(at, len(key))) > 1
        once = (np.add.reduceat(times % ITSELF, at) == 1) & ~several
        itself = np.add.reduceat(times // ITSELF, at) > 0
        size = np.diff(np.append(edge, len(at)))
        large = part[at][edge] > 0  # the bucket has other parts, which may need any run of this one
        open_ = np.logical_or.reduceat(once | several, edge)
        send = several | np.repeat(large | ((size > 1) & open_), size) | (once & itself)
        dealt = np.repeat((size > BUCKET_RUNS) | large, size)
        asked = at[send]
        if len(asked):
            yield rows(ASKED, gid[asked], s[asked], e[asked], key[asked], f1[asked], f2[asked], (once | several)[send], several[send], dealt[send])
        second = at[several] + 1
        if len(second):
            yield rows(ASKED, gid[second], s[second], e[second], key[second], f1[second], f2[second], False, True, dealt[several])
            member = np.repeat(several, np.diff(np.append(at, len(key))))
            yield rows(MEMBER, gid[member], s[member], e[member], key[member], f1[member], f2[member], False, True, False)


#: bytes is null in a row that says what has been found: the starts from s to ``to``.  gid is null in what is said of a class, with s counted from its run's first start.
SENT = "key long, gid long, bucket long, f1 long, f2 long, s int, to int, needed boolean, bytes binary"
SENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


def _cut(piece: bytes) -> tuple[list[int], list[int], list[int]]:
    """The runs of a piece by a second least k-gram: first and last starts, and the k-gram's hash."""
    sums = prefix_sums(np.frombuffer(piece, np.uint8))
    n = len(piece) - GRAM + 1
    least = _least(mix64(((sums[GRAM:] - sums[:-GRAM]) * powers(n)[1]) ^ _SECOND), SPAN)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first.tolist(), (np.append(first[1:], len(least)) - 1).tolist(), least[first].view(np.int64).tolist()


_SECOND = U64(0xD1B54A32D192ED03)


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for.

    The runs of a large bucket are cut by a second least k-gram, and of equal
    pieces that one task meets only the first is sent: the others are found
    already, and so is it.
    """
    seen: dict[tuple[int, bytes], list] = {}
    held = 0
    for batch in slices(batches, SCANNED_BYTES):
        out: list[tuple] = []
        for gid, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = text.encode()
            for r in asked:
                piece = data[r["s"] : r["e"] + LENGTH]
                who = (None, r["key"], r["f1"], r["f2"]) if r["cls"] else (gid, None, None, None)
                zero = 0 if r["cls"] else r["s"]
                if not r["dealt"]:
                    out.append((r["key"], *who, zero, 0, r["needed"], piece))
                    continue
                for a, b, value in zip(*_cut(piece), strict=True):
                    key, part = (r["key"] ^ value) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, piece[a : b + LENGTH]
                    key -= (key >> 63) << 64
                    mine = (key, *who, zero + a, zero + b, False, None)
                    first = seen.get((key, part))
                    if first is None:
                        out.append((key, *who, zero + a, 0, r["needed"], part))
                        seen[key, part] = [mine if r["needed"] else None]
                        held += len(part)
                        continue
                    if r["needed"]:
                        out.append(mine)
                    if first[0] is not None:
                        out.append(first[0])
                        first[0] = None
        if held > SENT_BYTES:
            seen.clear()
            held = 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SENT_TYPES, strict=True)], SENT_NAMES)


FOUND = "gid long, bucket long, f1 long, f2 long, s int, e int"


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that repeat in a bucket, by suffix sorting.

    Buckets come one after the other; small ones are sorted together.  A bucket
    that grows beyond what is sorted at once is sorted in portions: of every
    string one stays for the next portion.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    held: list[tuple] = []  # bucket number, who, s, needed, bytes, starts (null: all)
    size, buckets, now = 0, 0, None

    def flush(carry: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        data = np.frombuffer(b"".join([*(x[4] for x in held), bytes(LENGTH + 8)]), np.uint8)
        base = np.cumsum([0, *(len(x[4]) for x in held)])
        local = [np.arange(len(x[4]) - LENGTH + 1) if x[5] is None else x[5] for x in held]
        row = np.repeat(np.arange(len(held)), [len(x) for x in local])
        at = np.concatenate(local)
        dup, first = repeated(data, at + base[row], np.array([x[0] for x in held])[row], LENGTH)
        hit = dup & np.array([x[3] for x in held])[row]
        r, a = row[hit], at[hit]
        if len(r):
            r, s, e = joined(r, a, a)
            shift = np.array([x[2] for x in held], np.int64)[r]
            who = [held[i][1] for i in r.tolist()]
            ids = [pa.array([w[k] for w in who], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(s + shift, pa.int32()), pa.array(e + shift, pa.int32())], names)
        if not carry:
            held, size = [], 0
            return
        last, kept = held[-1][0], []
        for i in np.unique(row[first]).tolist():
            if held[i][0] != last:
                continue
            stay = at[(row == i) & first]
            fresh = stay[~dup[(row == i) & first]]
            number, who, s, need, piece, _ = held[i]
            if len(fresh) and need:
                kept.append((number, who, s, True, piece, fresh))
            old = np.setdiff1d(stay, fresh) if need else stay
            if len(old):
                kept.append((number, who, s, False, piece, old))
        held, size = kept, sum(len(x[4]) for x in kept)

    portion = SORTED_BYTES
    for batch in batches:
        for key, gid, bucket, f1, f2, s, to, need, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            who = (gid, bucket, f1, f2)
            if piece is None:
                yield pa.RecordBatch.from_arrays([*[pa.array([w], pa.int64()) for w in who], pa.array([s], pa.int32()), pa.array([to], pa.int32())], names)
                continue
            if key != now:
                if size >= SORTED_BYTES:
                    yield from flush(False)
                now, buckets, portion = key, buckets + 1, SORTED_BYTES
            elif size >= 2 * portion:
                yield from flush(True)
                portion = max(portion, size)  # what stays grows with the different strings alone
            held.append((buckets, who, s, need, piece, None))
            size += len(piece)
    if held:
        yield from flush(False)


def _spans(found: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"] + LENGTH) for r in found or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


KEPT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches, SCANNED_BYTES):
        cols: list[list] = [[], [], []]
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, at, kept = (text or "").encode(), 0, []
            spans = _spans(found)
            for s, e in spans:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            for c, v in zip(cols, (len(data), [{"start": s, "end": e} for s, e in spans], b"".join(kept)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), span, pa.binary()), strict=True))], ["doc_id", "n_bytes", "spans", "kept"])


class Repeats:
    """One search for repeated strings in a table with doc_id and text."""

    def __init__(self, docs: DataFrame):
        self.docs = pick(docs, "doc_id", "text")
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "repeats")

    def numbered(self) -> DataFrame:
        """gid names a row by its doc_id and text; rows with both equal have the same intervals.

        A hash of 64 bits that stands for different rows (three are expected
        among 10^10) gives way to a second one.
        """
        first, second = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1))
        clash = self.clashes(self.docs.select(first.alias("gid"), second.alias("alt")))
        gid: Column = F.when(first.isin(clash), second).otherwise(first) if clash else first
        return self.docs.select(gid.alias("gid"), "text", "doc_id")

    def clashes(self, ids: DataFrame) -> list[int]:
        twice = ids.groupBy("gid").agg(F.min("alt").alias("low"), F.max("alt").alias("high")).filter("low <> high").select("gid")
        return [r["gid"] for r in twice.collect()]

    def large(self) -> Large:
        width = counters(text_bytes(self.docs))
        found = self.docs.select("text").mapInArrow(_count(width), "block int, counts array<long>")
        table = found.select("block", F.posexplode("counts")).groupBy((F.col("block") * ROW + F.col("pos")).alias("at")).agg(F.sum("col").alias("n")).toArrow()
        counts = np.zeros(width, np.int64)  # as many rows at most
        counts[table.column("at").to_numpy()] = table.column("n").to_numpy()
        return Large(counts)

    def starts(self, d: DataFrame) -> DataFrame:
        """gid, s, e: first and last starts of strings of LENGTH bytes that also start elsewhere."""
        rows = d.select("gid", "text").mapInArrow(_scan(self.large()), RUNS)
        met = rows.repartition("key", "part").sortWithinPartitions("key", "part", "f1", "f2").mapInArrow(_meet, MET)
        met = self.scratch.save(met, "met", "kind")
        asked = met.filter(F.col("kind") == ASKED).groupBy("gid").agg(F.collect_list(F.struct("s", "e", "key", "f1", "f2", "needed", "cls", "dealt")).alias("asked"))
        # rows with an equal gid are classes of their own, so sending twice changes nothing
        sent = d.select("gid", "text").join(asked, "gid").select("gid", "text", "asked").mapInArrow(_send, SENT)
        found = sent.repartition("key").sortWithinPartitions("key", "gid", "f1", "f2", "s").mapInArrow(_sort, FOUND)
        found = self.scratch.save(found, "found")
        cls = F.struct("key", "f1", "f2").alias("cls")
        of_class = found.filter("gid is null").withColumnRenamed("bucket", "key").groupBy(cls).agg(F.collect_set(F.struct("s", "e")).alias("at"))
        members = met.filter(F.col("kind") == MEMBER).select(cls, "gid", F.col("s").alias("zero"))
        spread = join_few(members, of_class, "cls").select("gid", "zero", F.explode("at").alias("at"))
        spread = spread.select("gid", (F.col("zero") + F.col("at.s")).alias("s"), (F.col("zero") + F.col("at.e")).alias("e"))
        own = found.filter("gid is not null").select("gid", "s", "e")
        return met.filter(F.col("kind") == SETTLED).select("gid", "s", "e").unionByName(own).unionByName(spread)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, ends exclusive) and kept (the bytes left) for every row.

    Null and empty texts, and those under LENGTH bytes, lose nothing.  Repeated
    rows are texts of their own, so each is a repeat of the others.  Null ids
    stay.  Empty table: no rows.  A cut may fall inside a character, so what is
    kept is bytes.
    """
    search = Repeats(docs)
    d = search.numbered()
    spans = search.starts(d).groupBy("gid").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    return d.join(spans, "gid", "left").select("doc_id", "text", "found").mapInArrow(_keep, KEPT)


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what remove_repeats gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
