"""Blockwise suffix sorting with a difference cover, over a byte array in memory.

Suffixes are sorted bucket by bucket: by their first bytes directly, and where
these tie, by the precomputed ranks of a sample of positions.  The sample is a
difference cover: for any two suffixes some shift smaller than the period moves
both onto sample positions, so one comparison of ranks settles a long tie.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Period of the difference cover; bytes by which ties are refined at a time, and the bits they take.
PERIOD, STEP, BITS = 32, 5, 40


@lru_cache(maxsize=4)
def difference_cover(period: int = PERIOD) -> np.ndarray:
    """A small set of residues such that every difference modulo the period occurs."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda c: len(missing & ({(c - d) % period for d in cover} | {(d - c) % period for d in cover}))
        best = max(range(1, period), key=gain)
        missing -= {(best - d) % period for d in cover} | {(d - best) % period for d in cover}
        cover.append(best)
    return np.array(sorted(cover))


@lru_cache(maxsize=4)
def shifts(period: int = PERIOD) -> np.ndarray:
    """For two residues the least shift that moves both into the cover."""
    inside = np.isin(np.arange(2 * period) % period, difference_cover(period))
    r, s = np.arange(period)[:, None, None], np.arange(period)[None, None, :]
    both = inside[r + s] & inside[s + np.arange(period)[None, :, None]]
    return both.argmax(axis=2)


def words_at(data: np.ndarray) -> np.ndarray:
    """The STEP bytes from every position on as one number, in the order of the bytes."""
    n = len(data) - 7
    eights = np.ndarray((n,), ">u8", buffer=np.ascontiguousarray(data).data, strides=(1,))
    return (eights.astype(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def steps(start: int, stop: int) -> list[int]:
    """Where the words begin that cover the bytes from start to stop; the last may overlap."""
    return [*range(start, stop - STEP, STEP), stop - STEP]


def split(rank: np.ndarray, active: np.ndarray, word: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Refines the ranks of the active items, which come in order of rank, by a further key; returns those still tied, in order.

    A rank is the place of the first item of its group, so groups split within
    their own range.  A group's number and the key are sorted as one number.
    """
    if not len(active):
        return active
    r = rank[active]
    group = np.zeros(len(r), np.int64)
    np.cumsum(r[1:] != r[:-1], out=group[1:])
    if int(group[-1]) >> (63 - bits):
        raise ValueError("too many suffixes for one sort")
    key = group << bits | word
    order = np.argsort(key, kind="stable")
    a, key = active[order], key[order]
    sub = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.arange(len(a))
    new = np.concatenate([[True], r[1:] != r[:-1]])
    first, start = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(sub, at, 0))
    rank[a] = r + (start - first)
    tied = ~sub
    tied[:-1] |= ~sub[1:]
    return a[tied]


def cover_ranks(words: np.ndarray, at: np.ndarray, n: int, length: int) -> np.ndarray:
    """Ranks of the ``length`` bytes from each of some positions on, at those positions."""
    rank, active = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in steps(0, length):
        active = split(rank, active, words[at[active] + k])
        if not len(active):
            break
    out = np.full(n, -1, np.int64)
    out[at] = rank
    return out


def sample(starts: np.ndarray, n: int, period: int = PERIOD) -> np.ndarray:
    """The cover positions that comparisons of the starts can ask for."""
    near = np.zeros(n + period, np.int32)
    np.add.at(near, starts, 1)
    near[period:] -= near[:-period].copy()
    inside = np.cumsum(near[:n], dtype=np.int32) > 0
    wanted = np.zeros(n, bool)
    for residue in difference_cover(period).tolist():
        wanted[residue::period] = inside[residue::period]
    return np.flatnonzero(wanted)


def repeated(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int = 200, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """Whether the ``length`` bytes at each start also begin at another start of the same bucket, and whether a start is the one of its string that sorts first.

    data ends with 8 bytes or more after the last string.  Buckets are whole
    numbers; buckets that fit in memory together are sorted together.
    """
    n = len(data) - 7
    words, delta = words_at(data), shifts(period)
    block = length - period + 1
    order = np.argsort(bucket, kind="stable")
    edge = np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])
    rank = np.zeros(len(starts), np.int64)
    rank[order] = np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))
    active = order
    for k in steps(0, period):
        active = split(rank, active, words[starts[active] + k])
    if len(active):
        ranks = cover_ranks(words, sample(starts[active], n, period), n, block)
    done = []
    while len(active):  # three-way partition of every tied group by its middle member
        r = rank[active]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        size = np.diff(np.append(at, len(active)))
        own, pivot = starts[active], np.repeat(starts[active[at + size // 2]], size)
        d = delta[pivot % period, own % period]
        side = np.sign(ranks[own + d] - ranks[pivot + d])
        # ranks tell of the first block + d bytes, which differ by pair; what is left of length bytes is compared too, so that equal strings stay together
        for k in steps(length - period, length):
            tied = np.flatnonzero(side == 0)
            side[tied] = np.sign(words[own[tied] + k] - words[pivot[tied] + k])
        left = split(rank, active, side.astype(np.int64) + 1, 2)
        keep = np.zeros(len(rank), bool)
        keep[active[side == 0]] = True
        done.append(left[keep[left]])
        active = left[~keep[left]]
    active = np.concatenate(done) if done else np.zeros(0, np.int64)
    active = active[np.argsort(rank[active], kind="stable")]
    out = np.zeros(len(starts), bool)
    out[active] = True
    first = ~out
    if len(active):
        first[active[np.concatenate([[True], rank[active][1:] != rank[active][:-1]])]] = True
    return out, first
