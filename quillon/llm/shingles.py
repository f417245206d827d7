"""Distinct word shingles of texts as sorted arrays of hashes, worked out for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillon.llm.common import U64, buffers, mix64

WORDS = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One odd random number for each place in a shingle.
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * U64(2) + U64(1)
_GOLDEN = U64(0x9E3779B97F4A7C15)
#: Bytes with A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What is left of 8 bytes, read as a little-endian number, when a word has so many.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the number of words before each text.

    A word is cut into pieces of 8 bytes.  Each piece is mixed by itself
    together with its place, and the mixed pieces add up; so no arithmetic
    between pieces can cancel, however a long word is built.
    """
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1] | False
    edge = offsets[:-1][np.diff(offsets) > 0]
    starts[edge] = ~space[edge]
    at = np.flatnonzero(starts)
    before = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, U64), before
    stops = space.copy()
    stops[edge] = True
    ends = np.append(np.flatnonzero(stops), len(data))
    lengths = ends[np.searchsorted(ends, at, "right")] - at
    low = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=low[: len(data)])
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=low.data, strides=(1,))
    hashes = mix64((eights[at] & _KEEP[np.minimum(lengths, 8)]) + _GOLDEN)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) // 8
        first = np.cumsum(more) - more
        j = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        place = np.repeat(at[long], more) + 8 * j
        left = np.minimum(np.repeat(lengths[long], more) - 8 * j, 8)
        pieces = (eights[place] & _KEEP[left]) ^ mix64((j + 1).astype(U64) * _GOLDEN)
        hashes[long] += np.add.reduceat(mix64(pieces), first)
    return mix64(hashes + lengths.astype(U64) * _GOLDEN), before


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    Fewer words than a shingle has are one shingle; null and empty texts, and
    texts of white space, have none.
    """
    data, offsets = buffers(column)
    hashes, before = word_hashes(data, offsets)
    n = len(hashes)
    full = np.zeros(max(n - words + 1, 0), U64)
    for k in range(words):
        full += hashes[k : n - words + 1 + k] * _PLACE[k] if len(full) else U64(0)
    full = mix64(full)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(full[a : b - words + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix64(np.array([(hashes[a:b] * _PLACE[: b - a]).sum(dtype=U64) + U64(b - a)], U64))
        else:
            yield np.zeros(0, U64)


def signatures(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers for a whole set, from a state of 128 bits, so that the second tells sets apart whose first is equal."""
    if not len(hashes):
        return 0, 0
    with np.errstate(over="ignore"):
        total, odd = mix64(hashes).sum(dtype=U64), np.bitwise_xor.reduce(mix64(hashes * _PLACE[1]))
        state = np.array([total * _PLACE[0] + odd + U64(len(hashes)), total ^ (odd * _PLACE[2] + _GOLDEN)], U64)
    first, second = mix64(state).view(np.int64).tolist()
    return first, second
