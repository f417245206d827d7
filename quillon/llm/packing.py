"""Packing documents into sequences by powers of two.

A document's tokens are cut, in order, into pieces of the full length and then
the powers of two that its remainder is made of, the largest first.  Every piece
is a sequence by itself, in the bucket of its length, so no sequence crosses
documents and none needs padding.

Nothing is shuffled: a task numbers the pieces of each length that it makes, and
the counts of all tasks, one row for each task and length, give where its
numbers begin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.bpe import BYTE_OF
from quillon.llm.common import Scratch, join_wide, pick, slices, trim

#: Tokens of a full sequence, and the id that ends a document.
FULL, END = 1024, 0
#: Pieces of one batch of the result.
BATCH = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of byte-level BPE, as the tokenizers library gives them without added special tokens.

    Where the merges of the vocabulary are in the order of its ids, they are
    applied by rank, which takes a sixth of the library's time; a text that this
    form cannot take (some 100,000 white spaces in a row) and any other
    vocabulary go to the library.
    """

    def __init__(self, path: str):
        self.path, self.library, self.ranked = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and len(vocab) == len(BYTE_OF) + len(merges) and all(vocab[a + b] == len(BYTE_OF) + i for i, (a, b) in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            ranks = {bytes(BYTE_OF[c] for c in token): i for token, i in vocab.items()}
            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            try:
                return self.ranked.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_lengths(sizes: np.ndarray, full: int = FULL) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of all documents' pieces in order, and the document of each.

    >>> piece_lengths(np.array([2051, 6]))[0].tolist()
    [1024, 1024, 2, 1, 4, 2]
    """
    powers = full >> np.arange(full.bit_length())
    counts = (sizes[:, None] % (2 * powers)) // powers  # the bits of the remainder
    counts[:, 0] = sizes // full
    lengths = np.repeat(np.tile(powers, len(sizes)), counts.ravel())
    return lengths.astype(np.int64), np.repeat(np.arange(len(sizes)), counts.sum(axis=1))


def _pieces(path: str, full: int):
    fields = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        made = np.zeros(full + 1, np.int64)  # pieces of each length so far
        for batch in slices(batches):
            end = np.array([END], np.uint32)
            found = [x for text in batch.column(1) for x in (encoder.ids(text.as_py() or ""), end)]
            sizes = np.array([len(x) + 1 for x in found[::2]], np.int64)
            ids = np.concatenate(found).astype("<u4")
            lengths, doc = piece_lengths(sizes, full)
            ends = np.cumsum(lengths)
            first = (np.cumsum(sizes) - sizes)[doc]
            nth = np.zeros(len(lengths), np.int64)
            for p in np.unique(lengths):
                at = np.flatnonzero(lengths == p)
                nth[at] = made[p] + np.arange(len(at))
                made[p] += len(at)
            doc_ids = batch.column(0).take(pa.array(doc))
            for a in range(0, len(lengths), BATCH):
                b = min(a + BATCH, len(lengths))
                begin = ends[a] - lengths[a]
                cuts = np.concatenate([[0], ends[a:b] - begin]) * 4
                data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids[begin : ends[b - 1]].tobytes())])
                starts = (ends - lengths - first)[a:b]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(starts), pa.array(lengths[a:b]), pa.array(sizes[doc[a:b]]), pa.array(np.full(b - a, task, np.int64)), pa.array(nth[a:b]), data], schema=fields
                )
        trim()

    return run


def pack(docs: DataFrame, full: int = FULL, vocabulary: str | None = None) -> DataFrame:
    """Every document's tokens, and an end id, as sequences whose lengths are powers of two.

    One row for each piece: doc_id, start (tokens of the document before it),
    length, doc_tokens (with the end id), sequence_id, offset (its place in the
    sequence, always 0), ids (4 bytes each, little-endian).  Sequences are
    numbered from 0 without gaps, longest first, so a bucket of equal lengths is
    a range of numbers.  ``full`` is a power of two.

    A null or empty text is its end id alone: one piece of one token.  Rows with
    null, equal or repeated doc_ids are documents each for itself.  A text of
    any length is encoded whole, in one task.  An empty table gives no rows.
    Other columns are left out.
    """
    if full < 1 or full & (full - 1):
        raise ValueError("a full sequence is a power of two long")
    scratch = Scratch(docs.sparkSession, "packing")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, doc_tokens long, task long, nth long, ids binary"
    pieces = scratch.save(rows.mapInArrow(_pieces(vocabulary or default_vocabulary(), full), schema), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    longer = counts.groupBy("length").agg(F.sum("n").alias("n"))  # one row for each power of two
    longer = longer.select("length", F.coalesce(F.sum("n").over(W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    begin = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(longer), "length")
    begin = begin.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", F.col("base") + F.col("before")))).alias("begin"))
    numbered = join_wide(pieces, scratch.save(begin, "begin"), "task", "inner")
    sequence = F.element_at("begin", F.col("length")) + F.col("nth")
    return numbered.select("doc_id", "start", "length", "doc_tokens", sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
