"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

A candidate is a long run of characters that keys are written in.  The class of
a window's own characters (hex, letters and digits, base64) sets the bits that
it must reach, so a key counts alike alone and after ``id=``.  The window's
entropy is kept by counts: a step changes two counts and two terms of a sum.
Windows above the bits join into spans.  An allow-list takes spans back;
it never touches what the fixed patterns found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import pick, slices

#: The patterns of the base kinds, in the order that kinds are listed, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class Entropy:
    """Window length, the bits a window must reach by class of its characters, and the allow-list."""

    window: int = 20
    hex_bits: float = 3.0
    alnum_bits: float = 3.6
    base64_bits: float = 3.8
    allow: tuple[str, ...] = (
        r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
        r"[A-Za-z]+(?:[_-][A-Za-z]+)*",
        r"[0-9]+",
        r"(?:/[A-Za-z0-9_-]{1,18}){2,}/?",
        r"[-=_+/]+",
    )


def window_bits(text: str, width: int) -> Iterator[float]:
    """The Shannon entropy of every window of a text, by incremental counts."""
    counts: dict[str, int] = {}
    term = [0.0, 0.0] + [n * log2(n) for n in range(2, width + 1)]
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= width:
            old = text[i - width]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
        if i >= width - 1:
            yield log2(width) - total / width


def bits_needed(candidate: str, rule: Entropy) -> float | None:
    """By class; a candidate of letters alone is a word, not a key."""
    digits = any(c.isdigit() for c in candidate)
    letters = any(c.isalpha() for c in candidate)
    if not (digits and letters):
        return None
    if all(c in "0123456789abcdefABCDEF" for c in candidate):
        return rule.hex_bits
    return rule.alnum_bits if candidate.isalnum() else rule.base64_bits


def window_needs(candidate: str, rule: Entropy, need: float) -> Iterator[float]:
    """The bits of every window by its own class; a window without digits or without letters has the candidate's, ``need``."""
    digit = letter = not_hex = not_alnum = -1
    for i, c in enumerate(candidate):
        if c.isdigit():
            digit = i
        elif c.isalpha():
            letter = i
            if c not in "abcdefABCDEF":
                not_hex = i
        else:
            not_hex = not_alnum = i
        start = i - rule.window + 1
        if start >= 0:
            if digit < start or letter < start:
                yield need
            elif not_hex < start:
                yield rule.hex_bits
            else:
                yield rule.alnum_bits if not_alnum < start else rule.base64_bits


def entropy_spans(text: str, rule: Entropy, allowed: re.Pattern) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        need = bits_needed(candidate, rule)
        if need is None or allowed.fullmatch(candidate):
            continue
        start = end = None
        for i, (bits, least) in enumerate(zip(window_bits(candidate, rule.window), window_needs(candidate, rule, need), strict=True)):
            if bits >= least:
                if end is not None and i <= end:
                    end = i + rule.window
                else:
                    if start is not None:
                        out.append((m.start() + start, m.start() + end))
                    start, end = i, i + rule.window
        if start is not None:
            out.append((m.start() + start, m.start() + end))
    return [(a, b) for a, b in out if not allowed.fullmatch(text, a, b)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns; leftmost and without overlaps in each kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def by_place(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return sorted(spans, key=lambda x: (x[0], x[2], x[1]))


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every span, overlaps joined, put as ``mark``."""
    out, at = [], 0
    for a, b, _ in by_place(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string, masked string"


def scan(docs: DataFrame, rule: Entropy | None = None, mark: str = "[SECRET]", mask: bool = False) -> DataFrame:
    """doc_id and the secrets of every whole text, with the masked text if asked for.

    Null text counts as empty and has no spans; its masked text is null.  Null
    ids and repeated rows stay; an empty table gives no rows.  Offsets count
    code points, ends are exclusive.
    """
    rule = rule or Entropy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile("|".join(rule.allow) or "(?!)")
        for batch in slices(batches, 4 << 20):
            cols: list[list] = [[] for _ in range(7)]
            for raw in batch.column(1).to_pylist():
                text = raw or ""
                base = by_place(base_spans(text))
                more = [(a, b, 3) for a, b in entropy_spans(text, rule, allowed)]
                spans = by_place(base + more) if more else base
                for k in range(3):
                    cols[k].append(sum(x[2] == k for x in base))
                cols[3].append(len(more))
                cols[4].append(sha256(written(base).encode()).hexdigest())
                cols[5].append(written(spans))
                cols[6].append((masked(raw, spans, mark) if spans else raw) if mask and raw is not None else None)
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *(x.split()[0] for x in FOUND.split(", "))])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {FOUND}")


def mask_documents(docs: DataFrame, rule: Entropy | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The columns of documents, with every secret of the text put as ``mark`` and n_chars counted anew."""
    rule = rule or Entropy()
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile("|".join(rule.allow) or "(?!)")
        for batch in slices(batches, 4 << 20):
            texts = []
            for raw in batch.column(1).to_pylist():
                spans = [] if raw is None else base_spans(raw) + [(a, b, 3) for a, b in entropy_spans(raw, rule, allowed)]
                texts.append(masked(raw, spans, mark) if spans else raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], batch.schema.names)

    return d.mapInArrow(run, d.schema).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
