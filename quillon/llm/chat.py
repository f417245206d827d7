"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose spans of whole turns.  Every window after the
first repeats the system turn and a few turns of history, each within a share
of the budget and only as far as they fit with the turn that opens the window;
repeated text is kept out of the loss mask, so each assistant text is a target
once.  Tokens are those of turns as they are formatted, marks and escapes
included, and are counted before conversations are gathered.
Rows then stream in order of turns, so a conversation of any length needs the
memory of one window.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import default_vocabulary
from quillon.llm.common import pick, slices
from quillon.llm.token_counts import counter

ESCAPED = re.compile(r"[\\<\[\]]")
TURN = re.compile(r"<s>\[((?:[^\\\]]+|\\.)*)\]\n((?:[^\\<]+|\\.)*)\n</s>\n", re.DOTALL)

WINDOWS = "conv_id long, window int, text string, loss array<struct<start:int,end:int>>, repeated int, n_turns int, n_tokens long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """The text with a backslash before every character that a mark needs, so that none of it reads as a mark."""
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(role: str, text: str) -> tuple[str, int]:
    """A turn between its marks, and the place of its text."""
    head = f"<s>[{escape(role)}]\n"
    return f"{head}{escape(text)}\n</s>\n", len(head)


def parsed(window: str) -> list[tuple[str, str]]:
    """The turns of a window, read back."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(window)]


@dataclass(frozen=True)
class Budget:
    """Tokens of a window; the share of them that the repeated system turn may take; turns of history that it may repeat, and their share."""

    tokens: int = 1024
    system_share: float = 0.5
    history: int = 4
    history_share: float = 0.25


@dataclass
class Conversation:
    """The open window of one conversation."""

    conv_id: int | None
    budget: Budget
    system: list[tuple[str, str, int]] = field(default_factory=list)
    history: deque = field(default_factory=deque)
    again: list[tuple[str, str, int]] = field(default_factory=list)
    new: list[tuple[str, str, int]] = field(default_factory=list)
    repeated: int = 0
    new_tokens: int = 0
    turns: int = 0
    windows: int = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        if self.new and self.repeated + self.new_tokens + tokens > self.budget.tokens:
            yield self.close()
        turn = (role, text, tokens)
        if not self.new and self.turns:
            self.repeat(tokens)
        if role == "system" and not self.turns and tokens <= self.budget.tokens * self.budget.system_share:
            self.system = [turn]
        else:
            self.history.append(turn)
            if len(self.history) > self.budget.history:
                self.history.popleft()
        self.new.append(turn)
        self.new_tokens += tokens
        self.turns += 1

    def repeat(self, tokens: int) -> None:
        """Chooses what the window repeats before a turn of so many tokens: the system turn, then the latest history."""
        room = self.budget.tokens - tokens
        first = [t for t in self.system if t[2] <= room]
        left, latest = min(self.budget.tokens * self.budget.history_share, room - sum(t[2] for t in first)), []
        for turn in reversed(self.history):
            if turn[2] > left:
                break
            left -= turn[2]
            latest.append(turn)
        self.again = first + latest[::-1]
        self.repeated = sum(t[2] for t in self.again)

    def close(self) -> tuple:
        """The open window as a row; the next one is empty."""
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate([*self.again, *self.new]):
            piece, start = formatted(role, text)
            if k >= len(self.again) and role == "assistant":
                loss.append({"start": at + start, "end": at + len(piece) - len("\n</s>\n")})
            parts.append(piece)
            at += len(piece)
        row = (self.conv_id, self.windows, "".join(parts), loss, len(self.again), len(self.new), self.repeated + self.new_tokens)
        self.again, self.repeated, self.new, self.new_tokens, self.windows = [], 0, [], 0, self.windows + 1
        return row


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


WINDOW_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64())]
)
DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


COUNTED = "conv_id long, turn long, role string, text string, tokens long"


def format_conversations(conversations: DataFrame, budget: Budget | None = None, path: str | None = None) -> DataFrame:
    """The windows of every conversation, in order within partitions.

    Rows go by turn, then role and text; null turns come first.  Null text and
    null role count as empty.  Rows with a null conv_id are one conversation.
    The system turn is the first turn, if its role is system; it is repeated
    only if it takes no more than its share of the budget.  Other system turns
    are turns like any other.  n_tokens, those of the formatted window, stays
    within the budget unless one turn alone is longer; that gets a window of its
    own, whole, in which nothing is repeated.  Repeated rows are turns of their own.  Empty table: no
    rows.
    """
    budget, path = budget or Budget(), path or default_vocabulary()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches, 4 << 20):
            turns = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            tokens = pa.array([count(formatted(role or "", text or "")[0]) for role, text in turns], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, "tokens"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        out: list[tuple] = []
        size = 0
        for batch in slices(batches, 4 << 20):
            for conv, role, text, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.close())
                    now = Conversation(conv, budget)
                out.extend(now.add(role or "", text or "", tokens))
                size += len(text or "")
                if size > 4 << 20 and out:
                    yield _batch(out, WINDOW_SCHEMA)
                    out, size = [], 0
        if now is not None:
            out.append(now.close())
        if out:
            yield _batch(out, WINDOW_SCHEMA)

    rows = pick(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.mapInArrow(counted, COUNTED).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text", "tokens").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows hold, for windows in the order of format_conversations.

    Turns are parsed from the formatted text, without the repeated ones; the
    loss digest takes the masked spans, unescaped, in order.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        out: list[tuple] = []

        def done(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for conv, text, loss, repeated in zip(*columns, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done(state))
                    state = [conv, 0, sha256(), 0, sha256(), 0]
                for role, words in parsed(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{words}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if len(out) > 4096:
                yield _batch(out, DIGEST_SCHEMA)
                out = []
        if state is not None:
            out.append(done(state))
        if out:
            yield _batch(out, DIGEST_SCHEMA)

    return windows.select("conv_id", "text", "loss", "repeated").mapInArrow(run, DIGESTS)


#: A conversation made of the marks that formats are written in.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows and the probe's.  Rows that already have the probe's id are turns of the same conversation, in order of turn, role and text."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
