"""Range compaction: boundaries, ranges, summaries and the fold of commands into blocks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import file_paths, path_protected, token_count, tool_protected
from quillon.operators.derive import together
from quillon.operators.parts import Count, ignored_user, message_tokens, of_type

REF, BLOCK = r"^m(\d{4})$", r"^b([1-9]\d*)$"
PLACEHOLDER = re.compile(r"\(b([1-9]\d*)\)|\{block_([1-9]\d*)\}", re.IGNORECASE)


def boundary(c: Column) -> Column:
    """CMP-3: kind (message, block or null) and number of a boundary, without regard to case and outer space."""
    t = F.lower(F.trim(c))
    m, b = F.regexp_extract(t, REF, 1), F.regexp_extract(t, BLOCK, 1)
    message = (m != "") & (m != "0000")
    return F.struct(F.when(message, "message").when(b != "", "block").alias("kind"), F.when(message, m.cast("int")).when(b != "", b.cast("int")).alias("number"))


def resolve_ranges(commands: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """CMP-4, CMP-7, JOIN-6: first and last seq of every command, and the issues of those that have none.

    commands: session_id, cmd, start_id, end_id.  A block stands for its anchor.
    """
    places = refs.select("session_id", F.lit("message").alias("kind"), F.substring("ref", 2, 4).cast("int").alias("number"), "seq")
    places = places.unionByName(blocks.select("session_id", F.lit("block").alias("kind"), F.col("block_id").cast("int").alias("number"), F.col("anchor_seq").alias("seq")))
    out = commands
    for side in ("start", "end"):
        at = places.select("session_id", F.col("kind").alias(f"{side}_kind"), F.col("number").alias(f"{side}_number"), F.col("seq").alias(f"{side}_seq"))
        out = out.withColumn("b", boundary(F.col(f"{side}_id"))).withColumns({f"{side}_kind": F.col("b.kind"), f"{side}_number": F.col("b.number")}).drop("b")
        out = out.join(at, ["session_id", f"{side}_kind", f"{side}_number"], "left")
    issue = lambda side: F.when(F.col(f"{side}_kind").isNull(), F.concat(F.lit(f"{side}: not a reference: "), F.col(f"{side}_id"))).when(F.col(f"{side}_seq").isNull(), F.concat(F.lit(f"{side}: not found: "), F.col(f"{side}_id")))
    order = F.when(F.col("start_seq") > F.col("end_seq"), F.lit("start is after end"))
    issues = F.concat_ws("\n", issue("start"), issue("end"), order)
    return out.select("session_id", "cmd", "start_seq", "end_seq", F.nullif(issues, F.lit("")).alias("issues"))


#: Places of a bin of ranges.
BIN = 4096


def in_ranges(ranges: DataFrame, points: DataFrame, place: str, width: int = BIN) -> DataFrame:
    """The points of each range of its session, start_seq to end_seq, joined by bins.

    A range has a row for each bin that it touches, no more than two above a
    ``width``-th of its length; a point has one.  So a bin of a session meets
    the ranges that touch it and no others.  Ranges whose end is before their
    start hold nothing.
    """
    bin_ = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    r = ranges.filter("start_seq <= end_seq").withColumn("_bin", F.explode(F.sequence(bin_("start_seq"), bin_("end_seq"))))
    return r.join(points.withColumn("_bin", bin_(place)), ["session_id", "_bin"]).filter(F.col(place).between(F.col("start_seq"), F.col("end_seq"))).drop("_bin")


def range_messages(ranges: DataFrame, messages: DataFrame) -> DataFrame:
    """CMP-6: the messages inside each valid range, with their tokens."""
    joined = in_ranges(ranges.filter("issues is null"), messages, "seq")
    return joined.select("session_id", "cmd", "seq", token_count(F.col("text")).alias("token_count"))


def required_blocks(ranges: DataFrame, active: DataFrame) -> DataFrame:
    """CMP-6, JOIN-5: active blocks anchored inside each range, in order of anchor and id."""
    r = in_ranges(ranges.filter("issues is null"), active, "anchor_seq")
    return r.groupBy("session_id", "cmd").agg(F.transform(F.sort_array(F.collect_list(F.struct("anchor_seq", "block_id"))), lambda x: x["block_id"]).alias("required"))


def placeholders(text: str) -> list[tuple[int, int, int]]:
    """CMP-10: block number, start and end of every marker."""
    return [(int(m[1] or m[2]), m.start(), m.end()) for m in PLACEHOLDER.finditer(text)]


def merge_spaced(left: str, right: str) -> str:
    """CMP-16: two texts with a blank line between; a blank one leaves the other as it is."""
    a, b = left.strip(), right.strip()
    return right if not a else left if not b else f"{a}\n\n{b}"


def expand(summary: str, required: Iterable[int], bodies: dict[int, str], start: int | None = None, end: int | None = None) -> tuple[str, list[int], list[int]]:
    """CMP-11, CMP-12: the summary with stored bodies in place of its markers.

    The first marker of a known and required block is replaced; all others stay.
    A boundary that is a block (``start``, ``end``) need not be marked: its body
    then stands before or after the summary.  Returns the text, the consumed
    blocks in order, and the required ones that are still missing.
    """
    wanted, out, at, used = set(required), [], 0, []
    for n, a, b in placeholders(summary):
        if n in bodies and n in wanted and n not in used:
            out += [summary[at:a], bodies[n]]
            at = b
            used.append(n)
    missing = [n for n in dict.fromkeys(required) if n not in used and n not in (start, end)]
    text = "".join([*out, summary[at:]])
    if start is not None and start not in used:
        text = merge_spaced(bodies[start], text)
        used.append(start)
    if end is not None and end not in used:
        text = merge_spaced(text, bodies[end])
        used.append(end)
    return text, used, missing


@dataclass(frozen=True)
class Wording:
    """The fixed texts that stand between the parts of a stored summary."""

    header: str = "[compressed section]"
    user_texts: str = "User messages of this section, word for word:"
    tools: str = "Outputs of protected tools in this section:"
    blocks: str = "Summaries of this section that were stored before:"


def append_missing(text: str, missing: Iterable[int], bodies: dict[int, str], wording: Wording = Wording()) -> str:
    """CMP-13: blocks that are required but not marked, in sections of their own under one heading."""
    sections = [f"\n### (b{n})\n{bodies[n]}" for n in missing]
    return f"{text}\n\n{wording.blocks}{''.join(sections)}" if sections else text


def wrap(block_id: int, summary: str, header: str = Wording.header) -> str:
    """CMP-16: a stored summary between its header and its footer."""
    body = summary.strip()
    return f"{header}\n{body}\n\n[b{block_id}]" if body else f"{header}\n[b{block_id}]"


def unwrap(stored: str, header: str = Wording.header) -> str:
    """CMP-16: the summary without header and footer; a text without the header as it is."""
    if not stored.lstrip().startswith(header):
        return stored
    body = re.sub(r"^(?:\r?\n)+", "", stored.lstrip()[len(header) :])
    return re.sub(r"(?:\r?\n)+$", "", re.sub(r"(?:\r?\n)*\[b[1-9]\d*\]\s*$", "", body))


ARGUMENTS = ("topic", "start_id", "end_id", "summary")


def normalized_arguments(args: dict) -> dict:
    """CMP-2: the four arguments from their flat or nested form."""
    inner = args.get("content")
    inner = inner if isinstance(inner, dict) else args
    return {"topic": args.get("topic"), "start_id": inner.get("startId"), "end_id": inner.get("endId"), "summary": inner.get("summary")}


def argument_issues(args: dict) -> list[str]:
    """CMP-2: the arguments that are no text with something in it."""
    return [f"{name} must be a text that is not blank" for name in ARGUMENTS if not isinstance(args.get(name), str) or not args[name].strip()]


def raise_issues(issues: list[str]) -> None:
    """CMP-23: one error for all issues; several are a list."""
    if issues:
        raise ValueError(issues[0] if len(issues) == 1 else "\n".join(f"- {x}" for x in issues))


MESSAGE = "session_id long, seq long, ref string, tokens long, ignored boolean, user_text string, tool_ids array<string>, kept_outputs array<string>"
BLOCKS = (
    "session_id long, block_id long, cmd long, topic string, start_id string, end_id string, start_seq long, end_seq long, anchor_seq long, active boolean, compressed_tokens long, n_messages long, "
    "consumed array<long>, missing array<long>, parents array<long>, direct_seqs array<long>, effective_seqs array<long>, direct_tools array<string>, effective_tools array<string>, summary string, reply string, error string"
)


def plain_messages(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """Messages (session_id, seq, role, text) of one text part each, as compact reads them."""
    own = messages.join(refs, ["session_id", "seq"], "left")
    text = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("text"))
    none = F.array().cast("array<string>")
    return own.select("session_id", "seq", "ref", token_count(F.col("text")).alias("tokens"), F.lit(False).alias("ignored"), text.alias("user_text"), none.alias("tool_ids"), none.alias("kept_outputs"))


def messages_with_parts(messages: DataFrame, refs: DataFrame, protected_tools: list[str] = (), protected_paths: list[str] = (), results: DataFrame | None = None, count: Count = token_count) -> DataFrame:
    """Messages with parts, as compact reads them: tokens, the first text of real users, calls, and outputs of protected calls (CMP-14, CMP-15).

    results (session_id, call_id, output) has outputs that hold a child's result.
    """
    own = messages.join(refs, ["session_id", "seq"], "left")
    texts = F.filter(F.transform(of_type("text"), lambda p: p["text"]), lambda t: F.trim(t) != "")
    calls = F.filter(of_type("tool"), lambda p: p["call_id"] != "")
    own = own.withColumn("known", F.lit(None).cast("map<string,string>"))
    if results is not None:
        by = results.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("call_id", "output"))).alias("known"))
        own = own.drop("known").join(by, "session_id", "left")
    kept = F.filter(calls, lambda p: tool_protected(p["tool"], list(protected_tools)) | path_protected(file_paths(p["tool"], p["input"]), list(protected_paths)))
    output = lambda p: F.when(p["status"] == "completed", F.coalesce(F.try_element_at("known", p["call_id"]), p["output"]))
    outputs = F.filter(F.transform(kept, lambda p: F.when(output(p) != "", F.concat(F.lit("\n### Tool: "), p["tool"], F.lit("\n"), output(p)))), lambda x: x.isNotNull())
    user = F.when((F.col("role") == "user") & ~ignored_user(), F.get(texts, F.lit(0)))
    return own.select("session_id", "seq", "ref", message_tokens(count=count).alias("tokens"), ignored_user().alias("ignored"), user.alias("user_text"), F.array_distinct(F.transform(calls, lambda p: p["call_id"])).alias("tool_ids"), outputs.alias("kept_outputs"))


class Session:
    """The messages and blocks of one session while its commands run.

    Active blocks are kept in order of their anchors, and messages and calls with
    the number of active blocks that hold them, so a command costs what its own
    range and the blocks in it hold.
    """

    def __init__(self, wording: Wording, keep_user_text: bool):
        self.wording, self.keep_user_text = wording, keep_user_text
        self.seqs: list[int] = []
        self.rows: dict[int, tuple] = {}
        self.seq_of: dict[str, int] = {}
        self.blocks: dict[int, dict] = {}
        self.last = 0
        self.anchors: list[tuple[int, int]] = []
        self.holders: Counter[int] = Counter()
        self.tool_holders: Counter[str] = Counter()

    def add(self, seq: int, ref: str | None, *row: object) -> None:
        self.seqs.append(seq)
        self.rows[seq] = row
        if ref:
            self.seq_of[ref] = seq

    def named(self, ref: str) -> int | None:
        """The message of a reference."""
        return self.seq_of.get(ref)

    def between(self, a: int, b: int) -> list[int]:
        """The messages from a to b, in order."""
        return self.seqs[bisect_left(self.seqs, a) : bisect_right(self.seqs, b)]

    def row(self, seq: int) -> tuple:
        return self.rows[seq]

    def restore(self, block: dict) -> None:
        """Takes in a block as it was left."""
        self.blocks[block["block_id"]] = block
        self.last = max(self.last, block["block_id"])
        if block["active"]:
            self._hold(block)

    def _hold(self, block: dict) -> None:
        insort(self.anchors, (block["anchor_seq"], block["block_id"]))
        self.holders.update(block["effective_seqs"])
        self.tool_holders.update(block["effective_tools"])

    def _release(self, block: dict) -> None:
        self.anchors.pop(bisect_left(self.anchors, (block["anchor_seq"], block["block_id"])))
        self.holders.subtract(block["effective_seqs"])
        self.tool_holders.subtract(block["effective_tools"])

    def place(self, name: str | None) -> tuple[int | None, int | None]:
        """The message that a boundary stands for, and its block if it is one."""
        name = (name or "").strip().lower()
        if m := re.match(BLOCK, name):
            b = self.blocks.get(int(m[1]))
            return (b["anchor_seq"], int(m[1])) if b and b["active"] else (None, None)
        return (self.named(name), None) if re.match(REF, name) else (None, None)

    def run(self, session_id: int, cmd: int, topic: str | None, start_id: str | None, end_id: str | None, summary: str | None) -> dict:
        """One command; a dict of the block's columns, or of its error alone."""
        failed = lambda why: {"session_id": session_id, "cmd": cmd, "topic": topic, "start_id": start_id, "end_id": end_id, "error": why}
        (a, start_block), (b, end_block) = self.place(start_id), self.place(end_id)
        issues = [f"{side}: no such reference: {name}" for side, name, at in (("start", start_id, a), ("end", end_id, b)) if at is None]
        if not issues and a > b:
            issues = ["start is after end"]
        if issues:
            return failed("\n".join(issues))
        inside = [s for s in self.between(a, b) if not self.row(s)[1]]
        if not inside:
            return failed("no messages in the range")
        held = set(inside)
        first, end = bisect_left(self.anchors, (a, 0)), bisect_left(self.anchors, (b + 1, 0))
        required = [n for s, n in self.anchors[first:end] if s in held]
        known = {*required, *(n for n in (start_block, end_block) if n is not None)}
        bodies = {n: unwrap(self.blocks[n]["summary"], self.wording.header) for n in known}
        text, consumed, missing = expand(summary or "", required, bodies, start_block, end_block)
        open_ = [s for s in inside if not self.holders[s]]
        users = [self.row(s)[2] for s in open_ if self.keep_user_text and self.row(s)[2]]
        if users:
            text += f"\n\n{self.wording.user_texts}" + "".join(f"\n{t}" for t in users)
        outputs = [x for s in open_ for x in self.row(s)[4]]
        if outputs:
            text += f"\n\n{self.wording.tools}" + "".join(outputs)
        text = append_missing(text, missing, bodies, self.wording)
        consumed += [n for n in missing if n not in consumed]
        self.last = new = self.last + 1
        effective = dict.fromkeys(inside)
        tools = dict.fromkeys(t for s in inside for t in self.row(s)[3])
        for n in consumed:
            effective |= dict.fromkeys(self.blocks[n]["effective_seqs"])
            tools |= dict.fromkeys(self.blocks[n]["effective_tools"])
        direct = [s for s in effective if not self.holders[s]]
        block = {
            "session_id": session_id, "block_id": new, "cmd": cmd, "topic": topic, "start_id": start_id, "end_id": end_id, "start_seq": a, "end_seq": b, "anchor_seq": a, "active": True,
            "compressed_tokens": sum(self.row(s)[0] for s in direct), "n_messages": len(effective), "consumed": consumed, "missing": missing, "parents": [], "direct_seqs": direct, "effective_seqs": list(effective),
            "direct_tools": [t for t in tools if not self.tool_holders[t]], "effective_tools": list(tools), "summary": wrap(new, text, self.wording.header), "reply": f"{len(inside)} messages are now {self.wording.header}.",
        }
        for n in consumed:
            old = self.blocks[n]
            if old["active"]:
                self._release(old)
                old["active"] = False
                old["parents"].append(new)
        self._hold(block)
        self.blocks[new] = block
        return block


def compaction_rows(commands: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages (kind 0) of sessions with commands, and the commands (kind 1), as rows of one table."""
    fields, asked = _names(MESSAGE), ("cmd", *ARGUMENTS)
    none = lambda df, cols: {c: F.lit(None).cast(df.schema[c].dataType) for c in cols}
    busy = messages.select(*fields).join(commands.select("session_id").distinct(), "session_id", "left_semi")
    told = commands.select("session_id", *asked)
    return busy.withColumns(none(told, asked) | {"kind": F.lit(0)}).unionByName(told.withColumns(none(busy, fields[1:]) | {"kind": F.lit(1)}))


def compact(commands: DataFrame, messages: DataFrame, keep_user_text: bool = False, wording: Wording = Wording(), errors: bool = False) -> DataFrame:
    """CMP-1, CMP-8, CMP-14 to CMP-17: runs each session's commands in order and returns its blocks.

    commands: session_id, cmd, topic, start_id, end_id, summary.  messages: see
    MESSAGE.  A later command may name an active block as a boundary, and
    consumes active blocks in its range.  compressed_tokens counts messages that
    no active block covered before.  A command whose boundaries do not resolve,
    or whose range has no message, makes no block; with ``errors`` it gives a row
    with its error alone.

    A command reads what those before it left, so the sorted rows of a session
    are read in order by one task; only sessions with commands get there, with
    the lengths of their messages instead of texts.
    """
    names, fields = _names(BLOCKS), _names(MESSAGE)
    both = together(compaction_rows(commands, messages), "session_id").sortWithinPartitions("session_id", "kind", "seq", "cmd").select("session_id", "kind", *fields[1:], "cmd", *ARGUMENTS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        session, failed = Session(wording, keep_user_text), []

        def done() -> list[dict]:
            return [*session.blocks.values(), *(failed if errors else [])]

        out: list[dict] = []
        for batch in batches:
            for session_id, kind, seq, ref, tokens, ignored, user_text, tool_ids, kept, cmd, *args in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (session_id,) != now:
                    out += done()
                    now, session, failed = (session_id,), Session(wording, keep_user_text), []
                if kind == 0:
                    session.add(seq, ref, tokens or 0, bool(ignored), user_text, tool_ids or [], kept or [])
                elif (row := session.run(session_id, cmd, *args)).get("error"):
                    failed.append(row)
            if len(out) > 1000:
                yield _rows(out, names)
                out = []
        out += done()
        if out:
            yield _rows(out, names)

    return both.mapInArrow(fold, BLOCKS)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _rows(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = [x.split()[1] for x in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], ARROW[k]) for n, k in zip(names, kinds, strict=True)], names)


def effective_ids(blocks: DataFrame) -> DataFrame:
    """SET-3: the messages a block stands for: those of its range and, at every depth, those of the blocks it consumed."""
    return blocks.select("session_id", "block_id", F.explode("effective_seqs").alias("seq"))


def covered_messages(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """CMP-8: for each message in a block its tokens, all its blocks and the active ones."""
    own = blocks.select("session_id", "block_id", "active", F.explode("effective_seqs").alias("seq"))
    per = own.groupBy("session_id", "seq").agg(F.sort_array(F.collect_set("block_id")).alias("all_blocks"), F.sort_array(F.collect_set(F.when(F.col("active"), F.col("block_id")))).alias("active_blocks"))
    return per.join(messages.select("session_id", "seq", "tokens"), ["session_id", "seq"])
