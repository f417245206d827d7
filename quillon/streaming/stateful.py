"""Sessions on streams with keyed state: decisions on calls, and compaction commands.

State lies in RocksDB, one entry for each signature, page of messages or block
of a session, so a batch reads and writes the entries that it touches and not a
session's whole state.  A restart goes on from the checkpoint.  The session
needs the RocksDB state store (see ``use_rocksdb``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.functions.text import signature
from quillon.operators.compact import ARGUMENTS, BLOCKS, MESSAGE, Session, Wording

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, with changelogs instead of whole uploads."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def call_rows(messages: DataFrame) -> DataFrame:
    """What decide_calls reads of messages with parts: a row for each tool part, step start and compaction, with a digest of a call's signature."""
    from quillon.operators.parts import tool_tokens

    p = messages.select("session_id", "seq", "created", ((F.col("role") == "assistant") & F.col("summary")).alias("_cut"), F.explode_outer("parts").alias("p"))
    call = (F.col("p.type") == "tool") & (F.col("p.call_id") != "") & (F.col("p.tool") != "")
    kind = F.when(call, "call").when(F.col("p.type") == "step-start", "step")
    rows = p.select("session_id", "seq", F.coalesce("p.part_seq", F.lit(0)).alias("part_seq"), "created", kind.alias("kind"), "p.call_id", F.when(call, F.sha2(signature(F.col("p.tool"), F.col("p.input")), 256)).alias("sig"), F.when(call, tool_tokens(F.col("p"))).alias("token_count"))
    cuts = messages.filter((F.col("role") == "assistant") & F.col("summary")).select("session_id", "seq", F.lit(-1).alias("part_seq"), "created", F.lit("cut").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("sig"), F.lit(None).cast("long").alias("token_count"))
    return rows.filter("kind is not null").unionByName(cuts)


DECISIONS = "session_id long, kind string, call_id string, created long, by string, by_created long, token_count long, turn long"


class Decisions(StatefulProcessor):
    """The duplicates of one session; see decide_calls."""

    def __init__(self, idle_ms: int | None, ttl_ms: int | None, protect_turns: int):
        self.idle_ms, self.ttl_ms, self.protect_turns = idle_ms, ttl_ms, protect_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "turn long, cut_seq long, cut long, timer long")
        self.seen = handle.getMapState("seen", "sig string", "seq long, part_seq long, call_id string, created long, token_count long, turn long", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "call_id string, created long, by string, by_created long, token_count long, turn long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        turn, cut_seq, cut, timer = self.now.get() if self.now.exists() else (0, -1, 0, 0)
        out, waiting, fresh = [], ([tuple(w) for w in self.waiting.get()] if self.protect_turns and self.waiting.exists() else []), False
        for r in pd.concat(list(rows)).sort_values(["seq", "part_seq"], kind="stable").itertuples(index=False):
            if r.kind == "cut":
                if r.seq > cut_seq:  # the last one by position counts, whenever it comes
                    cut_seq, cut = int(r.seq), int(r.created)
                    out.append(("cleared", None, cut, None, None, None, turn))
                continue
            if r.created < cut:  # late rows are judged by their own time
                continue
            if r.kind == "step":
                turn += 1
                continue
            place = (int(r.seq), int(r.part_seq), r.call_id, int(r.created), int(r.token_count), turn)
            old = tuple(self.seen.getValue((r.sig,))) if self.seen.containsKey((r.sig,)) else None
            if old is not None and old[3] < cut:
                old = None
            if old is None or old[:3] < place[:3]:
                self.seen.updateValue((r.sig,), place)
            if old is not None and old[2] != place[2]:
                lost, kept = (old, place) if old[:3] < place[:3] else (place, old)
                waiting.append((lost[2], lost[3], kept[2], kept[3], lost[4], lost[5]))
                fresh = True
        ready = [w for w in waiting if turn - w[5] >= self.protect_turns]
        waiting = [w for w in waiting if turn - w[5] < self.protect_turns]
        out += [("pruned", *w) for w in ready]
        if self.protect_turns and (fresh or ready):
            self.waiting.put(waiting) if waiting else self.waiting.clear()
        if self.idle_ms is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timers.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.now.update((turn, cut_seq, cut, timer))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:
        """A session without rows for idle_ms is forgotten."""
        for state in (self.now, self.seen, self.waiting):
            state.clear()
        yield self._frame(key, [])

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in DECISIONS.split(", ")]
        df = pd.DataFrame([(key[0], *r) for r in rows], columns=names)
        return df.astype({c.split()[0]: "Int64" for c in DECISIONS.split(", ") if c.endswith("long")})

    def close(self) -> None:
        pass


def decide_calls(rows: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None, protect_turns: int = 0) -> DataFrame:
    """PRN-1, PRN-6, PRN-16, WIN-4 on a stream: the duplicates of each session as its rows come in.

    rows: see call_rows.  A row of kind ``pruned`` names a call that a later one
    makes redundant, with both times, its tokens and its turn; with
    ``protect_turns`` it comes once its session has started so many more turns.
    A row of kind ``cleared`` says that what is older than ``created`` has been
    compacted.  settled() makes of all rows what a batch decides.

    Rows of a session may come in any order within a batch.  Across batches a
    late call is judged by its place and time; turns count in the order of
    arrival.  A signature is forgotten after ``ttl_ms``, a session after
    ``idle_ms`` without rows; both keep everything unless given.
    """
    mode = "processingTime" if idle_ms is not None or ttl_ms is not None else "none"
    return rows.groupBy("session_id").transformWithStateInPandas(Decisions(idle_ms, ttl_ms, protect_turns), DECISIONS, "append", mode)


def settled(decisions: DataFrame) -> DataFrame:
    """The calls that stay pruned: those of which neither call is older than the session's last compaction (session_id, call_id, token_count)."""
    cut = decisions.filter("kind = 'cleared'").groupBy("session_id").agg(F.max("created").alias("cut"))
    kept = decisions.filter("kind = 'pruned'").join(cut, "session_id", "left").filter("cut is null or (created >= cut and by_created >= cut)")
    return kept.groupBy("session_id", "call_id").agg(F.max("token_count").alias("token_count"))


#: Messages of one entry of state.
PAGE = 64
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
FIELDS = [x.split()[0] for x in MESSAGE.split(", ")]


class StoredSession(Session):
    """A session whose messages are read from state, a page at a time, when a command asks for them."""

    def __init__(self, wording: Wording, keep_user_text: bool, pages, refs):
        super().__init__(wording, keep_user_text)
        self.pages, self.refs, self.loaded = pages, refs, set()

    def _load(self, page: int) -> None:
        if page not in self.loaded:
            self.loaded.add(page)
            if self.pages.containsKey((page,)):
                for seq, ref, *row in json.loads(self.pages.getValue((page,))[0]):
                    self.add(seq, ref, *row)
                self.seqs.sort()

    def named(self, ref: str) -> int | None:
        return int(self.refs.getValue((ref,))[0]) if self.refs.containsKey((ref,)) else None

    def between(self, a: int, b: int) -> list[int]:
        for page in range(a // PAGE, b // PAGE + 1):
            self._load(page)
        return super().between(a, b)

    def row(self, seq: int) -> tuple:
        self._load(seq // PAGE)
        return super().row(seq)


class Compaction(StatefulProcessor):
    """The blocks of one session; see compact_stream."""

    def __init__(self, wording: Wording, keep_user_text: bool, errors: bool):
        self.wording, self.keep_user_text, self.errors = wording, keep_user_text, errors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("messages", "page long", "rows string")
        self.refs = handle.getMapState("refs", "ref string", "seq long")
        self.blocks = handle.getMapState("blocks", "block_id long", "block string")

    def _messages(self, rows: list[list]) -> None:
        by_page: dict[int, list] = {}
        for row in rows:
            by_page.setdefault(row[0] // PAGE, []).append(row)
            if row[1]:
                self.refs.updateValue((row[1],), (row[0],))
        for page, new in by_page.items():
            known = {r[0]: r for r in json.loads(self.pages.getValue((page,))[0])} if self.pages.containsKey((page,)) else {}
            known |= {r[0]: r for r in new}
            self.pages.updateValue((page,), (json.dumps([known[s] for s in sorted(known)]),))

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers) -> None:
        own = [json.loads(x) for x in initial["row"]]
        self._messages(_values(own, "message", FIELDS[1:]))
        for r in own:
            if "block" in r:
                self.blocks.updateValue((r["block"]["block_id"],), (json.dumps(r["block"]),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        own = [json.loads(x) for df in rows for x in df["row"]]
        self._messages(_values(own, "message", FIELDS[1:]))
        commands = sorted(_values(own, "command", ["cmd", *ARGUMENTS]), key=lambda c: c[0])
        out = []
        if commands:
            session = StoredSession(self.wording, self.keep_user_text, self.pages, self.refs)
            for _, (text,) in self.blocks.iterator():
                session.restore(json.loads(text))
            name = key[0].item() if hasattr(key[0], "item") else key[0]
            for cmd, *args in commands:
                made = session.run(name, cmd, *args)
                if made.get("error"):
                    out += [(cmd, made)] if self.errors else []
                    continue
                changed = [made, *(session.blocks[n] for n in made["consumed"])]
                for block in changed:
                    self.blocks.updateValue((block["block_id"],), (json.dumps(block),))
                out += [(cmd, dict(block)) for block in changed]
        yield pd.DataFrame([(key[0], cmd, block.get("block_id"), json.dumps(block)) for cmd, block in out], columns=["session_id", "by_cmd", "block_id", "block"]).astype({"block_id": "Int64"})

    def close(self) -> None:
        pass


def _json_rows(messages: DataFrame | None, commands: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """session_id and row, a message, a command or a block as JSON under its name."""
    out = None
    for df, kind, names in ((messages, "message", FIELDS[1:]), (commands, "command", ["cmd", *ARGUMENTS]), (blocks, "block", NAMES)):
        if df is not None:
            one = df.select("session_id", F.to_json(F.struct(F.struct(*names).alias(kind)), {"ignoreNullFields": "false"}).alias("row"))
            out = one if out is None else out.unionByName(one)
    return out


def _values(rows: list[dict], kind: str, names: list[str]) -> list[list]:
    return [[r[kind][n] for n in names] for r in rows if kind in r]


def compact_stream(messages: DataFrame, commands: DataFrame, stored: DataFrame | None = None, stored_messages: DataFrame | None = None, keep_user_text: bool = False, wording: Wording = Wording(), errors: bool = False) -> DataFrame:
    """CMP-1, CMP-8, CMP-9, CMP-17 on a stream: messages and commands of sessions in, changes of blocks out.

    messages and commands: as for compact; both streams, or one of them.  stored
    and stored_messages, tables, are what sessions start with: the blocks of an
    earlier compaction and the messages they were made from.  A command comes no
    earlier than the messages that it names; messages and commands of one batch
    count in this order, commands by number.

    A row is a block as a command left it: session_id, by_cmd, block_id and block
    as JSON; blocks_now() gives each one's last state.  With ``errors``, commands
    that make no block give a row without block_id.
    """
    initial = None if stored is None and stored_messages is None else _json_rows(stored_messages, None, None if stored is None else stored.filter("block_id is not null")).groupBy("session_id")
    rows = _json_rows(messages, commands).groupBy("session_id")
    return rows.transformWithStateInPandas(Compaction(wording, keep_user_text, errors), "session_id long, by_cmd long, block_id long, block string", "append", "none", initial)


def blocks_now(changes: DataFrame) -> DataFrame:
    """Each block as the last command left it, with the columns of compact."""
    last = changes.filter("block_id is not null").groupBy("session_id", "block_id").agg(F.max(F.struct("by_cmd", "block"))["block"].alias("block"))
    return last.select(F.from_json("block", BLOCKS).alias("b")).select("b.*")
