"""Sessions as streams: state for each session, decisions as its events come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions.text import signature

DECISIONS = "session_id long, call_id long, turn long, supersedes long"
STATE = "turn long, signatures array<string>, last array<long>"


def stream_duplicates(calls: DataFrame, most: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """PRN-1, WIN-4 on a stream: each call with its turn, and the earlier call of the same signature that it makes redundant.

    Calls of a session must come in order across batches; within a batch they
    are sorted.  A session's state holds every signature.  Two parameters bound
    it, both off unless given: ``most`` signatures, the oldest leaving first
    (SRT-6), and ``idle_ms`` without calls after which the state is dropped.  A
    row with ``compacted`` true (where there is such a column) clears what its
    session has seen before it; turns go on (PRN-16).
    """
    cut = F.col("compacted") if "compacted" in calls.columns else F.lit(False)
    keyed = calls.withColumn("sig", F.sha2(signature(F.col("tool"), F.col("parameters")), 256)).select("session_id", "seq", "call_id", "step_start", "sig", cut.alias("cut"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turn, sigs, last = state.get if state.exists else (0, [], [])
        seen = dict(zip(sigs, last, strict=True))
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if r.cut:
                seen.clear()
            turn += int(r.step_start)
            out.append((key[0], int(r.call_id), turn, seen.pop(r.sig, None)))
            seen[r.sig] = int(r.call_id)
            if most is not None and len(seen) > most:
                seen.pop(next(iter(seen)))
        state.update((turn, list(seen), list(seen.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "call_id", "turn", "supersedes"]).astype({"supersedes": "Int64"})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return keyed.groupBy("session_id").applyInPandasWithState(step, DECISIONS, STATE, "append", timeout)


def stream_token_stats(steps: DataFrame) -> DataFrame:
    """AGG-1 on a stream: running sums of each session (output mode complete or update)."""
    return steps.groupBy("session_id").agg(F.sum("input").alias("sum_input"), F.sum("output").alias("sum_output"), F.sum("cache_read").alias("sum_cache_read"), F.count("*").alias("steps"))


def stream_eligible(calls: DataFrame, protect_turns: int) -> DataFrame:
    """Turn protection on a stream: each call once its session has started ``protect_turns`` more turns.

    A session's state holds its turn and the calls that still wait.
    """
    rows = calls.select("session_id", "seq", "call_id", "step_start")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, waiting = state.get if state.exists else (0, [])
        waiting, out = list(map(tuple, waiting)), []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            turn += int(r.step_start)
            waiting.append((int(r.call_id), turn))
            out += [(key[0], c, t) for c, t in waiting if turn - t >= protect_turns]
            waiting = [(c, t) for c, t in waiting if turn - t < protect_turns]
        state.update((turn, waiting))
        yield pd.DataFrame(out, columns=["session_id", "call_id", "turn"]).astype({"session_id": "int64", "call_id": "int64", "turn": "int64"})

    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id long, call_id long, turn long", "turn long, waiting array<struct<call_id:bigint,turn:bigint>>", "append", GroupStateTimeout.NoTimeout)
