"""Which tool calls to prune: duplicates, stale errors, superseded writes, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import file_paths, path_protected, signature, token_count, tool_protected
from quillon.operators.derive import turns


def _open(calls: DataFrame, protected_tools: list[str], protected_paths: list[str], pruned: DataFrame | None = None) -> DataFrame:
    """The calls that may be pruned: not pruned already (SET-6), and neither tool nor paths protected; paths come from the parameters where no column has them."""
    paths = F.array("path") if "path" in calls.columns else file_paths(F.col("tool"), F.col("parameters"))
    if pruned is not None:
        calls = calls.join(pruned.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti")
    return calls.filter(~tool_protected(F.col("tool"), protected_tools) & ~path_protected(paths, protected_paths))


def latest(calls: DataFrame) -> list[Column]:
    """Later calls first: by message, then part where there is such a column, then call_id."""
    return [F.desc(c) for c in ("seq", "part_seq", "call_id") if c in calls.columns]


def may_run(enabled: bool = True, manual: bool = False, automatic: bool = True) -> bool:
    """PRN-1, PRN-4: whether a strategy runs: enabled, and in manual mode only if strategies stay automatic."""
    return enabled and (not manual or automatic)


def duplicates(calls: DataFrame, protected_tools: list[str] = (), protected_paths: list[str] = (), pruned: DataFrame | None = None) -> DataFrame:
    """PRN-1, WIN-3: all but the last call of each signature in a session, with the columns of ``calls``."""
    c = _open(calls, list(protected_tools), list(protected_paths), pruned).withColumn("sig", signature(F.col("tool"), F.col("parameters")))
    newest = F.row_number().over(W.partitionBy("session_id", "sig").orderBy(*latest(c)))
    return c.withColumn("rn", newest).filter("rn > 1").drop("rn", "sig")


def deduplicate(calls: DataFrame, protected_tools: list[str] = (), protected_paths: list[str] = (), pruned: DataFrame | None = None) -> DataFrame:
    """PRN-1, WIN-3: the calls of duplicates, with the tokens each gives back."""
    tokens = F.col("token_count") if "token_count" in calls.columns else token_count(F.col("parameters"))
    return duplicates(calls, protected_tools, protected_paths, pruned).select("session_id", "call_id", tokens.alias("token_count"))


def purge_errors(calls: DataFrame, age: int = 4, protected_tools: list[str] = (), protected_paths: list[str] = (), pruned: DataFrame | None = None) -> DataFrame:
    """PRN-4: failed calls at least ``age`` turns old (1 at least)."""
    if "current_turn" in calls.columns:
        c = calls.withColumn("age", F.col("current_turn") - F.col("turn"))
    else:
        now = F.sum(F.col("step_start").cast("long")).over(W.partitionBy("session_id"))
        c = turns(calls).withColumn("now", now).withColumn("age", F.col("now") - F.col("turn"))
    return _open(c, list(protected_tools), list(protected_paths), pruned).filter((F.col("status") == "error") & (F.col("age") >= max(1, age))).select("session_id", "call_id", "age")


def supersede_writes(calls: DataFrame, protected_paths: list[str] = ()) -> DataFrame:
    """PRN-5, JOIN-2: writes of a path that is read later in the session."""
    last_read = F.max(F.when(F.col("tool") == "read", F.col("seq"))).over(W.partitionBy("session_id", "path"))
    c = calls.filter(F.col("tool").isin("read", "write") & F.col("path").isNotNull()).withColumn("last_read", last_read)
    return _open(c, [], list(protected_paths)).filter("tool = 'write' and last_read > seq").select("session_id", "call_id", "path")


def sweep_last(calls: DataFrame, n: int, pruned: DataFrame, protected_tools: list[str] = ()) -> DataFrame:
    """PRN-7, SRT-4: the last n calls of each session, without those pruned already or protected."""
    last = calls.withColumn("rn", F.row_number().over(W.partitionBy("session_id").orderBy(*latest(calls)))).filter(F.col("rn") <= n)
    return _open(last, list(protected_tools), []).join(pruned, ["session_id", "call_id"], "left_anti").select("session_id", "call_id")


def eligible_calls(calls: DataFrame, protect_turns: int) -> DataFrame:
    """PRN-6: calls that are no longer protected by their turn."""
    now = F.sum(F.col("step_start").cast("long")).over(W.partitionBy("session_id"))
    return turns(calls).withColumn("now", now).filter(F.col("now") - F.col("turn") >= protect_turns).drop("now")
