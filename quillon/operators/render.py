"""Replies to commands, as one text column for each session (NDG-12 and the replies of stats, sweep and blocks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import format_tokens

#: Marks of a context bar, by part.
MARKS = (("system", "█"), ("user", "▓"), ("assistant", "▒"), ("tool_tokens", "░"))


def _lines(*lines: Column | str) -> Column:
    """Lines joined by line breaks; null lines are left out."""
    return F.concat_ws("\n", *[x if isinstance(x, Column) else F.lit(x) for x in lines])


def _put(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def context_reply(breakdown: DataFrame, saved: Column | None = None, width: int = 30) -> DataFrame:
    """NDG-12: what parts.breakdown found, a bar for each part, and what pruning saves.

    saved is a column of the tokens pruned so far (none unless given).
    """
    total = F.col("total")

    def part(name: str, mark: str) -> Column:
        share = F.when(total > 0, F.col(name) / total).otherwise(0.0)
        bar = F.rpad(F.repeat(F.lit(mark), F.floor(share * width + F.lit(0.5)).cast("int")), width, " ")
        label = name.removesuffix("_tokens")
        return _put(F.rpad(F.lit(label), 10, " "), F.lpad(F.format_number(share * 100, 1), 5, " "), "% │", bar, "│ ", format_tokens(F.col(name)))

    gone = F.lit(0) if saved is None else saved
    pruned = F.when(gone > 0, _put("pruned: ", F.col("tools_pruned").cast("string"), " calls, ", F.col("messages_pruned").cast("string"), " messages (", format_tokens(gone), ")"))
    whole = F.when(gone > 0, _put("without pruning: ", format_tokens(total + gone)))
    return breakdown.select("session_id", _lines(*[part(n, m) for n, m in MARKS], pruned, _put("context: ", format_tokens(total)), whole).alias("reply"))


def sweep_reply(report: DataFrame, items: DataFrame, since_user: bool) -> DataFrame:
    """PRN-7: what parts.sweep_report found, and the lines of labels.pruned_items."""
    r = report.join(items.select("session_id", "lines"), "session_id", "left")
    what = " since the last user message" if since_user else " at the end"
    head = F.when(F.col("swept") > 0, _put(F.col("swept").cast("string"), f" calls swept{what}, ", format_tokens(F.col("tokens")), " tokens")).otherwise(f"no calls to sweep{what}")
    skipped = F.when(F.col("skipped") > 0, _put("(", F.col("skipped").cast("string"), " protected)"))
    return r.select("session_id", _lines(head, skipped, F.when(F.col("swept") > 0, F.array_join("lines", "\n"))).alias("reply"))


def stats_reply(session: DataFrame, everywhere: DataFrame) -> DataFrame:
    """AGG-11: counts of one session (session_id, tokens, tools, messages) and of all (states.statistics: one row)."""
    counted = lambda p: _put(format_tokens(F.col(f"{p}tokens")), " tokens, ", F.col(f"{p}tools").cast("string"), " calls, ", F.col(f"{p}messages").cast("string"), " messages")
    every = everywhere.select(*[F.col(c).alias(f"all_{c}") for c in ("tokens", "tools", "messages", "sessions")])
    both = session.crossJoin(F.broadcast(every))  # one row
    return both.select("session_id", _lines(_put("this session: ", counted("")), _put("all sessions (", F.col("all_sessions").cast("string"), "): ", counted("all_"))).alias("reply"))


def change_reply(diff: DataFrame, target: Column) -> DataFrame:
    """CMP-18, CMP-19: what taking a block back, or putting it on again, changed; diff as blocks.activity_diff gives it."""
    named = lambda change: F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("change") == change, F.col("block_id")))), lambda b: _put("b", b.cast("string"))), ", ")
    tokens = lambda change: F.coalesce(F.sum(F.when(F.col("change") == change, F.col("compressed_tokens"))), F.lit(0))
    line = lambda change, words: F.when(named(change) != "", _put(named(change), words, format_tokens(tokens(change)), " tokens"))
    return diff.groupBy("session_id").agg(_lines(F.max(_put("block b", target.cast("string"))), line("off", " shown again: "), line("on", " hidden again: ")).alias("reply"))


def blocks_reply(blocks: DataFrame, topics: str = "topic") -> DataFrame:
    """PRD-22, PRD-23: the blocks that a command can name, a line for each."""
    line = _put("b", F.col("block_id").cast("string"), ": ", F.coalesce(F.col(topics), F.lit("")), " (", format_tokens(F.col("compressed_tokens")), ")")
    return blocks.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("reply"))
