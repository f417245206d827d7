"""Usage reports over messages with parts: which steps count, and what they sum to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import hit_rate
from quillon.operators.parts import ignored_by_text

TOKENS = ("input", "output", "reasoning", "cache_read", "cache_write")
BUCKETS = (("tool-calls", "tool_calls"), ("stop", "stop"))


def steps(messages: DataFrame, which: str = "every") -> DataFrame:
    """PRD-19, PRD-20: the finished steps of messages: every one, or a message's first or last; tools are all tools of the message, in order."""
    finish = F.filter("parts", lambda p: (p["type"] == "step-finish") & p["tokens"].isNotNull())
    chosen = {"every": finish, "first": F.slice(finish, 1, 1), "last": F.when(F.size(finish) > 0, F.slice(finish, -1, 1)).otherwise(F.slice(finish, 1, 0))}[which]
    tools = F.transform(F.filter("parts", lambda p: p["type"] == "tool"), lambda p: p["tool"])
    rows = messages.select("session_id", "seq", "message_id", "created", "completed", tools.alias("tools"), F.explode(chosen).alias("p"))
    numbers = [F.coalesce(F.col(f"p.tokens.{t}"), F.lit(0)).alias(t) for t in TOKENS]
    return rows.select("session_id", "seq", "message_id", "created", "completed", "tools", *numbers, F.coalesce("p.cost", F.lit(0.0)).alias("cost"), F.coalesce("p.reason", F.lit("unknown")).alias("reason"))


def step_rows(parts: DataFrame, messages: DataFrame | None = None, which: str = "every") -> DataFrame:
    """PRD-19, PRD-20: what steps() gives, from rows of parts: texts and contents of parts are never read or moved.

    Without messages the columns seq, created, completed and tools, which sums
    over steps do not need, are left out.
    """
    own = ["session_id", "message_id"]
    fields = F.struct("part_seq", "tokens", "cost", "reason")
    rows = parts.filter("type = 'step-finish' and tokens is not null").select(*own, fields.alias("p"))
    if which != "every":
        rows = rows.groupBy(*own).agg((F.min if which == "first" else F.max)("p").alias("p"))
    numbers = [F.coalesce(F.col(f"p.tokens.{t}"), F.lit(0)).alias(t) for t in TOKENS]
    values = [*numbers, F.coalesce("p.cost", F.lit(0.0)).alias("cost"), F.coalesce("p.reason", F.lit("unknown")).alias("reason")]
    if messages is None:
        return rows.select(*own, *values)
    tools = parts.filter("type = 'tool'").groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(F.struct("part_seq", "tool"))), lambda x: x["tool"]).alias("tools"))
    whole = rows.join(messages.select(*own, "seq", "created", "completed"), own).join(tools, own, "left")
    return whole.select("session_id", "seq", "message_id", "created", "completed", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), *values)


def impact_cost(first: DataFrame, tools: list[str]) -> DataFrame:
    """AGG-8: contexts before and after a call on average, and the overall hit rates, over the first steps of messages."""
    e = events(first, tools)
    out = e.agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_before", "cache_before", "input_after", "cache_after")])
    mean = lambda when: F.when(F.col("calls") > 0, F.round((F.col(f"input_{when}") + F.col(f"cache_{when}")) / F.col("calls"), 6)).otherwise(0.0).alias(f"context_{when}")
    rate = lambda when: hit_rate(F.col(f"cache_{when}"), F.col(f"input_{when}")).alias(f"hit_{when}")
    return out.select("calls", mean("before"), mean("after"), rate("before"), rate("after"))


def tools_of(names: list[str], tools: str = "tools") -> Column:
    """PRD-18: the tools of a step that are in a set."""
    return F.filter(tools, lambda t: t.isin(names))


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("double" if c == "cost" else "long").alias(c)


def by_session(every: DataFrame) -> DataFrame:
    """AGG-1, AGG-2, AGG-3: sums of all steps of a session, their reasons in three buckets, the total and the hit rate."""
    known = F.when(F.col("reason").isin(*[b for b, _ in BUCKETS]), F.col("reason")).otherwise("other")
    reasons = [F.count(F.when(known == b, 1)).alias(n) for b, n in (*BUCKETS, ("other", "other"))]
    out = every.groupBy("session_id").agg(*[_sum(c) for c in (*TOKENS, "cost")], F.count("*").alias("steps"), *reasons)
    return out.withColumn("total", F.col("input") + F.col("output") + F.col("cache_read")).withColumn("hit_rate", hit_rate(F.col("cache_read"), F.col("input")))


def totals(sessions: DataFrame) -> DataFrame:
    """AGG-4: sums over sessions without their cost, the overall hit rate, and the average of steps to one decimal."""
    out = sessions.agg(F.count("*").alias("sessions"), *[_sum(c) for c in (*TOKENS, "steps", "total")])
    mean = F.when(F.col("sessions") > 0, F.round(F.col("steps") / F.col("sessions"), 1)).otherwise(0.0)
    return out.withColumn("hit_rate", hit_rate(F.col("cache_read"), F.col("input"))).withColumn("mean_steps", mean)


def timeline(last: DataFrame) -> DataFrame:
    """WIN-5: differences to the step before (the first has its own values), the gap since its end, and the duration; times that are missing or 0 give none."""
    order = W.partitionBy("session_id").orderBy("seq")
    before, known = F.lag("completed").over(order), lambda c: c.isNotNull() & (c != 0)
    s = last.withColumns({"before": before, "cache_read_delta": F.col("cache_read") - F.lag("cache_read", 1, 0).over(order), "input_delta": F.col("input") - F.lag("input", 1, 0).over(order)})
    gap = F.when(known(F.col("before")) & known(F.col("created")), F.col("created") - F.col("before")).alias("gap")
    duration = F.when(known(F.col("created")) & known(F.col("completed")), F.col("completed") - F.col("created")).alias("duration")
    return s.select("session_id", "seq", "message_id", "reason", "cache_read_delta", "input_delta", gap, duration, hit_rate(F.col("cache_read"), F.col("input")).alias("hit_rate"))


def timeline_summary(last: DataFrame, tools: list[str]) -> DataFrame:
    """AGG-12: totals of a session's timeline, uses of the tools, and the weighted hit rate."""
    duration = F.when((F.col("created") != 0) & (F.col("completed") != 0), F.col("completed") - F.col("created"))
    s = last.withColumns({"duration": duration, "uses": F.size(tools_of(tools))})
    out = s.groupBy("session_id").agg(F.count("*").alias("steps"), *[_sum(c) for c in ("input", "output", "cache_read", "cost", "duration", "uses")])
    return out.withColumn("hit_rate", hit_rate(F.col("cache_read"), F.col("input")))


def _rate(read: Column, fresh: Column) -> Column:
    return F.when(read + fresh > 0, F.lit(100.0) * read / (read + fresh)).otherwise(0.0)


def events(first: DataFrame, tools: list[str]) -> DataFrame:
    """AGG-5: each call of the tools with the numbers of its step and of the next one; calls in a last step have none and leave."""
    order = W.partitionBy("session_id").orderBy("seq")
    ahead = {f"{c}_after": F.lead(c).over(order) for c in ("input", "cache_read")}
    s = first.withColumns(ahead | {"tool": tools_of(tools)}).filter(F.col("input_after").isNotNull())
    return s.select("session_id", "seq", F.posexplode("tool").alias("nth", "tool"), F.col("input").alias("input_before"), "input_after", F.col("cache_read").alias("cache_before"), F.col("cache_read_after").alias("cache_after"))


def impact_by_tool(first: DataFrame, tools: list[str]) -> DataFrame:
    """AGG-5, SRT-5: averages over calls of hit rates and contexts before and after; most called first, then first seen."""
    e = events(first, tools)
    mean = lambda c: F.round(F.sum(c) / F.count("*"), 6)
    out = e.groupBy("tool").agg(
        F.count("*").alias("calls"), mean(_rate(F.col("cache_before"), F.col("input_before"))).alias("hit_before"), mean(_rate(F.col("cache_after"), F.col("input_after"))).alias("hit_after"),
        mean(F.col("input_before") + F.col("cache_before")).alias("context_before"), mean(F.col("input_after") + F.col("cache_after")).alias("context_after"), F.min(F.struct("session_id", "seq", "nth")).alias("first"),
    )
    return out.orderBy(F.desc("calls"), "first").drop("first")


def recovery(first: DataFrame, tools: list[str], most: int = 15) -> DataFrame:
    """AGG-6, WIN-6: hit rates by steps since the last call of the tools, for the first ``most`` distances."""
    own = W.partitionBy("session_id").orderBy("seq")
    s = first.withColumns({"n": F.row_number().over(own), "hit": F.size(tools_of(tools)) > 0})
    s = s.withColumn("last", F.max(F.when(F.col("hit"), F.col("n"))).over(own.rowsBetween(W.unboundedPreceding, -1))).filter("last is not null")
    rate = _rate(F.col("cache_read"), F.col("input"))
    out = s.groupBy((F.col("n") - F.col("last") - 1).cast("long").alias("distance")).agg(F.count("*").alias("n"), F.round(F.sum(rate) / F.count("*"), 6).alias("mean"), F.round(F.min(rate), 6).alias("least"), F.round(F.max(rate), 6).alias("most"))
    return out.orderBy("distance").limit(most)


def real_user_messages(messages: DataFrame) -> DataFrame:
    """AGG-14: a session's user messages that are not ignored by their texts."""
    real = (F.col("role") == "user") & ~ignored_by_text()
    return messages.groupBy("session_id").agg(F.count(F.when(real, 1)).alias("user_messages"))


def screening(messages: DataFrame, tools: list[str], least: int = 5) -> DataFrame:
    """AGG-7, AGG-14: how many sessions are long enough, how many of them have measured calls, and their calls and steps."""
    first = steps(messages, "first")
    per = real_user_messages(messages).join(first.groupBy("session_id").agg(F.count("*").alias("steps")), "session_id", "left")
    per = per.join(events(first, tools).groupBy("session_id").agg(F.count("*").alias("calls")), "session_id", "left").na.fill(0)
    enough = F.col("user_messages") >= least
    count = lambda c: F.count(F.when(c, 1))
    kept = lambda c: F.coalesce(F.sum(F.when(enough, F.col(c))), F.lit(0)).cast("long").alias(c)
    return per.agg(F.count("*").alias("scanned"), count(~enough).alias("skipped"), count(enough).alias("analysed"), count(enough & (F.col("calls") > 0)).alias("with_calls"), kept("calls"), kept("steps"))


def write_report(sessions: DataFrame, totals_: DataFrame, path: str) -> None:
    """SNK-6: a report as JSON, a folder for sessions and one for totals; each row says when it was made."""
    for df, name in ((sessions, "sessions"), (totals_, "totals")):
        df.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(f"{path}/{name}")
