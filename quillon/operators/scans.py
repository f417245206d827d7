"""Running values of long sessions in many tasks: a prefix scan over buckets, and next-pointers.

A session is cut into buckets of its order column.  Every bucket has a summary
of a few numbers, which add up; the summaries of a session, one row for each
bucket, are scanned by a window, and what lies before (or after) a bucket is
joined to its rows, which a window over the bucket alone completes.  So a window
over rows never holds more than a bucket, and a window over summaries a
``width``-th of a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of a bucket.
WIDTH = 1 << 16


def prefix_scan(
    rows: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, after: dict[str, Column] | None = None, order: tuple[str, ...] = ("seq",), width: int = WIDTH
) -> DataFrame:
    """Adds running values by session_id and ``order``, whose first column is a whole number that buckets are cut by.

    sums: the sum of a column over the rows up to each one, itself included;
    lasts: the last value up to it that is not null; nexts: the first one from
    it on; after: the sum over the rows behind it.  Rows with equal order are
    scanned in any order.  Nulls add nothing; a sum without a value is 0.
    """
    sums, lasts, nexts, after = sums or {}, lasts or {}, nexts or {}, after or {}
    key = ["session_id", "_bucket"]
    place = F.struct(*order)
    r = rows.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(width)).cast("long"))
    summary = {f"_s_{n}": F.sum(c) for n, c in {**sums, **after}.items()} | {f"_l_{n}": F.max(F.when(c.isNotNull(), F.struct(place.alias("at"), c.alias("v")))) for n, c in lasts.items()}
    summary |= {f"_f_{n}": F.min(F.when(c.isNotNull(), F.struct(place.alias("at"), c.alias("v")))) for n, c in nexts.items()}
    per = r.groupBy(*key).agg(*[c.alias(n) for n, c in summary.items()])
    own = W.partitionBy("session_id").orderBy("_bucket")
    before, behind = own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(1, W.unboundedFollowing)
    carried = {f"_b_{n}": F.sum(f"_s_{n}").over(before) for n in sums} | {f"_b_{n}": F.sum(f"_s_{n}").over(behind) for n in after}
    carried |= {f"_b_{n}": F.last(f"_l_{n}", ignorenulls=True).over(before)["v"] for n in lasts} | {f"_b_{n}": F.first(f"_f_{n}", ignorenulls=True).over(behind)["v"] for n in nexts}
    edges = per.select(*key, *[c.alias(n) for n, c in carried.items()])
    inner = W.partitionBy(*key).orderBy(*order)
    up, down = inner.rowsBetween(W.unboundedPreceding, 0), inner.rowsBetween(1, W.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    r = r.join(edges, key)
    new = {n: zero(F.sum(c).over(up)) + zero(F.col(f"_b_{n}")) for n, c in sums.items()} | {n: zero(F.sum(c).over(down)) + zero(F.col(f"_b_{n}")) for n, c in after.items()}
    new |= {n: F.coalesce(F.last(c, ignorenulls=True).over(up), F.col(f"_b_{n}")) for n, c in lasts.items()}
    new |= {n: F.coalesce(F.first(c, ignorenulls=True).over(inner.rowsBetween(0, W.unboundedFollowing)), F.col(f"_b_{n}")) for n, c in nexts.items()}
    return r.withColumns(new).drop("_bucket", *[f"_b_{n}" for n in (*sums, *lasts, *nexts, *after)])


def turns(calls: DataFrame, width: int = WIDTH) -> DataFrame:
    """WIN-4: derive.turns for sessions of any length."""
    return prefix_scan(calls, sums={"turn": F.col("step_start").cast("long")}, width=width)


def last_user(messages: DataFrame, width: int = WIDTH) -> DataFrame:
    """WIN-7, WIN-8: derive.last_user for sessions of any length."""
    shown = ~F.col("ignored") if "ignored" in messages.columns else F.lit(True)
    m = prefix_scan(messages, lasts={"_user": F.when((F.col("role") == "user") & shown, F.col("seq"))}, after={"after": F.when(shown, 1).cast("long")}, width=width)
    return m.select("session_id", "seq", F.coalesce("_user", F.lit(-1)).alias("last_user_seq"), "after")


def message_refs(messages: DataFrame, most: int = 9999, width: int = WIDTH) -> DataFrame:
    """WIN-1: derive.message_refs of sessions that are no child sessions, for sessions of any length."""
    m = prefix_scan(messages.filter(F.col("role").isin("user", "assistant")), sums={"_n": F.lit(1).cast("long")}, width=width)
    safe = F.when(F.col("_n") <= most, F.col("_n")).otherwise(F.raise_error(F.lit("too many messages for references")).cast("long"))
    digits = max(4, len(str(most)))
    return m.select("session_id", "seq", F.concat(F.lit("m"), F.lpad(safe.cast("string"), digits, "0")).alias("ref"))


def turn_anchors(messages: DataFrame, width: int = WIDTH) -> DataFrame:
    """WIN-9: pressure.turn_anchors for sessions of any length: the role before and behind a message are the values carried to its neighbours."""
    m = messages.filter(F.col("role").isin("user", "assistant")).select("session_id", "seq", "role")
    numbered = prefix_scan(m, sums={"_n": F.lit(1).cast("long")}, width=width)
    pair = F.struct("seq", "role")
    # a message meets the one behind it under its own number
    met = numbered.select("session_id", "_n", pair.alias("a"))
    late = numbered.select("session_id", (F.col("_n") - 1).alias("_n"), pair.alias("b"))
    both = met.join(late, ["session_id", "_n"]).filter("a.role = 'assistant' and b.role = 'user'")
    return both.select("session_id", F.explode(F.array("a", "b")).alias("x")).select("session_id", "x.seq", "x.role")


def spaced_anchors(candidates: DataFrame, interval: int, written: Callable[[DataFrame, str], DataFrame], width: int = WIDTH) -> DataFrame:
    """WIN-10: in order, each candidate that is the first or at least ``interval`` behind the last one taken; no task reads a whole session.

    Every candidate points to the first one at least ``interval`` behind it.
    The taken ones are those that the first one reaches.  Pointers double, so
    twenty rounds reach a million of them.  ``written`` writes a table under a
    name and reads it back, so a round never plans those before it.
    """
    c = candidates.select("session_id", F.col("seq").cast("long").alias("seq")).distinct()
    # a candidate's threshold looks for the next candidate from there on
    asked = c.select("session_id", (F.col("seq") + max(1, interval)).alias("at"), F.lit(0).alias("kind"), F.col("seq").alias("of"))
    there = c.select("session_id", F.col("seq").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("of"))
    found = prefix_scan(asked.unionByName(there), nexts={"to": F.when(F.col("kind") == 1, F.col("at"))}, order=("at", "kind"), width=width).filter("kind = 0 and to is not null")
    jump = written(found.select("session_id", F.col("of").alias("seq"), "to"), "jump0")
    taken = written(c.groupBy("session_id").agg(F.min("seq").alias("seq")), "taken0")
    k = 0
    while not jump.isEmpty():
        k += 1
        reached = taken.join(jump, ["session_id", "seq"]).select("session_id", F.col("to").alias("seq"))
        taken = written(taken.unionByName(reached).distinct(), f"taken{k}")
        further = jump.select("session_id", F.col("seq").alias("from"), F.col("to").alias("seq")).join(jump, ["session_id", "seq"])
        jump = written(further.select("session_id", F.col("from").alias("seq"), "to"), f"jump{k}")
    return taken
