"""Mixing sources to target weights by weighted fair queueing.

Within a source the documents stand in shuffled order, by a hash.  A document's
virtual finish time is the number of its source's words up to it, divided by the
source's target; a second round through a source goes on counting.  All finish
times are range-sorted together and cut where the words taken reach the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import SPACE_CLASS, Scratch, counted_copies, each_copy, pick

WEIGHTS, SHARE, MOST_REPEATS = (5.0, 2.0, 1.0), 1.5, 2
#: Different rows that one running sum covers.
RUN_ROWS = 1024
#: Bits of the order that buckets are cut from.
ORDER_BITS = 32
KEY = ("h", "doc_id")


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.regexp_count(bare, F.lit(f"[{SPACE_CLASS}]+")) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """source, words, target for a row of source and words for each source.

    A target is the source's share by weight, held at ``most`` times its size,
    the excess shared again by weight.  That is min(cap, level * weight) for one
    level: with the sources in order of cap / weight, those up to some place
    are held, and the level is what is left for the others over their weights.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.select("source", "words", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("rn"))
    ranked = ranked.withColumns({"weight": F.element_at(cycle, F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1), "cap": F.lit(float(most)) * F.col("words")})
    ranked = ranked.withColumns({"ratio": F.col("cap") / F.col("weight"), "budget": F.lit(float(share)) * F.sum("words").over(W.partitionBy())})
    order = W.orderBy("ratio", "rn")
    held = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("budget") - held) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("ratio", "rn", "level"))).over(W.partitionBy())["level"]
    return ranked.withColumn("final", first).select("source", "words", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), "cap").alias("target"))


def _order(seed: int) -> Column:
    """A row's place in the shuffled order of its source; equal rows alone have equal ones."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.col("text"), F.lit(""))))


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return pick(docs, "doc_id", "text", "source").select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("h"))


def queue(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 7) -> tuple[DataFrame, float]:
    """Rows with source_size, target and upto (the source's words up to the row), and the cut in virtual time.

    Equal rows are counted before they are placed and stand next to each other,
    so neither a running sum nor a task gets more of them for being many.
    """
    rows = scratch.save(counted_copies(_rows(docs, seed)), "rows")
    words = F.col("size") * F.col("copies")
    per_source = scratch.save(rows.groupBy("source").agg(F.sum(words).alias("words"), F.count("*").alias("rows")), "sources")
    whole = per_source.agg(F.sum("words").alias("words"), F.max("rows").alias("rows")).first()
    small = scratch.save(targets(per_source, weights, share).select(F.col("source").alias("t_source"), F.col("words").alias("source_size"), "target"), "targets")
    bits = min(ORDER_BITS, ((whole["rows"] or 0) // RUN_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, ORDER_BITS // 4), 16, 10).cast("long"), ORDER_BITS - bits))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum(words).alias("s")).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("source", "bucket").orderBy(*KEY, "size").rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("run", F.sum(words).over(within) - words)
    placed = run.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    placed = placed.join(small, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("base", F.col("start") + F.col("run"))
    placed = placed.select(*KEY, "source", "size", "source_size", "target", "base", "copies")
    every = each_copy(placed, *KEY)
    placed = scratch.save(every.select(*KEY, "source", "size", "source_size", "target", (F.col("base") + F.col("size") * (F.col("nth") + 1)).alias("upto")), "placed")
    scratch.keep("placed")
    return placed, _cut(placed, scratch, share * (whole["words"] or 0))


def finish(round_: int) -> Column:
    """Virtual finish time in a round, from 0."""
    return F.when(F.col("target") > 0, (F.col("upto") + round_ * F.col("source_size")) / F.col("target"))


def _cut(placed: DataFrame, scratch: Scratch, budget: float) -> float:
    """The last finish time up to which the words taken stay within the budget.

    Rows without words take nothing and stay out, so within a source no two
    rows finish at one time; what is summed in order is one range partition.
    """
    items = placed.filter("size > 0").select("size", F.explode(F.array(*[finish(r) for r in range(MOST_REPEATS)])).alias("f")).filter("f is not null")
    line = scratch.save(items.repartitionByRange("f").withColumn("part", F.spark_partition_id()), "line")
    parts = line.groupBy("part").agg(F.sum("size").alias("s"), F.max("f").alias("top")).orderBy("part").collect()  # a row for each partition
    taken, cut = 0, 0.0
    for p in parts:
        if taken + p["s"] > budget:
            run = F.sum("size").over(W.orderBy("f").rangeBetween(W.unboundedPreceding, 0))
            inside = line.filter(F.col("part") == p["part"]).withColumn("run", run).filter(F.col("run") + taken <= budget).agg(F.max("f").alias("f")).first()["f"]
            cut = inside if inside is not None else cut
            break
        taken, cut = taken + p["s"], p["top"]
    scratch.drop("line")
    return cut


def times_taken(cut: float) -> Column:
    return sum((F.coalesce(finish(r) <= F.lit(cut), F.lit(False)).cast("int") for r in range(MOST_REPEATS)), F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row.

    Null text and text without words: size 0, nothing to take.  Null sources
    are one source, the last.  Null ids and repeated rows stay in; equal rows
    stand next to each other.  Empty table: no rows.  Reruns agree: the order
    hashes doc_id and text, and sums are of whole numbers.
    """
    placed, cut = queue(docs, Scratch(docs.sparkSession, "mixing"), weights, share)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken(cut)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 7) -> DataFrame:
    """The rows of the mix with the columns of documents, repeats as rows of their own.

    What a source gives is its queue up to one place in each round, so texts are
    met by these places, one row for each source, and not by a join on ids.
    Where the last place falls among equal rows, all of them are taken.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed, cut = queue(docs, scratch, weights, share, seed)
    key = F.struct(*KEY, "size")
    last = [F.max(F.when(finish(r) <= F.lit(cut), key)).alias(f"last{r}") for r in range(MOST_REPEATS)]
    cuts = scratch.save(placed.groupBy(F.col("source").alias("c_source")).agg(*last), "cuts")
    scratch.keep("cuts")
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    own = d.withColumns({"h": _order(seed), "size": word_count(F.col("text"))})
    joined = own.join(cuts, F.col("source").eqNullSafe(F.col("c_source")))
    times = sum((F.coalesce(key <= F.col(f"last{r}"), F.lit(False)).cast("int") for r in range(MOST_REPEATS)), F.lit(0))
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).filter(times >= F.col("nth")).select(*d.columns)
