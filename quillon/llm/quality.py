"""Quality rules whose cutoffs come from the corpus itself.

Every document gets its counts and a few ratios by DataFrame functions alone.
A log-binned quantile sketch (bins of equal relative width, whose counts add
up) is kept for each ratio by language and source; sketches of a language and
of the whole corpus are sums of these.  Upper fences read from the sketches
replace fixed cutoffs, and the documents are filtered by a join with them.
Nothing that a fence is made of is in units of a ratio: a rule has the share of
documents beyond which its tail begins, and fences lie a number of spreads above.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import SPACE_CLASS, Scratch, pick

SPACES = f"[{SPACE_CLASS}]+"
SYMBOLS = "#*$%&|<>"

#: Ratios under rules: the quantile where a rule's tail begins (later where clean texts have few but large steps), and what the ratio is a share of.
RULES = {"symbol_ratio": (0.90, "word_chars"), "upper_ratio": (0.95, "word_chars"), "mark_ratio": (0.90, "n_words"), "dup_line_ratio": (0.99, "n_lines"), "repeat_ratio": (0.99, "n_words"), "word_len": (0.95, "n_words")}
#: Relative error of a sketch's quantiles, and the least ratio told from zero.
ERROR, LEAST = 0.01, 1e-4
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Spreads (median to tail) between the tail's quantile and a fence; rows at which a group's own quantiles count half; deviations of a count that chance explains.
FENCE, HALF_ROWS, CHANCE = 2.0, 20, 3.0


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))

    def starts(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < F.size(s) - 1) & same(i, i + 1)))
        return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("to"))
        step = lambda a, i: F.struct((a["sum"] + i + 5 - F.greatest(i, a["to"])).alias("sum"), (i + 5).alias("to"))
        return F.aggregate(at, zero, step, lambda a: a["sum"])

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(_let(ordered, starts)))

    return F.when(n < 6, F.lit(0)).otherwise(_let(windows, count))


def features(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source and any others) with counts and ratios.

    Null or empty text has no words, characters, symbols or lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).cast("long").alias("n_repeat_words"))

    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    gone = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    out = docs.withColumns({"_w": _let(words, counted), "_l": by_line, "n_symbols": gone(SYMBOLS), "_marks": gone("!?"), "_upper": F.regexp_count(text, F.lit(r"\p{Lu}"))})
    out = out.withColumns({k: F.col(f"_w.{k}") for k in ("n_words", "word_chars", "n_repeat_words")} | {"n_dup_lines": (F.col("_l.n") - F.col("_l.d")).cast("long"), "n_lines": F.col("_l.n").cast("long")})
    of = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    ratios = {
        "symbol_ratio": of(F.col("n_symbols"), F.col("word_chars")),
        "upper_ratio": of(F.col("_upper"), F.col("word_chars")),
        "mark_ratio": of(F.col("_marks"), F.col("n_words")),
        "dup_line_ratio": of(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_ratio": of(F.col("n_repeat_words"), F.col("n_words")),
        "word_len": of(F.col("word_chars"), F.col("n_words")),
    }
    return out.withColumns(ratios).drop("_w", "_l", "_marks", "_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketches(feats: DataFrame) -> DataFrame:
    """lang, source, rule, bin, n: one row for each filled bin; summed before the shuffle."""
    rows = feats.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("z")).select("lang", "source", "z.rule", "z.x")
    bin_ = F.when(F.col("x") <= LEAST, F.lit(None)).otherwise(F.ceil(F.log("x") / F.lit(math.log(GAMMA))).cast("int"))
    return rows.groupBy("lang", "source", "rule", bin_.alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """The sketches of coarser groups: bins add up."""
    return sketch.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """rows, mid (the median) and high (the rule's own quantile) of each group and rule; a group has as many rows here as filled bins."""
    group = W.partitionBy(*by, "rule")
    run = group.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    value = F.coalesce(F.lit(2.0) * F.pow(F.lit(GAMMA), F.col("bin").cast("double")) / (GAMMA + 1), F.lit(0.0))
    ranked = sketch.withColumns({"upto": F.sum("n").over(run), "rows": F.sum("n").over(group), "value": value})
    level = F.create_map(*[F.lit(x) for r, (q, _) in RULES.items() for x in (r, q)])[F.col("rule")]
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("value")))
    return ranked.groupBy(*by, "rule").agg(F.max("rows").alias("rows"), at(0.5).alias("mid"), at(level).alias("high"))


def fences(sketch: DataFrame, fence: float = FENCE, half_rows: int = HALF_ROWS) -> DataFrame:
    """One row for each lang and source with an upper fence for every rule, high + ``fence`` * (high - mid).

    A group of n documents weighs its own quantiles by n / (n + ``half_rows``)
    and those of its language by the rest; a language is weighed against the
    corpus alike.  Every group is judged by its own sketch at any size, and no
    fence steps as a group grows.
    """
    own = quantiles(sketch, "lang", "source")
    lang = quantiles(merged(sketch, "lang"), "lang").select(F.col("lang").alias("lang_"), F.col("rule").alias("rule_"), *[F.col(c).alias(f"lang_{c}") for c in ("rows", "mid", "high")])
    every = quantiles(merged(sketch)).select(F.col("rule").alias("rule__"), *[F.col(c).alias(f"all_{c}") for c in ("mid", "high")])
    joined = own.join(lang, own.lang.eqNullSafe(F.col("lang_")) & (own.rule == F.col("rule_"))).join(F.broadcast(every), own.rule == F.col("rule__"))
    weighed = lambda rows, own, rest: (F.col(rows) * own + F.lit(half_rows) * rest) / (F.col(rows) + F.lit(half_rows))
    blend = lambda q: weighed("rows", F.col(q), weighed("lang_rows", F.col(f"lang_{q}"), F.col(f"all_{q}")))
    wide = joined.select("lang", "source", "rule", (blend("high") + F.lit(fence) * (blend("high") - blend("mid"))).alias("top"))
    return wide.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*[F.max(F.when(F.col("rule") == r, F.col("top"))).alias(f"top_{r}") for r in RULES])


def chance(top: Column, size: Column) -> Column:
    """How far a ratio may pass a fence by chance: so many deviations of the count that the fence stands for, which is one at least."""
    return F.lit(CHANCE) * F.sqrt(F.greatest(top * size, F.lit(1.0))) / F.greatest(size, F.lit(1))


def judged(feats: DataFrame, tops: DataFrame) -> DataFrame:
    """Adds base_failed and kept by a join on language and source.

    The fences have one row for each language and source, so they are broadcast
    by their size; beyond the limit of that, the left side of the join is one
    that adaptive execution splits where a source is frequent.
    """
    ok = ~F.col("base_failed")
    for r, (_, size) in RULES.items():
        ok = ok & (F.col(r) <= F.col(f"top_{r}") + chance(F.col(f"top_{r}"), F.col(size)))
    joined = feats.withColumn("base_failed", base_failed()).join(tops, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.withColumn("kept", F.coalesce(ok, ~F.col("base_failed"))).drop("f_lang", "f_source", *[f"top_{r}" for r in RULES])


def fitted(feats: DataFrame) -> DataFrame:
    """The fences of the documents that pass the base rule; those that fail it leave whatever a fence says."""
    return fences(sketches(feats.filter(~base_failed())))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the ratios, base_failed and kept for every row.

    Null text: no words, so it fails the base rule.  Null lang or source: a
    group like any other.  Repeated rows: each is counted and judged.  Empty
    table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    feats = scratch.save(features(pick(docs, "doc_id", "text", "lang", "source")).drop("text"), "features")
    tops = scratch.save(fitted(feats), "fences")
    return judged(feats, tops)


def keep(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns of documents.

    Features cost far more than a written copy of the rows, so they are worked
    out once and kept beside the text; a later step reads only the columns that
    it needs.
    """
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    scratch = Scratch(docs.sparkSession, "quality")
    feats = scratch.save(features(d), "features")
    tops = scratch.save(fitted(feats), "fences")
    return judged(feats, tops).filter("kept").select(*d.columns)
