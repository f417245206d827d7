"""Results of child sessions, put into the outputs of the calls that started them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import scrub_tags
from quillon.operators.parts import has_compress, of_type

#: The block of an output that holds a child's result, in any case of letters.
BLOCK = r"(?is)\A(.*?)(<task_result>\s*)(.*?)(\s*</task_result>)(.*)\z"


def result_texts(messages: DataFrame) -> DataFrame:
    """STR-8: a session's result: the last text with words of its last assistant message; before it that of the second to last, if that one compressed."""
    own = W.partitionBy("session_id").orderBy(F.desc("seq"))
    last = messages.filter("role = 'assistant'").withColumn("rn", F.row_number().over(own)).filter("rn <= 2")
    texts = F.filter(F.transform(of_type("text"), lambda p: F.trim(p["text"])), lambda t: t.isNotNull() & (t != ""))
    last = last.select("session_id", "rn", F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit("")).alias("text"), has_compress().alias("compressed"))
    pick = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    per = last.groupBy("session_id").agg(pick(1, "text").alias("last"), F.when(pick(2, "compressed"), pick(2, "text")).alias("before"))
    return per.select("session_id", F.concat_ws("\n\n", F.nullif("before", F.lit("")), F.nullif("last", F.lit(""))).alias("result"))


def child_session(metadata: Column) -> Column:
    """JOIN-4: the child's session in a call's metadata; null if it is blank."""
    return F.nullif(F.trim(F.get_json_object(metadata, "$.sessionId")), F.lit(""))


def merged(output: Column, result: Column) -> Column:
    """STR-7: the output with the result in place of the body of its first block; tags stay."""
    part = lambda i: F.regexp_extract(output, BLOCK, i)
    found = output.rlike(BLOCK) & (F.coalesce(result, F.lit("")) != "")
    return F.when(found, F.concat(part(1), part(2), result, part(4), part(5))).otherwise(output)


def with_results(messages: DataFrame, children: DataFrame, pruned: DataFrame, block_tag: str, id_tag: str, tool: str = "task") -> DataFrame:
    """JOIN-4, SRC-10: outputs of completed calls of the tool that are not pruned, with their children's results.

    Returns session_id, message_id, call_id and output of the calls that change.
    children has messages with parts; a session_id there may be of any type.
    """
    calls = messages.select("session_id", "message_id", F.explode(of_type("tool")).alias("p")).filter((F.col("p.tool") == tool) & (F.col("p.status") == "completed") & F.col("p.output").isNotNull() & (F.col("p.call_id") != ""))
    calls = calls.select("session_id", "message_id", "p.call_id", "p.output", child_session(F.col("p.metadata")).alias("child"))
    calls = calls.join(pruned.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti")
    results = result_texts(children).select(F.col("session_id").cast("string").alias("child"), "result").filter("result <> ''")
    out = scrub_tags(merged(F.col("output"), F.col("result")), block_tag, id_tag)
    return calls.join(results, "child").select("session_id", "message_id", "call_id", out.alias("output"))
