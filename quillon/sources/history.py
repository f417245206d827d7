"""Messages and parts of stored sessions, and how the driver's events map onto them.

A part is a row with a type: text, reasoning, tool, step-start or step-finish.
Values that events do not have (states, texts, tokens) are invented here and
nowhere else, from the event's number and its ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = {
    "part_seq": "int", "type": "string", "text": "string", "ignored": "boolean", "tool": "string", "call_id": "string", "status": "string", "input": "string", "output": "string", "error": "string", "metadata": "string",
    "tokens": "struct<input:bigint,output:bigint,reasoning:bigint,cache_read:bigint,cache_write:bigint>", "cost": "double", "reason": "string",
}
PART_FIELDS = tuple(TYPES)
PART = f"struct<{','.join(f'{name}:{kind}' for name, kind in TYPES.items())}>"
#: Folder that paths of calls are below.
ROOT = "/work/app"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("e"), F.col("user_id").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created"), "event_type", k.alias("k"), F.floor("value").cast("long").alias("v"), "props")


def _mod(n: int, c: str = "e") -> Column:
    return F.pmod(F.col(c), F.lit(n))


def _user() -> Column:
    return F.col("event_type") == "click"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place in the session: the one shuffle, of rows as they are read; all that is made of them follows in its tasks."""
    order = W.partitionBy("session_id").orderBy("created", "e")
    return _events(spark, sf_dir).withColumn("seq", F.row_number().over(order).cast("long"))


def _message() -> list[Column]:
    user = _user()
    done = F.when(~user & (_mod(5) != 0), F.when(_mod(9) == 0, 0).otherwise(F.col("created") + F.col("v") * 10))
    return [
        F.col("session_id"), F.col("seq"), F.col("e").alias("message_id"), F.when(user, "user").otherwise("assistant").alias("role"), F.col("created"), done.cast("long").alias("completed"),
        (~user & (_mod(211) == 0)).alias("summary"), F.concat(F.lit("agent-"), _mod(2).cast("string")).alias("agent"), F.concat(F.lit("p"), _mod(2).cast("string")).alias("provider"), F.concat(F.lit("m"), _mod(3).cast("string")).alias("model"),
        F.when(user & (_mod(4) == 1), "fast").alias("variant"),
        F.when(~user, _tokens(0)).alias("tokens"),
    ]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, message_id, role, created, completed, summary, agent, provider, model, variant, tokens (null for users)."""
    return _numbered(spark, sf_dir).select(*_message())


def _tokens(more: int) -> Column:
    return F.struct((F.col("v") + more).alias("input"), (_mod(4) * 10).alias("output"), _mod(7).alias("reasoning"), (F.col("k") * 10).alias("cache_read"), _mod(3).alias("cache_write"))


def _text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _called(e: DataFrame) -> DataFrame:
    """Adds what an event's calls have in common, made once for all of them: tool, status, given, made, failure, about."""
    k = F.col("k").cast("string")
    path = _text('"filePath":"', F.when(_mod(2, "k") == 0, ROOT + "/").otherwise(""), "src/k", _mod(20, "k").cast("string"), '.py"')
    tool = (
        F.when(F.col("event_type") == "view", F.when(_mod(5) == 0, "list").otherwise("read"))
        .when(F.col("event_type") == "purchase", F.when(_mod(2) == 0, "write").otherwise("edit"))
        .when(F.col("event_type") == "signup", F.when(_mod(3) == 0, "task").otherwise("compress"))
        .otherwise(F.when(_mod(4) == 3, "question").otherwise("bash"))
    )
    e = e.withColumn("tool", tool)
    is_ = lambda *names: F.col("tool").isin(*names)
    given = (
        F.when(is_("read"), _text("{", path, F.when(_mod(3) > 0, _text(',"offset":', k)).otherwise(""), F.when(_mod(3) == 2, ',"limit":50').otherwise(""), "}"))
        .when(is_("list"), F.when(_mod(2) == 0, '{"path":"src"}').otherwise("{}"))
        .when(is_("write", "edit"), _text("{", path, ',"content":"line ', k, '"}'))
        .when(is_("compress"), _text('{"topic":"t', k, '","n":', k, ',"nested":{"a":"b"},"none":null}'))
        .when(is_("task"), _text('{"description":"part ', k, '","prompt":"do"}'))
        .when(is_("question"), _text('{"questions":[{"header":"H', _mod(3, "k").cast("string"), '","question":"why"},{"header":"","question":"how"}]}'))
        .otherwise(_text('{"command":"run --all --of --the --steps --up --to --number ', k, '","n":', k, ',"deep":{"x":"y"}}'))
    )
    failed = (F.col("event_type") == "error") & is_("bash")
    status = F.when(failed, "error").when(_mod(13) == 0, "running").otherwise("completed")
    made = _text("out ", F.col("props"), F.when(is_("task"), "\n<Task_Result>\nold\n</Task_Result> <task_result>kept</task_result>").otherwise(""))
    metadata = F.when(is_("task") & (_mod(2) == 0), _text('{"sessionId":" ', (F.col("session_id") + 1).cast("string"), ' "}')).otherwise(F.when(is_("task"), '{"sessionId":""}').otherwise('{"src":"x"}'))
    e = e.withColumns({"status": status, "given": given, "about": metadata})
    return e.withColumns({"made": F.when(F.col("status") == "completed", made), "failure": F.when(F.col("status") == "error", _text("failed with ", k))})


def _parts() -> list[tuple[Column, dict[str, object]]]:
    """When an event (see _called) has each of its parts, and the fields that the part does not leave empty."""
    k = F.col("k").cast("string")

    def part(seq: int, kind: str, when: Column, **fields: object) -> tuple[Column, dict[str, object]]:
        return when, {"part_seq": F.lit(seq), "type": F.lit(kind), "ignored": F.lit(False)} | fields

    user = _user()
    reason = F.when(F.col("event_type").isin("view", "purchase"), "tool-calls").when(F.col("event_type") == "signup", "stop")
    call = {"tool": F.col("tool"), "status": F.col("status"), "input": F.col("given"), "output": F.col("made"), "error": F.col("failure"), "metadata": F.col("about")}
    named = lambda letter: _text(letter, F.col("e").cast("string"))
    return [
        part(0, "text", user & (_mod(11) > 0), text=_text("ask ", F.col("props")), ignored=_mod(7) == 0),
        part(1, "text", user & (_mod(11) > 0) & (_mod(3) == 0), text=_text("and more ", F.col("e").cast("string")), ignored=(_mod(7) == 0) & (_mod(2) == 0)),
        part(0, "step-start", ~user),
        part(1, "reasoning", ~user & (_mod(3) == 1), text=_text("thinking of ", k), metadata=F.lit('{"m":1}')),
        part(2, "tool", ~user, call_id=F.when(_mod(53) > 0, named("c")), **call),
        part(3, "text", ~user & (_mod(6) == 0), text=_text(" done ", k, F.when(_mod(12) == 0, "<note>gone</note>").otherwise(""))),
        part(4, "step-finish", ~user & (_mod(17) > 0), tokens=_tokens(0), cost=F.col("v") * 3, reason=reason),
        part(5, "step-finish", ~user & (_mod(19) == 0), tokens=_tokens(7), cost=F.col("v"), reason=F.lit("stop")),
        # a fifth of the answers make their call again, half of these twice
        part(6, "tool", ~user & (_mod(5) == 0), call_id=named("d"), **call),
        part(7, "tool", ~user & (_mod(10) == 0), call_id=named("b"), **call),
    ]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, message_id and the fields of PART, one row for each part; fields that are not asked for are never made."""
    every = _parts()
    held = F.array_compact(F.array(*[F.when(when, F.lit(i)) for i, (when, _) in enumerate(every)]))
    one = _called(_events(spark, sf_dir)).withColumn("i", F.explode(held))

    def field(name: str) -> Column:
        cases = [(F.col("i") == i, row[name]) for i, (_, row) in enumerate(every) if name in row]
        value = F.when(*cases[0])
        for when, x in cases[1:]:
            value = value.when(when, x)
        return value.cast(TYPES[name]).alias(name)

    return one.select("session_id", F.col("e").alias("message_id"), *[field(f) for f in PART_FIELDS])


def with_parts(m: DataFrame, p: DataFrame) -> DataFrame:
    """SRC-5, JOIN-1: messages with the array of their parts in order; a message without parts has an empty one."""
    own = p.groupBy("session_id", "message_id").agg(F.sort_array(F.collect_list(F.struct(*PART_FIELDS))).alias("parts"))
    empty = F.array().cast(f"array<{PART}>")
    return m.join(own, ["session_id", "message_id"], "left").withColumn("parts", F.coalesce(F.col("parts").cast(f"array<{PART}>"), empty))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and rows of parts, as two tables of a store hold them, put together."""
    return with_parts(messages(spark, sf_dir), parts(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joined() gives. An event is a message with all its parts, so they are made in place: no text is shuffled."""
    none = {f: F.lit(None) for f in PART_FIELDS}
    every = [F.when(when, F.struct(*[(none | row)[f].alias(f) for f in PART_FIELDS]).cast(PART)) for when, row in _parts()]
    return _called(_numbered(spark, sf_dir)).select(*_message(), F.array_compact(F.array(*every)).alias("parts"))
