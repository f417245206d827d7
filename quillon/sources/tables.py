"""Logical tables of the engine, and how the driver's tables map onto them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: tool of a call by the kind of event it is read from.
TOOLS = {"view": "read", "purchase": "write", "signup": "compress"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, role, text: one text part for each message."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and steps of sessions, in order of time.

    session_id, call_id, seq, created (ms), tool, status, step_start, path,
    input, cache_read, output, cost (in cents), parameters, reason.
    """
    e = read(spark, sf_dir, "events")
    tool = F.lit("bash")
    for kind, name in TOOLS.items():
        tool = F.when(F.col("event_type") == kind, name).otherwise(tool)
    k = F.get_json_object("props", "$.k")
    rows = e.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("call_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created"),
        tool.alias("tool"),
        F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"),
        (F.col("event_type") == "click").alias("step_start"),
        k.alias("path"),
        F.floor("value").cast("long").alias("input"),
        k.cast("long").alias("cache_read"),
        F.length("props").cast("long").alias("output"),
        F.floor(F.col("value") * F.lit(100.0)).cast("long").alias("cost"),
        F.col("props").alias("parameters"),
        F.when(F.col("event_type").isin("view", "purchase"), "tool-calls").when(F.col("event_type") == "click", "stop").otherwise(F.col("event_type")).alias("reason"),
        "ts",
    )
    order = W.partitionBy("session_id").orderBy("ts", "call_id")
    return rows.withColumn("seq", F.row_number().over(order).cast("long")).drop("ts")


def blocks(calls_: DataFrame) -> DataFrame:
    """Compression blocks: one for each compress call, numbered in its session.

    All but every fourth's successor consume the block before; some are taken
    back by the user, some have lost the message they stem from.
    """
    order = W.partitionBy("session_id").orderBy("seq")
    b = calls_.filter("tool = 'compress'").withColumn("block_id", F.row_number().over(order).cast("long"))
    consumed = F.when(F.pmod("block_id", F.lit(4)) != 1, F.array(F.col("block_id") - 1)).otherwise(F.array().cast("array<bigint>"))
    return b.select(
        "session_id", "block_id", F.col("seq").alias("created"), F.col("seq").alias("anchor_seq"), consumed.alias("consumed"),
        (F.pmod("call_id", F.lit(11)) == 0).alias("deactivated_by_user"), (F.pmod("call_id", F.lit(13)) != 0).alias("origin_present"), F.col("input").alias("compressed_tokens"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (first line, cut), directory, parent_id and time_updated of stored sessions."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), F.col("source").alias("directory"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, F.floor(F.col("doc_id") / 5)).cast("long").alias("parent_id"), F.col("doc_id").alias("time_updated"), F.col("doc_id").alias("time_created"), F.col("lang").alias("project_id"),
    )


def projects(s: DataFrame) -> DataFrame:
    """A project for each project_id of sessions: where its newest session works, and when that was."""
    newest = s.filter("project_id is not null").groupBy(F.col("project_id").alias("id")).agg(F.max(F.struct("time_updated", "directory")).alias("x"))
    return newest.select("id", F.col("x.directory").alias("worktree"), F.col("x.time_updated").alias("time_updated"))


def list_sessions(s: DataFrame, directory: str | None = None, roots: bool | None = None, start: int = 0, search: str | None = None, limit: int = 0) -> DataFrame:
    """SRC-3: newest first; ``start`` skips rows and ``limit`` keeps some, each only if positive."""
    if directory is not None:
        s = s.filter(F.col("directory") == directory)
    if roots is not None:
        s = s.filter(F.col("parent_id").isNull() if roots else F.col("parent_id").isNotNull())
    if search:
        s = s.filter(F.lower("title").contains(search.lower()))
    s = s.orderBy(F.desc("time_updated"), F.desc("id"))
    s = s.offset(start) if start > 0 else s
    return s.limit(limit) if limit > 0 else s


def get_session(s: DataFrame, session_id: int) -> DataFrame:
    """SRC-4: one session; a missing one is an error."""
    found = s.filter(F.col("id") == session_id)
    if found.isEmpty():
        raise LookupError(f"no session {session_id}")
    return found


def list_projects(projects: DataFrame) -> DataFrame:
    """SRC-2: id and worktree, the one updated last first."""
    return projects.orderBy(F.desc("time_updated"), "id").select("id", "worktree")


def session_rows(s: DataFrame) -> DataFrame:
    """SRC-15: sessions as they are handed out, with their times in one struct."""
    time = F.struct(F.col("time_created").alias("created"), F.col("time_updated").alias("updated"))
    return s.select("id", F.col("project_id").alias("projectID"), F.col("parent_id").alias("parentID"), "directory", "title", time.alias("time"))


def child_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """SRC-9, SRC-10: the messages of child sessions, beside their parent's id."""
    children = sessions.filter(is_subagent()).select(F.col("id").alias("session_id"), F.col("parent_id").alias("parent_session_id"))
    return messages.join(children, "session_id")


def is_subagent() -> Column:
    """PRD-25: a session with a parent."""
    return F.col("parent_id").isNotNull() & (F.col("parent_id").cast("string") != "")


PAYLOAD = "id string, role string, agent string, modelID string, providerID string, summary boolean, time struct<created:bigint,completed:bigint>, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>"
STORED_PART = (
    "type string, text string, ignored boolean, tool string, callID string, state struct<status:string,input:string,output:string,error:string,metadata:string>, "
    "tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>, cost double, reason string"
)


def _tokens(c: str) -> Column:
    t = F.col(c)
    return F.when(t.isNotNull(), F.struct(t["input"].alias("input"), t["output"].alias("output"), t["reasoning"].alias("reasoning"), t["cache"]["read"].alias("cache_read"), t["cache"]["write"].alias("cache_write")))


def stored_messages(message: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-5, SRC-9: rows of the store (id, session_id, data as JSON, time_created) as messages, numbered in order of time.

    A payload that does not parse leaves the message with empty fields.
    ``limit`` keeps each session's first messages.
    """
    order = W.partitionBy("session_id").orderBy("time_created", "id")
    m = message.withColumn("d", F.from_json("data", PAYLOAD)).withColumn("seq", F.row_number().over(order).cast("long"))
    m = m.filter(F.col("seq") <= limit) if limit else m
    return m.select(
        "session_id", "seq", F.col("id").alias("message_id"), "d.role", F.coalesce("d.time.created", "time_created").alias("created"), F.col("d.time.completed").alias("completed"), F.coalesce("d.summary", F.lit(False)).alias("summary"),
        "d.agent", F.col("d.providerID").alias("provider"), F.col("d.modelID").alias("model"), _tokens("d.tokens").alias("tokens"),
    )


def stored_parts(part: DataFrame) -> DataFrame:
    """SRC-5: rows of the store (id, message_id, session_id, data as JSON, time_created) as parts; payloads that do not parse leave."""
    order = W.partitionBy("session_id", "message_id").orderBy("time_created", "id")
    p = part.withColumn("d", F.from_json("data", STORED_PART)).filter("d.type is not null").withColumn("part_seq", F.row_number().over(order) - 1)
    return p.select(
        "session_id", "message_id", "part_seq", "d.type", "d.text", F.coalesce("d.ignored", F.lit(False)).alias("ignored"), "d.tool", F.col("d.callID").alias("call_id"), "d.state.status", "d.state.input", "d.state.output", "d.state.error", "d.state.metadata",
        _tokens("d.tokens").alias("tokens"), F.col("d.cost").alias("cost"), "d.reason",
    )


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """SRC-1: a read-only query on a SQLite file; rows stream in batches.

    The file must be on a folder that all machines share.  ``ranges`` (from and
    to, the end exclusive) give one task each, for a query with two question
    marks; without them one task reads everything.
    """
    asked = spark.createDataFrame([(a, b) for a, b in ranges or [(None, None)]], "a long, b long").repartition(len(ranges or [0]), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    cursor = db.execute(query, () if ranges is None else (a, b))
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return asked.mapInArrow(run, schema)


#: The tables of a store, as they are named there.
STORE = {
    "project": "id string, worktree string, time_updated long",
    "session": "id string, project_id string, parent_id string, directory string, title string, time_created long, time_updated long",
    "message": "id string, session_id string, data string, time_created long",
    "part": "id string, message_id string, session_id string, data string, time_created long",
}


def store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-1, SRC-14: the tables of a store: a folder with a Parquet table for each, or a SQLite file; a missing one is an error.

    Filters on a table reach the Parquet files, or the queries on the SQLite
    file, of which several tasks read ranges of rows.
    """
    if os.path.isdir(path):
        return {t: spark.read.schema(schema).parquet(f"{path}/{t}.parquet") for t, schema in STORE.items()}
    if not os.path.exists(path):
        raise FileNotFoundError(f"no store at {path}")
    from quillon.sources.session_store import stored_table

    return {t: stored_table(spark, path, t) for t in STORE}
