"""Data sources of stored sessions: a SQLite store read in ranges, and a writer of one file for each session.

``register(spark)`` makes both known; then

    spark.read.format("session_store").option("path", file).option("table", "part").load()
    rows.write.format("session_files").mode("append").option("path", folder).save()
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillon.sources.schemas import struct_of

#: Stored rows that one task reads, and rows of a batch.
ROWS, BATCH = 100_000, 5_000
COMPARED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Range(InputPartition):
    """Rows whose number lies in [first, last]."""

    first: int
    last: int


def as_sql(f: Filter, columns: set[str]) -> tuple[str, list] | None:
    """A filter as a condition with its values, or None if the store cannot judge it."""
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in columns:
        return None
    name = f'"{column[0]}"'
    if isinstance(f, EqualTo) and f.value is not None:
        return f"{name} = ?", [f.value]
    if isinstance(f, In) and f.value:
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if type(f) in COMPARED:
        return f"{name} {COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL", []
    if isinstance(f, IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, StringStartsWith):
        return f"substr({name}, 1, ?) = ?", [len(f.value), f.value]
    return None


class StoreReader(DataSourceReader):
    """Reads a table of the store: the filters it is given go into the query, and each task has a range of rows."""

    def __init__(self, path: str, table: str, schema: StructType, rows: int, limit: int | None):
        self.path, self.table, self.schema, self.rows, self.limit = path, table, schema, rows, limit
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {f.name for f in self.schema.fields}
        for f in filters:
            found = as_sql(f, names)
            if found is None:
                yield f
            else:
                self.where.append(found[0])
                self.values += found[1]

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{quote(self.path)}?mode=ro", uri=True)

    def _condition(self, *more: str) -> str:
        parts = [*self.where, *more]
        return f" WHERE {' AND '.join(parts)}" if parts else ""

    def partitions(self) -> list[Range]:
        """Ranges of about ``rows`` wanted rows each, found by counting along the row numbers."""
        db = self._open()
        try:
            steps = [r[0] for r in db.execute(f'SELECT n FROM (SELECT rowid AS n, row_number() OVER (ORDER BY rowid) AS k FROM "{self.table}"{self._condition()}) WHERE k % ? = 1 OR ? = 1 ORDER BY n', (*self.values, self.rows, self.rows))]
            last = db.execute(f'SELECT max(rowid) FROM "{self.table}"{self._condition()}', self.values).fetchone()[0]
        finally:
            db.close()
        if self.limit is not None or not steps:
            return [Range(steps[0], last)] if steps else [Range(0, -1)]
        return [Range(a, b) for a, b in zip(steps, [*(s - 1 for s in steps[1:]), last], strict=True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        end = "" if self.limit is None else f" ORDER BY rowid LIMIT {int(self.limit)}"
        db = self._open()
        try:
            cursor = db.execute(f'SELECT {names} FROM "{self.table}"{self._condition("rowid >= ?", "rowid <= ?")}{end}', (*self.values, partition.first, partition.last))
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        finally:
            db.close()


class StoreSource(DataSource):
    """SRC-1: options path and table; rows (stored rows a task reads), limit (rows in all, by one task), columns (their names, comma between)."""

    @classmethod
    def name(cls) -> str:
        return "session_store"

    def schema(self) -> StructType:
        from quillon.sources.tables import STORE

        table = self.options.get("table", "session")
        if table not in STORE:
            raise ValueError(f"no table {table} in a store; there are {', '.join(STORE)}")
        whole = struct_of(STORE[table])
        wanted = self.options.get("columns")
        return whole if wanted is None else StructType([whole[c.strip()] for c in wanted.split(",")])

    def reader(self, schema: StructType) -> StoreReader:
        path = self.options.get("path")
        if not path or not os.path.exists(path):
            raise FileNotFoundError(f"no store at {path}")
        limit = self.options.get("limit")
        return StoreReader(path, self.options.get("table", "session"), schema, max(1, int(self.options.get("rows", ROWS))), None if limit is None else int(limit))


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has written: where they are, and what they are to be called."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    """Writes beside the files that are there; a commit puts each one in its place by a rename, an abort takes them away."""

    def __init__(self, path: str):
        self.path, self.staging = path, os.path.join(path, f".job-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        os.makedirs(self.staging, exist_ok=True)
        files = []
        for batch in iterator:
            for session, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("session_id", "content")), strict=True):
                if session is None or text is None:
                    continue
                name = os.path.join(self.staging, uuid.uuid4().hex)  # a second attempt of a task writes files of its own
                with open(name, "w", encoding="utf-8") as f:
                    f.write(text)
                files.append((name, f"{quote(str(session), safe='')}.json"))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        import shutil

        for m in messages:
            for name, wanted in m.files if m is not None else []:
                os.replace(name, os.path.join(self.path, wanted))
        shutil.rmtree(self.staging, ignore_errors=True)  # what lost attempts have left

    def abort(self, messages: list[Staged | None]) -> None:
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


class FilesSource(DataSource):
    """SNK-2, SNK-6: rows of session_id and content, a file for each session in the folder ``path``, which all machines share.

    A session's file is replaced as a whole; files of other sessions stay.  Rows
    without session_id or content are left out.  Of two rows of one session one
    counts.
    """

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        return "session_id string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are replaced session by session: use mode append")
        missing = {"session_id", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        os.makedirs(self.options["path"], exist_ok=True)
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets filters reach the store."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
    spark.dataSource.register(FilesSource)


def stored_table(spark: SparkSession, path: str, table: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("session_store").options(path=path, table=table, **options).load()


class BatchSink:
    """A sink for foreachBatch that leaves one copy of a batch however often it comes.

    A batch is written beside the others and then renamed to ``batch=N``; where
    that is there already the batch has been written before, and nothing
    changes.  A batch that fails leaves only files without a name.
    """

    def __init__(self, path: str, file_format: str = "parquet"):
        self.path, self.file_format = path.rstrip("/"), file_format

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        done, staged = at(f"batch={batch}"), f".staged-{uuid.uuid4().hex}"
        files = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(done):
            return
        try:
            rows.write.format(self.file_format).save(f"{self.path}/{staged}")
            if not files.rename(at(staged), done):
                raise RuntimeError(f"batch {batch} could not be put in place")
        finally:
            files.delete(at(staged), True)

    def read(self, spark: SparkSession) -> DataFrame:
        """All batches, with their numbers as ``batch``."""
        return spark.read.format(self.file_format).load(self.path)
