"""Compaction as a table function in SQL.

    register(spark)
    spark.sql("SELECT * FROM compact_sessions(TABLE(rows))")

``rows`` are those of operators.compact.compaction_rows.  The function asks for
its rows session by session, messages first, so the caller gives neither
PARTITION BY nor ORDER BY.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from quillon.operators.compact import ARGUMENTS, BLOCKS, MESSAGE, Session, Wording
from quillon.sources.schemas import struct_of

FIELDS = [x.split()[0] for x in MESSAGE.split(", ")]
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
NEEDED = (*FIELDS, "kind", "cmd", *ARGUMENTS)


class CompactSessions:
    """EXT: the blocks of each session; ``keep_user_text`` and ``errors`` as for compact; session_id may have any type."""

    def __init__(self) -> None:
        self.session: Session | None = None
        self.errors, self.failed, self.session_id = False, [], None

    @staticmethod
    def analyze(rows: AnalyzeArgument, keep_user_text: AnalyzeArgument | None = None, errors: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(rows)")
        there = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [c for c in NEEDED if c not in there]
        if missing:
            raise ValueError(f"the table has no {', '.join(missing)}")
        for flag in (keep_user_text, errors):
            if flag is not None and not isinstance(flag.value, bool):
                raise ValueError("keep_user_text and errors are true or false")
        schema: StructType = struct_of(BLOCKS)
        schema["session_id"].dataType = there["session_id"]
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("session_id")], orderBy=[OrderingColumn("kind"), OrderingColumn("seq"), OrderingColumn("cmd")])

    def eval(self, row: Row, keep_user_text: bool = False, errors: bool = False) -> None:
        if self.session is None:
            self.session, self.session_id, self.errors = Session(Wording(), keep_user_text), row["session_id"], errors
        if row["kind"] == 0:
            self.session.add(row["seq"], row["ref"], row["tokens"] or 0, bool(row["ignored"]), row["user_text"], row["tool_ids"] or [], row["kept_outputs"] or [])
            return
        made = self.session.run(self.session_id, row["cmd"], *(row[a] for a in ARGUMENTS))
        if made.get("error"):
            self.failed.append(made)

    def terminate(self) -> Iterator[tuple]:
        if self.session is not None:
            for block in [*self.session.blocks.values(), *(self.failed if self.errors else [])]:
                yield tuple(block.get(n) for n in NAMES)


def register(spark: SparkSession, name: str = "compact_sessions") -> None:
    """Makes the function known to a session's SQL."""
    spark.udtf.register(name, F.udtf(CompactSessions))
