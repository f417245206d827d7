"""Reports over a store of sessions: python -m quillon REPORT --store PATH."""

from __future__ import annotations

import argparse
import json
import sys
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import format_duration
from quillon.operators import reports as rp
from quillon.operators import usage as us
from quillon.sources import tables as tb
from quillon.sources.history import with_parts

#: Sessions that are asked for by name, and rows of a table that are laid out together.
FEW, PAGE = 500, 1000
#: Tools whose calls are measured unless others are named.
TOOLS = ["compress", "decompress", "prune"]


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """SRC-14: the options of all reports."""
    parser = argparse.ArgumentParser(prog="quillon")
    sub = parser.add_subparsers(dest="report", required=True)
    for name, words in (("usage", "tokens of sessions"), ("impact", "what calls of some tools do to the cache"), ("timeline", "the steps of one session"), ("find", "sessions by title"), ("message", "messages by id")):
        p = sub.add_parser(name, help=words)
        p.add_argument("--store", required=True, help="SQLite file, or folder of Parquet tables")
        p.add_argument("--session-limit", type=int, default=5000, help="newest sessions that are looked at")
        p.add_argument("--session", help="one session by id")
        p.add_argument("--json", action="store_true", help="one JSON object a row")
        if name in ("usage", "impact"):
            p.add_argument("--sessions", type=int, default=10 if name == "usage" else 20, help="newest sessions that are counted")
        if name in ("impact", "timeline"):
            p.add_argument("--tools", nargs="+", default=TOOLS)
        if name == "impact":
            p.add_argument("--least", type=int, default=5, help="real user messages that a session needs")
        if name == "find":
            p.add_argument("term")
            p.add_argument("--exact", action="store_true")
        if name == "message":
            p.add_argument("ids", nargs="+")
            p.add_argument("--scan-sessions", type=int, default=200)
    return parser.parse_args(argv)


def report(spark: SparkSession, args: argparse.Namespace) -> list[DataFrame]:
    """The tables of one report."""
    t = tb.store(spark, args.store)
    listed = tb.list_sessions(t["session"], limit=args.session_limit)
    if args.report == "find":
        return [rp.search_sessions(listed, args.term, args.exact).select("id", "title", "time_updated")]
    if args.session:
        listed = tb.get_session(t["session"], args.session)
    elif args.report == "timeline":
        listed = tb.list_sessions(t["session"], limit=1)
    elif args.report in ("usage", "impact"):
        listed = tb.list_sessions(t["session"], limit=min(args.sessions, args.session_limit))
    chosen = F.broadcast(listed.select(F.col("id").alias("session_id"), "title", "time_updated"))  # session_limit rows at most
    few = [r["session_id"] for r in chosen.select("session_id").limit(FEW + 1).collect()]

    def of_chosen(table: DataFrame) -> DataFrame:
        """Rows of the chosen sessions; of a few by name, so that the store reads no others."""
        return table.filter(F.col("session_id").isin(few)) if len(few) <= FEW else table.join(chosen.select("session_id"), "session_id", "left_semi")

    m = with_parts(tb.stored_messages(of_chosen(t["message"])), tb.stored_parts(of_chosen(t["part"])))
    if args.report == "message":
        found = rp.find_messages(args.ids, m, listed, 0 if args.session else args.scan_sessions)
        return [found.withColumn("parts", F.to_json("parts"))]
    if args.report == "usage":
        by = us.by_session(us.steps(m))
        return [chosen.join(by, "session_id", "left").orderBy(F.desc("time_updated")).drop("time_updated"), us.totals(by)]
    if args.report == "timeline":
        last = us.steps(m, "last")
        line = us.timeline(last).withColumns({"duration": format_duration(F.col("duration")), "gap": format_duration(F.col("gap"))})
        return [line.orderBy("seq"), us.timeline_summary(last, args.tools)]
    enough = us.real_user_messages(m).filter(F.col("user_messages") >= args.least).select("session_id")
    first = us.steps(m.join(enough, "session_id", "left_semi"), "first")
    return [us.screening(m, args.tools, args.least), us.impact_by_tool(first, args.tools), us.recovery(first, args.tools)]


def text_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows as text in columns; numbers stand to the right."""
    cells = [["" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r] for r in rows]
    width = [max(map(len, column)) for column in zip(columns, *cells, strict=True)]
    right = [all(isinstance(r[i], int | float) or r[i] is None for r in rows) for i in range(len(columns))]
    line = lambda xs: "  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(xs, width, right, strict=True)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in width]), *map(line, cells)])


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    try:
        for df in report(spark, args):
            rows = df.toLocalIterator()  # a partition at a time, whatever the number of rows
            if args.json:
                for r in rows:
                    print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))
                continue
            page = [tuple(r) for r in islice(rows, PAGE)]
            while True:
                print(text_table(df.columns, page))
                page = [tuple(r) for r in islice(rows, PAGE)]
                if not page:
                    break
            print()
    except (FileNotFoundError, LookupError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
