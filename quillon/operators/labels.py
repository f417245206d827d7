"""Labels of calls, lists of pruned calls, and bars over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import file_paths, truncate

#: The words that stand where a call names nothing, and the cells and ends of a bar.
NO_PATH, NO_PATTERN, READ_LIST, PATCH, QUESTION = "(current directory)", "(unknown pattern)", "read todo list", "patch", "question"
ACTIVE, PRUNED, RECENT, END = "█", "░", "⣿", "│"


def parameter_label(tool: Column, parameters: Column) -> Column:
    """STR-5: what a call is about, by tool; unknown tools show the start of their parameters."""
    at = lambda path: F.get_json_object(parameters, f"$.{path}")
    text = lambda path: F.nullif(at(path), F.lit(""))
    put = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    offset, limit = at("offset"), at("limit")
    lines = (
        F.when(offset.isNotNull() & limit.isNotNull(), put(" (lines ", offset, "-", (offset.cast("long") + limit.cast("long")).cast("string"), ")"))
        .when(offset.isNotNull(), put(" (lines ", offset, "+)"))
        .when(limit.isNotNull(), put(" (lines 0-", limit, ")"))
        .otherwise("")
    )
    files = file_paths(F.lit("apply_patch"), parameters)
    n_files = F.size(files)
    patch = F.when(n_files == 0, PATCH).when(n_files <= 2, F.array_join(files, ", ")).otherwise(put(n_files.cast("string"), " files: ", F.get(files, 0), ", ", F.get(files, 1), "..."))
    searched = F.when(text("pattern").isNotNull(), put('"', at("pattern"), '"', F.coalesce(put(" in ", text("path")), F.lit("")))).otherwise(NO_PATTERN)
    command = F.when(F.length(at("command")) > 50, put(F.substring(at("command"), 1, 50), "...")).otherwise(text("command"))
    todos = F.coalesce(F.size(F.from_json(at("todos"), "array<string>")), F.lit(0))
    op, path = F.coalesce(text("operation"), F.lit("lsp")), text("filePath")
    lsp = F.when(path.isNotNull() & at("line").isNotNull() & at("character").isNotNull(), put(op, " ", path, ":", at("line"), ":", at("character"))).when(path.isNotNull(), put(op, " ", path)).otherwise(op)
    questions = F.from_json(at("questions"), "array<struct<header:string>>")
    count = F.size(questions)
    heads = F.slice(F.filter(F.transform(questions, lambda q: q["header"]), lambda h: h.isNotNull() & (h != "")), 1, 3)
    asked = put(count.cast("string"), F.when(count > 1, " questions").otherwise(" question"))
    more = F.when(count > 3, put(" (+", (count - 3).cast("string"), " more)")).otherwise("")
    question = F.when(count > 0, F.when(F.size(heads) > 0, put(asked, ": ", F.array_join(heads, ", "), more)).otherwise(asked)).otherwise(QUESTION)
    by_tool = (
        F.when((tool == "read") & path.isNotNull(), put(path, lines))
        .when(tool.isin("write", "edit", "multiedit") & path.isNotNull(), path)
        .when((tool == "apply_patch") & at("patchText").isNotNull(), patch)
        .when(tool == "list", F.coalesce(text("path"), F.lit(NO_PATH)))
        .when(tool.isin("glob", "grep"), searched)
        .when((tool == "bash") & text("description").isNotNull(), at("description"))
        .when((tool == "bash") & text("command").isNotNull(), command)
        .when((tool == "webfetch") & text("url").isNotNull(), at("url"))
        .when(tool.isin("websearch", "codesearch") & text("query").isNotNull(), put('"', at("query"), '"'))
        .when(tool == "todowrite", put(todos.cast("string"), " todos"))
        .when(tool == "todoread", READ_LIST)
        .when((tool == "task") & text("description").isNotNull(), at("description"))
        .when((tool == "skill") & text("name").isNotNull(), at("name"))
        .when(tool == "lsp", lsp)
        .when(tool == "question", question)
    )
    rest = F.when(parameters.isin("{}", "[]", "null"), "").otherwise(F.substring(parameters, 1, 50))
    return F.when(parameters.isNull() | (parameters == ""), "").otherwise(F.coalesce(by_tool, rest))


def shorten_path(label: Column, root: str) -> Column:
    """STR-4: a path below the working folder without it, the folder itself as a dot; of ``X in PATH`` the path alone."""
    prefix, inner = F.regexp_extract(label, r"^(.+) in (.+)\z", 1), F.regexp_extract(label, r"^(.+) in (.+)\z", 2)

    def one(path: Column) -> Column:
        return F.when(F.startswith(path, F.lit(root + "/")), F.substr(path, F.lit(len(root) + 2))).when(path == root, ".").otherwise(path)

    return F.when(inner != "", F.concat(prefix, F.lit(" in "), one(inner))).otherwise(one(label))


def pruned_items(ids: DataFrame, calls: DataFrame, root: str) -> DataFrame:
    """STR-10: for each session a line for each pruned call in order of ``pos``, and one that counts the calls nothing is known of.

    ids has session_id, pos and call_id; a call_id of calls is there once.
    """
    return item_lines(ids.join(calls.select("session_id", "call_id", "tool", "parameters"), ["session_id", "call_id"], "left"), root)


def item_lines(found: DataFrame, root: str) -> DataFrame:
    """STR-10: the lines of pruned_items from rows of session_id, pos, tool and parameters; tool is null where nothing is known of a call."""
    label = parameter_label(F.col("tool"), F.col("parameters"))
    line = F.when(F.col("tool").isNotNull(), F.concat(F.lit("→ "), F.col("tool"), F.when(label != "", F.concat(F.lit(": "), truncate(shorten_path(label, root), 60))).otherwise("")))
    per = found.groupBy("session_id").agg(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("pos", line.alias("line"))))).alias("lines"), F.count(F.when(F.col("tool").isNull(), 1)).alias("unknown"))
    tail = F.when(F.col("unknown") > 0, F.array(F.concat(F.lit("→ ("), F.col("unknown").cast("string"), F.lit(" tool"), F.when(F.col("unknown") > 1, "s").otherwise(""), F.lit(" with unknown metadata)")))).otherwise(F.array().cast("array<string>"))
    return per.select("session_id", F.concat(F.transform("lines", lambda x: x["line"]), tail).alias("lines"))


def progress_bars(messages: DataFrame, pruned: DataFrame, recent: DataFrame, width: int = 50) -> DataFrame:
    """MTH-8: a bar of ``width`` cells for each session; each message fills the cells of its share, recent before pruned before active.

    pruned and recent have session_id and message_id.  A cell belongs to the
    last message whose share covers it.
    """
    mark = lambda df, name: df.select("session_id", "message_id").distinct().withColumn(name, F.lit(True))
    m = messages.join(mark(recent, "is_recent"), ["session_id", "message_id"], "left").join(mark(pruned, "is_pruned"), ["session_id", "message_id"], "left")
    own = W.partitionBy("session_id")
    m = m.withColumns({"at": F.row_number().over(own.orderBy("seq")) - 1, "total": F.count("*").over(own)})
    place = lambda i: F.floor(i / F.col("total") * F.lit(float(width))).cast("int")
    m = m.withColumns({"start": place(F.col("at")), "end": place(F.col("at") + 1)}).filter("start < end and (is_recent or is_pruned)")
    cells = m.select("session_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("cell"), F.when(F.col("is_recent"), RECENT).otherwise(PRUNED).alias("mark"))
    special = cells.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "mark"))).alias("marks"))
    every = messages.select("session_id").distinct().join(special, "session_id", "left")
    cell = lambda i: F.coalesce(F.try_element_at("marks", i), F.lit(ACTIVE))
    bar = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell), "")
    return every.select("session_id", F.concat(F.lit(END), bar, F.lit(END)).alias("bar"))


def percent(part: Column, whole: Column) -> Column:
    """MTH-9: rounded half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + F.lit(0.5))).otherwise(0).cast("long")


def first_lines(body: Column, most: int = 12) -> Column:
    """STR-11: a text of more than ``most`` lines keeps one fewer, and a line that counts the rest."""
    lines = F.split(body, "\n")
    n = F.size(lines)
    return F.when(n > most, F.concat(F.array_join(F.slice(lines, 1, most - 1), "\n"), F.lit("\n... and "), (n - most + 1).cast("string"), F.lit(" more"))).otherwise(body)


def short_section(message: Column, marker: str, most: int = 600) -> Column:
    """STR-11: the part from the marker on, cut to ``most`` characters."""
    at = F.instr(message, marker)
    section = F.substr(message, at)
    return F.when((at > 0) & (F.length(section) > most), F.concat(F.substr(message, F.lit(1), at - 1), truncate(section, most))).otherwise(message)
