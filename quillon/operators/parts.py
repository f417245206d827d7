"""Operators over messages with parts: predicates, tool contents and tokens, and the rewriting of pruned parts.

Messages have session_id, seq, message_id, role, created, summary, tokens and
parts (see sources.history).  ``pruned`` is a table of session_id and call_id.
``hidden`` is a table of session_id and message_id that active blocks cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.history import PART, PART_FIELDS
from quillon.functions.text import file_paths, path_protected, token_count, tool_protected, utf16_length

Part = Callable[[Column], Column]
#: Counts the tokens of a text column (see functions.tokens).
Count = Callable[[Column], Column]
#: Tools whose results stay, and tools whose input counts as content.
RESULTS_STAY, INPUT_COUNTS = ("question", "edit", "write"), ("edit", "write")
OUTPUT_GONE, INPUT_GONE, QUESTIONS_GONE = "[pruned]", "[pruned input]", "[pruned questions]"


def is_type(kind: str) -> Part:
    return lambda p: p["type"] == kind


def of_type(kind: str, parts: str = "parts") -> Column:
    return F.filter(F.col(parts), is_type(kind))


def ignored_user(parts: str = "parts") -> Column:
    """PRD-4 for a user's message."""
    return (F.col("role") == "user") & F.forall(F.col(parts), lambda p: p["ignored"])


def ignored_by_text(parts: str = "parts") -> Column:
    """PRD-5: no parts; or some text, all of it ignored."""
    texts = of_type("text", parts)
    return (F.size(parts) == 0) | ((F.size(texts) > 0) & F.forall(texts, lambda p: p["ignored"]))


def has_compress(parts: str = "parts", tool: str = "compress") -> Column:
    """PRD-7: a completed call of the tool."""
    return F.exists(F.col(parts), lambda p: (p["type"] == "tool") & (p["tool"] == tool) & (p["status"] == "completed"))


def with_compaction(m: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """PRD-6, AGG-16: adds last_compaction and compacted: before the last summary by position, or covered by an active block."""
    summary = (F.col("role") == "assistant") & F.col("summary")
    last = F.max(F.when(summary, F.struct("seq", "created"))).over(W.partitionBy("session_id"))["created"]
    m = m.withColumn("last_compaction", F.coalesce(last, F.lit(0)).cast("long"))
    old = F.col("created") < F.col("last_compaction")
    if hidden is None:
        return m.withColumn("compacted", old)
    marks = hidden.select("session_id", "message_id").distinct().withColumn("_hidden", F.lit(True))
    return m.join(marks, ["session_id", "message_id"], "left").withColumn("compacted", old | F.coalesce("_hidden", F.lit(False))).drop("_hidden")


def told(m: DataFrame) -> DataFrame:
    """Messages with what tool_calls reads of their parts in place of them, tokens counted, so that no output is moved when marks are joined."""
    fields = lambda p: F.struct(*[p[c].alias(c) for c in ("part_seq", "type", "call_id", "tool", "status", "input")], tool_tokens(p).alias("tokens"))
    return m.withColumn("_told", F.transform(F.filter("parts", lambda p: p["type"].isin("tool", "step-start")), fields)).drop("parts")


def tool_calls(m: DataFrame, count: Count = token_count) -> DataFrame:
    """PRN-6, WIN-4: the tool parts with a call_id and a tool outside compacted messages, with their place, turn and the session's current turn.

    m has ``compacted`` (see with_compaction), and parts or what ``told`` makes
    of them.  turn is the number of step starts before the call.  ``count``
    counts tokens.
    """
    counted = "_told" in m.columns
    said = F.col("_told") if counted else F.filter("parts", lambda p: p["type"].isin("tool", "step-start"))
    rows = m.filter("not compacted").select("session_id", "seq", "message_id", F.explode(said).alias("p"))
    order = W.partitionBy("session_id").orderBy("seq", "p.part_seq")
    started = F.sum(F.when(F.col("p.type") == "step-start", 1).otherwise(0))
    rows = rows.withColumns({"turn": started.over(order.rowsBetween(W.unboundedPreceding, 0)), "current_turn": started.over(W.partitionBy("session_id"))})
    calls = rows.filter("p.type = 'tool' and p.call_id is not null and p.call_id <> '' and p.tool <> ''")
    return calls.select("session_id", "seq", "message_id", "p.part_seq", "p.call_id", "p.tool", "p.status", F.col("p.input").alias("parameters"), "turn", "current_turn", (F.col("p.tokens") if counted else tool_tokens(F.col("p"), count)).alias("token_count"))


def tool_ids(calls: DataFrame) -> DataFrame:
    """PRD-17: place of each call in its session's list."""
    order = W.partitionBy("session_id").orderBy("seq", "part_seq")
    return calls.select("session_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "call_id")


def tool_contents(p: Column) -> Column:
    """MTH-3: the texts that a tool part puts into the context."""
    questions = F.get_json_object(p["input"], "$.questions")
    given = F.when(p["tool"].isin(*INPUT_COUNTS) & (p["input"] != ""), p["input"])
    result = F.when((p["status"] == "completed") & (p["output"] != ""), p["output"]).when((p["status"] == "error") & (p["error"] != ""), p["error"])
    return F.filter(F.when(p["tool"] == "question", F.array(questions)).otherwise(F.array(given, result)), lambda x: x.isNotNull())


def tool_tokens(p: Column, count: Count = token_count) -> Column:
    """MTH-2, MTH-3: tokens of a tool part's texts, joined by a space."""
    return count(F.array_join(tool_contents(p), " "))


def total_tool_tokens(ids: DataFrame, calls: DataFrame) -> DataFrame:
    """JOIN-9: tokens of the wanted calls of each session; unknown calls count nothing."""
    found = ids.join(calls.select("session_id", "call_id", "token_count"), ["session_id", "call_id"], "left")
    return found.groupBy("session_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).cast("long").alias("tokens"), F.count("*").alias("calls"))


def message_tokens(parts: str = "parts", count: Count = token_count) -> Column:
    """MTH-4: tokens of a message's texts and tool contents, in order, joined by a space; reasoning and steps count nothing."""
    texts = F.transform(F.col(parts), lambda p: F.when(p["type"] == "text", F.array(F.coalesce(p["text"], F.lit("")))).when(p["type"] == "tool", tool_contents(p)).otherwise(F.array().cast("array<string>")))
    return count(F.array_join(F.flatten(texts), " "))


def last_message(m: DataFrame) -> DataFrame:
    """WIN-11: the last message that is not an ignored user's."""
    return m.filter(~ignored_user()).groupBy("session_id").agg(F.max(F.struct("seq", "role", "message_id")).alias("x")).select("session_id", "x.*")


def current_tokens(m: DataFrame) -> DataFrame:
    """AGG-15: all five terms of the last assistant message with output; 0 without one."""
    t = F.col("tokens")
    total = sum((F.coalesce(t[c], F.lit(0)) for c in ("output", "reasoning", "cache_read", "cache_write")), F.coalesce(t["input"], F.lit(0)))
    spoke = (F.col("role") == "assistant") & (t["output"] > 0)
    return m.groupBy("session_id").agg(F.coalesce(F.max(F.when(spoke, F.struct("seq", total.alias("n"))))["n"], F.lit(0)).alias("current_tokens"))


def system_tokens(m: DataFrame) -> DataFrame:
    """AGG-17: input-side tokens of the first assistant message with any, without those of the first real user text; null if nothing is left."""
    t = F.col("tokens")
    given = F.coalesce(t["input"], F.lit(0)) + F.coalesce(t["cache_read"], F.lit(0)) + F.coalesce(t["cache_write"], F.lit(0))
    first = F.min(F.when((F.col("role") == "assistant") & (given > 0), F.struct("seq", given.alias("n"))))["n"]
    shown = F.filter(of_type("text"), lambda p: ~p["ignored"])
    text = F.array_join(F.transform(shown, lambda p: p["text"]), "")
    user = F.min(F.when((F.col("role") == "user") & ~ignored_user(), F.struct("seq", text.alias("text"))))["text"]
    out = m.groupBy("session_id").agg(first.alias("opening"), user.alias("first_text"))
    left = F.col("opening") - token_count(F.coalesce("first_text", F.lit("")))
    return out.select("session_id", F.when(left > 0, left).alias("system_tokens"))


def _marked(m: DataFrame, pruned: DataFrame) -> DataFrame:
    """Adds gone, the pruned call_ids of a message's session; sessions are joined, calls looked up in an array."""
    sets = pruned.groupBy("session_id").agg(F.collect_set("call_id").alias("gone"))
    return m.join(sets, "session_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))


def without_fields(json: Column, change: Callable[[Column, Column], Column]) -> Column:
    """A JSON object with its top-level values changed; other JSON as it is.  Types stay: values are variants."""
    fields = F.try_parse_json(json).try_cast("map<string,variant>")
    return F.coalesce(F.to_json(F.transform_values(fields, change)), json)


def prune_parts(m: DataFrame, pruned: DataFrame, output_text: str = OUTPUT_GONE, input_text: str = INPUT_GONE, questions_text: str = QUESTIONS_GONE) -> DataFrame:
    """PRN-8, PRN-9, PRN-10 in order, outside compacted messages.

    Of a pruned call that completed, the output becomes a placeholder, unless
    its tool is a question, an edit or a write; a question loses the questions
    of its input.  Of a pruned call that failed, each top-level string of the
    input becomes a placeholder; numbers, lists and objects stay.
    """
    text = lambda s: F.to_variant_object(F.struct(F.lit(s).alias("x")))
    as_variant = lambda s: F.variant_get(text(s), "$.x", "variant")

    def rewritten(p: Column) -> Column:
        hit = (p["type"] == "tool") & F.array_contains(F.col("gone"), p["call_id"])
        done, failed = hit & (p["status"] == "completed"), hit & (p["status"] == "error")
        strings = without_fields(p["input"], lambda k, v: F.when(F.schema_of_variant(v) == "STRING", as_variant(input_text)).otherwise(v))
        asked = without_fields(p["input"], lambda k, v: F.when(k == "questions", as_variant(questions_text)).otherwise(v))
        p = p.withField("output", F.when(done & ~p["tool"].isin(*RESULTS_STAY), F.lit(output_text)).otherwise(p["output"]))
        return p.withField("input", F.when(done & (p["tool"] == "question"), asked).when(failed, strings).otherwise(p["input"]))

    new = F.when(F.col("compacted"), F.col("parts")).otherwise(F.transform("parts", rewritten))
    return _marked(m, pruned).withColumn("parts", new).drop("gone")


def drop_full_tools(m: DataFrame, pruned: DataFrame) -> DataFrame:
    """PRN-11: pruned edits and writes leave with their parts, and messages that have no part left leave too."""
    gone = lambda p: (p["type"] == "tool") & p["tool"].isin(*INPUT_COUNTS) & F.array_contains(F.col("gone"), p["call_id"])
    m = _marked(m, pruned).withColumn("left", F.when(F.col("compacted"), F.col("parts")).otherwise(F.filter("parts", lambda p: ~F.coalesce(gone(p), F.lit(False)))))
    return m.filter((F.size("left") > 0) | (F.size("parts") == 0)).withColumn("parts", F.col("left")).drop("left", "gone")


#: What the ids of summaries start with.
SUMMARY_ID = "summary"


def in_place(m: DataFrame, hidden: DataFrame, summaries: DataFrame | None = None, id_prefix: str = SUMMARY_ID) -> DataFrame:
    """JOIN-3, SET-1, PRN-13: the messages that a request shows, with summaries in place of those that blocks cover.

    hidden (session_id, message_id) are the messages that active blocks cover;
    they leave.  summaries (session_id, anchor_seq, block_id, active, summary):
    of the active ones at an anchor the one with the largest block_id becomes a
    user's message right before it, if its text is not empty, its anchor is a
    stored message (covered or not), and some real user's message stands at or
    before it, covered ones included.  That message's agent, provider, model and
    variant are the summary's too.

    Adds from_seq, the stored seq (null for summaries); seq counts anew from 1.
    message_id is a string: a summary's is the prefix and 16 hex digits that
    depend on block and anchor alone.  A summary is as new as its session's
    latest message.

    Stored messages and summaries are one union in the order of seq and rank;
    one window over it carries the last user on and numbers what is left.
    """
    marks = hidden.select("session_id", "message_id").distinct().withColumn("_covered", F.lit(True))
    stored = m.join(marks, ["session_id", "message_id"], "left").withColumns({"_rank": F.lit(1), "_covered": F.coalesce("_covered", F.lit(False)), "message_id": F.col("message_id").cast("string")})
    stored = stored.withColumns({"_block": F.lit(None).cast("long"), "_text": F.lit(None).cast("string")})
    if summaries is None:
        numbered = stored.filter("not _covered").withColumn("from_seq", F.col("seq")).withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("from_seq")).cast("long"))
        return numbered.drop("_rank", "_covered", "_block", "_text")
    owners = summaries.filter("active").groupBy("session_id", F.col("anchor_seq").alias("seq")).agg(F.max(F.struct(F.col("block_id").cast("long").alias("b"), F.col("summary").alias("t"))).alias("_x"))
    owners = owners.select("session_id", "seq", F.col("_x.b").alias("_block"), F.col("_x.t").alias("_text")).filter("_text <> ''")
    new = owners.withColumns({"_rank": F.lit(0), "_covered": F.lit(False)})
    both = stored.unionByName(new, allowMissingColumns=True)
    place = W.partitionBy("session_id").orderBy("seq", "_rank")
    who = [c for c in ("agent", "provider", "model", "variant") if c in m.columns]
    real = F.when((F.col("_rank") == 1) & (F.col("role") == "user") & ~ignored_user(), F.struct(F.lit(True).alias("known"), *who))
    both = both.withColumn("_user", real)
    carried = F.coalesce(F.lead("_user").over(place), F.last("_user", ignorenulls=True).over(place.rowsBetween(W.unboundedPreceding, -1)))
    both = both.withColumns({
        "_carried": F.when(F.col("_rank") == 0, carried), "_anchor": F.when(F.lead("seq").over(place) == F.col("seq"), F.lead("message_id").over(place)), "_late": F.max("created").over(W.partitionBy("session_id")),
    })
    shown = both.filter("not _covered and (_rank = 1 or (_anchor is not null and _carried.known))")
    shown = shown.withColumn("from_seq", F.when(F.col("_rank") == 1, F.col("seq"))).withColumn("seq", F.row_number().over(place).cast("long"))
    own = F.col("_rank") == 0
    seed = F.concat_ws(":", F.col("_block").cast("string"), "_anchor")
    said = {f: F.lit(None) for f in PART_FIELDS} | {"part_seq": F.lit(0), "type": F.lit("text"), "text": F.col("_text"), "ignored": F.lit(False)}
    values = {c: F.col(f"_carried.{c}") for c in who} | {
        "message_id": F.concat_ws("_", F.lit(id_prefix), F.substring(F.sha2(seed, 256), 1, 16)), "role": F.lit("user"), "summary": F.lit(False), "compacted": F.lit(False), "created": F.col("_late"),
        "parts": F.array(F.struct(*[said[f].alias(f) for f in PART_FIELDS]).cast(PART)),
    }
    return shown.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in values.items() if c in shown.columns}).drop("_rank", "_covered", "_block", "_text", "_user", "_carried", "_anchor", "_late")


def prune(m: DataFrame, pruned: DataFrame, hidden: DataFrame, summaries: DataFrame | None = None, **texts: str) -> DataFrame:
    """PRN-12: summaries take the place of covered messages (see in_place), then outputs, questions and inputs of failed calls go.

    What is compacted is judged by all stored messages, covered ones included.
    """
    return prune_parts(in_place(with_compaction(m), hidden, summaries), pruned, **texts)


def reset_on_compaction(decisions: DataFrame, m: DataFrame) -> DataFrame:
    """PRN-16: decisions (session_id, made) that a later compaction of their session has not cleared."""
    last = with_compaction(m).groupBy("session_id").agg(F.max("last_compaction").alias("last_compaction"))
    return decisions.join(last, "session_id", "left").filter(F.col("made") >= F.coalesce("last_compaction", F.lit(0))).drop("last_compaction")


def eligible(calls: DataFrame, protect_turns: int) -> DataFrame:
    """PRN-6: the calls that turn protection has let go."""
    return calls.filter(F.col("current_turn") - F.col("turn") >= protect_turns) if protect_turns > 0 else calls


def sweep(m: DataFrame, pruned: DataFrame, last_n: int | None = None, protected_tools: list[str] = (), protected_paths: list[str] = ()) -> DataFrame:
    """PRN-7, SRT-4, WIN-12, WIN-13: calls swept by a command, and those skipped as protected.

    The last n calls, or those in messages after the last real user message (in
    a session without one, nothing).  Calls pruned already are neither.
    """
    calls = tool_calls(m)
    if last_n:
        newest = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq"), F.desc("part_seq")))
        wanted = calls.withColumn("rn", newest).filter(F.col("rn") <= last_n).drop("rn")
    else:
        last = m.filter((F.col("role") == "user") & ~ignored_user()).groupBy("session_id").agg(F.max("seq").alias("last_user"))
        wanted = calls.join(last, "session_id").filter(F.col("seq") > F.col("last_user")).drop("last_user")
    wanted = wanted.join(pruned.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti")
    kept = tool_protected(F.col("tool"), list(protected_tools)) | path_protected(file_paths(F.col("tool"), F.col("parameters")), list(protected_paths))
    return wanted.select("session_id", "call_id", "token_count", kept.alias("protected"))


def sweep_report(swept: DataFrame) -> DataFrame:
    """PRN-7: what a sweep tells of each session."""
    free = F.when(~F.col("protected"), F.lit(1))
    return swept.groupBy("session_id").agg(F.count(free).alias("swept"), F.coalesce(F.sum(free * F.col("token_count")), F.lit(0)).cast("long").alias("tokens"), F.count(F.when(F.col("protected"), 1)).alias("skipped"))


def measured(m: DataFrame, count: Count | None = None) -> DataFrame:
    """Messages with what breakdown reads of their parts in place of them: lengths, counts and the names of calls, no texts.

    So nothing wide is moved when marks are joined to messages; with ``count``,
    a tokenizer, it also counts texts here, those of calls that are not in the
    context included.
    """
    texts = F.transform(of_type("text"), lambda p: utf16_length(p["text"]))
    said = F.array_join(F.transform(of_type("text"), lambda p: p["text"]), "\n")
    length = lambda text: F.when(text != "", utf16_length(text))
    calls = F.transform(of_type("tool"), lambda p: F.struct(p["call_id"].alias("call_id"), (p["status"] == "completed").alias("done"), length(p["input"]).alias("given"), length(p["output"]).alias("made")))
    zero = F.lit(0).cast("long")
    m = m.withColumns({"_real": (F.col("role") == "user") & ~ignored_user(), "_pieces": F.size(texts), "_chars": F.aggregate(texts, zero, lambda a, x: a + x)})
    m = m.withColumn("_said", zero if count is None else count(F.when(F.col("_real"), said)))
    if count is None:
        return m.withColumn("_calls", calls).drop("parts")
    # a tokenizer cannot stand inside a lambda of an array function
    rows = m.select("session_id", "message_id", F.posexplode(of_type("tool")).alias("at", "p"))
    rows = rows.select("session_id", "message_id", "at", F.struct(count(F.col("p.input")).alias("given_tokens"), count(F.when(F.col("p.status") == "completed", F.col("p.output"))).alias("made_tokens")).alias("n"))
    counted = rows.groupBy("session_id", "message_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("_n"))
    both = F.zip_with("_calls", "_n", lambda c, n: c.withField("given_tokens", n["given_tokens"]).withField("made_tokens", n["made_tokens"]))
    return m.withColumn("_calls", calls).drop("parts").join(counted, ["session_id", "message_id"], "left").withColumn("_calls", both).drop("_n")


def breakdown(m: DataFrame, pruned: DataFrame, hidden: DataFrame, count: Count | None = None) -> DataFrame:
    """AGG-10: how a session's last token total divides into system, user, tools and, as the rest, assistant; and counts of calls.

    m has ``compacted``, and parts or what ``measured`` makes of them.  Texts
    are never gathered: a joined text's length is the sum of lengths and
    separators.  With ``count``, a tokenizer, the counts of a session's texts,
    message by message and call by call, add up.
    """
    t = F.col("tokens")
    if "parts" in m.columns:
        m = measured(m, count)
    m = m.join(hidden.select("session_id", "message_id").distinct().withColumn("covered", F.lit(True)), ["session_id", "message_id"], "left")
    real_user = F.col("_real")
    opening = t["input"] + t["cache_read"] + t["cache_write"]
    shown = real_user & ~F.col("compacted")
    first_said = F.min(F.when(real_user, F.struct("seq", F.when(shown, F.col("_said")).otherwise(0).alias("n"))))["n"]
    per = m.groupBy("session_id").agg(
        F.sum(F.when(shown, F.col("_said"))).alias("said"), first_said.alias("first_said"),
        F.min(F.when((F.col("role") == "assistant") & (opening > 0), F.struct("seq", opening.alias("n"))))["n"].alias("opening"),
        F.sum(F.when(shown, F.col("_chars"))).alias("chars"),
        F.sum(F.when(shown, F.col("_pieces"))).alias("pieces"),
        F.min(F.when(real_user, F.struct("seq", F.when(F.col("compacted"), 0).otherwise(F.col("_chars")).alias("n"))))["n"].alias("first_chars"),
    )
    calls = m.select("session_id", "compacted", F.coalesce("covered", F.lit(False)).alias("covered"), F.explode("_calls").alias("p")).select("session_id", "compacted", "covered", "p.*")
    calls = calls.join(pruned.select("session_id", "call_id").distinct().withColumn("gone", F.lit(True)), ["session_id", "call_id"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    open_ = ~F.col("compacted") & ~F.col("gone")
    given, made = F.when(open_, F.col("given")), F.when(open_ & F.col("done"), F.col("made"))
    tokens = {k: F.when(open_, F.col(k)) if count is not None else F.lit(0) for k in ("given_tokens", "made_tokens")}
    calls = calls.withColumns({"_given": tokens["given_tokens"], "_made": tokens["made_tokens"]})
    cid = F.col("call_id")
    tools = calls.groupBy("session_id").agg(
        F.sum("_given").alias("given_tokens"), F.sum("_made").alias("made_tokens"), joined_length(given).alias("given"), joined_length(made).alias("made"), F.countDistinct(cid).alias("tools"), F.countDistinct(F.when(open_, cid)).alias("tools_in_context"), F.countDistinct(F.when(F.col("gone") | F.col("covered"), cid)).alias("tools_pruned")
    )
    covered = m.groupBy("session_id").agg(F.count("covered").alias("messages_pruned"))
    j = per.join(current_tokens(m), "session_id").join(covered, "session_id").join(tools, "session_id", "left").na.fill(0)
    j = j.withColumns({"system": F.greatest(F.lit(0), F.col("opening") - quarter(F.col("first_chars"))), "user": quarter(F.greatest(F.lit(0), F.col("chars") + F.col("pieces") - 1)), "tool_tokens": quarter(F.col("given")) + quarter(F.col("made"))})
    if count is not None:
        j = j.withColumns({"system": F.greatest(F.lit(0), F.col("opening") - F.col("first_said")), "user": F.col("said"), "tool_tokens": F.col("given_tokens") + F.col("made_tokens")})
    j = j.withColumn("system", F.when(F.col("opening") > 0, F.col("system")).otherwise(0).cast("long"))
    rest = F.greatest(F.lit(0), F.col("current_tokens") - F.col("system") - F.col("user") - F.col("tool_tokens"))
    return j.select("session_id", F.col("current_tokens").alias("total"), "system", "user", "tool_tokens", rest.alias("assistant"), "tools", "tools_in_context", "tools_pruned", "messages_pruned")


def quarter(chars: Column) -> Column:
    return F.floor(chars / F.lit(4.0) + F.lit(0.5)).cast("long")


def joined_length(lengths: Column) -> Column:
    """Length of texts joined by one character, from their lengths; nulls are left out."""
    return F.greatest(F.coalesce(F.sum(lengths), F.lit(0)) + F.count(lengths) - 1, F.lit(0))
