"""Nudges over messages with parts: when to anchor them, and where their text goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.parts import current_tokens, has_compress, ignored_user
from quillon.operators.pressure import resolved_limit
from quillon.sources.history import PART, PART_FIELDS

Limit = int | str | None


def current_model(messages: DataFrame) -> DataFrame:
    """PRD-24: agent, provider, model and, where there is such a column, variant of each session's last real user message."""
    who = [c for c in ("agent", "provider", "model", "variant") if c in messages.columns]
    last = messages.filter((F.col("role") == "user") & ~ignored_user()).groupBy("session_id").agg(F.max(F.struct("seq", *who)).alias("x"))
    return last.select("session_id", *[f"x.{c}" for c in who])


def session_limit(limit: Limit, by_model: dict[str, int | str], model_limit: Column) -> Column:
    """NDG-2: the limit of a session's provider/model, else the general one; columns provider and model."""
    out = resolved_limit(F.lit(None if limit is None else str(limit)).cast("string"), model_limit)
    for name, value in by_model.items():
        out = F.when(F.concat_ws("/", "provider", "model") == name, resolved_limit(F.lit(str(value)), model_limit)).otherwise(out)
    return out


def decisions(
    messages: DataFrame, most: Limit, least: Limit, model_limit: Column, most_by_model: dict[str, int | str] | None = None, least_by_model: dict[str, int | str] | None = None,
    threshold: int = 15, frequency: int = 5, anchors: DataFrame | None = None, denied: bool = False, manual: bool = False,
) -> DataFrame:
    """NDG-3: what one request decides for each session.

    decision is off (denied or manual), compressed (the last assistant message
    has compressed: all anchors are cleared), below (turn and iteration anchors
    are cleared), over (a context anchor at the last message) or between (turn
    anchors at the last user and assistant message; an iteration anchor once
    ``threshold`` messages follow the last user's).  Context and iteration
    anchors keep ``frequency`` messages from the last one in ``anchors``
    (session_id, kind, seq).  Columns context_seq, iteration_seq, turn_user_seq
    and turn_assistant_seq are null where nothing is anchored.
    """
    m = messages.select("session_id", "seq", "role", ignored_user().alias("ignored"), has_compress().alias("compressed"))
    shown = ~F.col("ignored")
    own = W.partitionBy("session_id")
    m = m.withColumn("user_seq", F.max(F.when(shown & (F.col("role") == "user"), F.col("seq"))).over(own))
    per = m.groupBy("session_id").agg(
        F.max(F.when(shown, F.struct("seq", "role"))).alias("last"), F.max(F.when(F.col("role") == "assistant", F.struct("seq", "compressed"))).alias("spoke"), F.max("user_seq").alias("user_seq"),
        F.count(F.when(shown & (F.col("seq") > F.col("user_seq")), 1)).alias("since"),
    )
    per = per.join(current_tokens(messages), "session_id").join(current_model(messages), "session_id", "left")
    top, low = session_limit(most, most_by_model or {}, model_limit), session_limit(least, least_by_model or {}, model_limit)
    over, enough = F.coalesce(F.col("current_tokens") > top, F.lit(False)), F.coalesce(F.col("current_tokens") >= low, F.lit(True))
    decision = F.when(F.lit(denied or manual), "off").when(F.col("spoke.compressed"), "compressed").when(over, "over").when(enough, "between").otherwise("below")
    per = per.withColumn("decision", decision)
    if anchors is None:
        per = per.withColumns({"context_at": F.lit(None).cast("long"), "iteration_at": F.lit(None).cast("long")})
    else:
        at = anchors.groupBy("session_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("seq"))).alias(f"{k}_at") for k in ("context", "iteration")])
        per = per.join(at, "session_id", "left")
    free = lambda kind: F.col(f"{kind}_at").isNull() | (F.col("last.seq") - F.col(f"{kind}_at") >= max(1, frequency))
    between = F.col("decision") == "between"
    late = between & (F.col("last.seq") > F.col("user_seq")) & (F.col("since") >= max(1, threshold))
    turn = between & (F.col("last.role") == "user") & F.col("spoke").isNotNull()
    return per.select(
        "session_id", "decision", F.when((F.col("decision") == "over") & free("context"), F.col("last.seq")).alias("context_seq"), F.when(late & free("iteration"), F.col("last.seq")).alias("iteration_seq"),
        F.when(turn, F.col("last.seq")).alias("turn_user_seq"), F.when(turn, F.col("spoke.seq")).alias("turn_assistant_seq"),
    )


def merged_anchors(kept: DataFrame, found: DataFrame) -> DataFrame:
    """SET-7: anchors that were kept and those worked out anew, each once."""
    return kept.unionByName(found).distinct()


def text_part(text: Column) -> Column:
    """A part that holds text alone."""
    values = {f: F.lit(None) for f in PART_FIELDS} | {"part_seq": F.lit(-1), "type": F.lit("text"), "text": text, "ignored": F.lit(False)}
    return F.struct(*[values[f].alias(f) for f in PART_FIELDS]).cast(PART)


def put_text(text: Column) -> Column:
    """Where text goes: after a user's parts, before the first tool part of an assistant's (at the end without one)."""
    kinds = F.transform("parts", lambda p: p["type"])
    tool = F.array_position(kinds, "tool")
    before = F.when((F.col("role") == "assistant") & (tool > 0), tool.cast("int") - 1).otherwise(F.size("parts"))
    return F.concat(F.slice("parts", F.lit(1), before), F.array(text_part(text)), F.slice("parts", before + 1, F.greatest(F.lit(0), F.size("parts") - before)))


def with_guidance(hint: str, guidance: str, close_tag: str) -> str:
    """NDG-6: guidance before a hint's last closing tag; a hint without one stays."""
    at = hint.rfind(close_tag)
    return hint if at < 0 else f"{hint[:at].rstrip()}\n\n{guidance}\n{hint[at:]}"


def apply_nudges(messages: DataFrame, anchors: DataFrame, texts: dict[str, str | Column], force: str = "soft") -> DataFrame:
    """NDG-4: the text of each kind at its anchors (session_id, seq, kind): context, then turn, then iteration.

    Turn nudges stand only with users (strong) or with assistants (soft).  Texts
    may read further columns of anchors, which are equal within a message.
    """
    more = [c for c in anchors.columns if c not in ("session_id", "seq", "kind")]
    kinds = anchors.groupBy("session_id", "seq").agg(F.collect_set("kind").alias("kinds"), *[F.first(c).alias(c) for c in more])
    m = messages.join(kinds, ["session_id", "seq"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    said = F.col("role") == ("user" if force == "strong" else "assistant")
    for kind in ("context", "turn", "iteration"):
        hit = F.array_contains("kinds", kind) & F.col("role").isin("user", "assistant")
        hit = hit & said if kind == "turn" else hit
        m = m.withColumn("parts", F.when(hit, put_text(texts[kind] if isinstance(texts[kind], Column) else F.lit(texts[kind]))).otherwise(F.col("parts")))
    return m.drop("kinds", *more)


def tag_messages(messages: DataFrame, refs: DataFrame, id_tag: str) -> DataFrame:
    """NDG-7, NDG-8: a message's reference as a tag.

    A user's is a text part at the end.  An assistant's stands at the end of the
    output of its last tool part, once, if that call completed; else it is a
    text part before the first tool part.  Ignored users get none.
    """
    tag = F.concat(F.lit(f"<{id_tag}>"), F.col("ref"), F.lit(f"</{id_tag}>"))
    m = messages.join(refs.select("session_id", "seq", "ref"), ["session_id", "seq"], "left")
    place = F.aggregate(F.sequence(F.lit(0), F.size("parts")), F.lit(-1), lambda a, i: F.when(F.get("parts", i)["type"] == "tool", i).otherwise(a))
    m = m.withColumn("_at", place).withColumn("_tool", F.get("parts", F.col("_at")))
    fits = (F.col("role") == "assistant") & (F.col("_tool.status") == "completed") & F.col("_tool.output").isNotNull()
    on_output = F.transform("parts", lambda p, i: F.when((i == F.col("_at")) & ~F.contains(p["output"], tag), p.withField("output", F.concat(p["output"], tag))).otherwise(p))
    known = F.col("ref").isNotNull() & ~ignored_user() & F.col("role").isin("user", "assistant")
    return m.withColumn("parts", F.when(known & fits, on_output).when(known, put_text(tag)).otherwise(F.col("parts"))).drop("_at", "_tool", "ref")


def toggled(manual: bool, argument: str | None = None) -> bool:
    """NDG-10: manual mode after a command: on, off, or the other one."""
    return {"on": True, "off": False}.get(argument or "", not manual)


def trigger_prompt(base: str, guidance: str, focus: str | None = None, focus_title: str = "Focus:") -> str:
    """NDG-10: the text of a manual trigger, with the user's focus if there is one."""
    return "\n\n".join([base, guidance, *([f"{focus_title}\n{focus.strip()}"] if focus and focus.strip() else [])])


def apply_prompt(messages: DataFrame, prompts: DataFrame) -> DataFrame:
    """NDG-11: a pending prompt (session_id, prompt) in place of the first shown text of the last real user message that has one."""
    shown = lambda p: (p["type"] == "text") & ~F.coalesce(p["ignored"], F.lit(False))
    can = (F.col("role") == "user") & ~ignored_user() & F.exists("parts", shown)
    last = messages.filter(can).groupBy("session_id").agg(F.max("seq").alias("seq")).join(prompts, "session_id")
    m = messages.join(last, ["session_id", "seq"], "left")
    first = F.array_position(F.transform("parts", shown), True).cast("int") - 1
    new = F.transform("parts", lambda p, i: F.when(i == first, p.withField("text", F.col("prompt"))).otherwise(p))
    return m.withColumn("parts", F.when(F.col("prompt").isNotNull(), new).otherwise(F.col("parts"))).drop("prompt")


def system_prompt(base: str, overlays: list[str]) -> str:
    """NDG-14, STR-9: the base text without comments, its overlays after it, and single blank lines between paragraphs."""
    import re

    bare = re.sub(r"(?m)^[ \t]*//.*(?:\n|$)", "", base.removeprefix("﻿").replace("\r\n", "\n")).strip()
    whole = "\n\n".join([bare, *(o.strip() for o in overlays if o.strip())])
    return re.sub(r"\n([ \t]*\n)+", "\n\n", whole).strip()


def gets_prompt(system_text: str, internal_marks: tuple[str, ...], permission: str, subagent: bool = False, allow_subagents: bool = False) -> bool:
    """NDG-16: whether a request's system text is extended: not for child sessions unless allowed, not for internal agents, not where denied."""
    return not (subagent and not allow_subagents) and not any(mark in system_text for mark in internal_marks) and permission != "deny"
