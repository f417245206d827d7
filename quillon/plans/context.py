"""What a model is shown of a session: the whole way from stored messages to rewritten ones."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import blocks as bk
from quillon.operators import nudges as nd
from quillon.operators import parts as pt
from quillon.operators import rewrite as rw
from quillon.operators import strategies as st
from quillon.operators.config import Config, at_least_one
from quillon.operators.derive import message_refs
from quillon.operators.subagents import with_results
from quillon.sources.scratch import writer


@dataclass(frozen=True)
class Wording:
    """Texts and tags that are put into messages; all neutral, all parameters.

    guidance takes the number of active blocks and their names; it goes before a
    hint's last ``close_tag``, and hints without one stay as they are.
    """

    block_tag: str = "note"
    id_tag: str = "mid"
    close_tag: str = "</note>"
    guidance: str = "Blocks in force: %d (%s)"
    no_blocks: str = "none"
    nudges: dict[str, str] = field(default_factory=lambda: {"context": "<note>compress now</note>", "turn": "<note>compress soon</note>", "iteration": "[compress soon]"})


def decide(messages: DataFrame, config: Config, pruned: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """The calls that the strategies prune: duplicates and stale errors (session_id, call_id, token_count); calls in ``hidden`` messages are out of sight."""
    written = writer(messages.sparkSession, "decide")
    calls = written(pt.eligible(pt.tool_calls(pt.with_compaction(pt.told(messages), hidden)), config.protect_turns), "calls")
    runs = lambda s: config.enabled and st.may_run(s.enabled, config.manual, config.automatic_strategies)
    found = [calls.filter("false").select("session_id", "call_id", "token_count")]
    if runs(config.deduplicate):
        found.append(st.deduplicate(calls, list(config.deduplicate.protected_tools), list(config.protected_paths), pruned))
    if runs(config.purge_errors):
        purge = config.purge_errors
        old = st.purge_errors(calls, purge.turns, list(purge.protected_tools), list(config.protected_paths), pruned).select("session_id", "call_id")
        found.append(old.join(calls.select("session_id", "call_id", "token_count"), ["session_id", "call_id"]))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.groupBy("session_id", "call_id").agg(F.max("token_count").alias("token_count"))


def in_force(stored: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CMP-9: what saved blocks mean for the messages that are there now.

    stored: session_id, block_id, created, anchor_message_id,
    compress_message_id, consumed, deactivated_by_user, effective_messages and
    summary (see sources.states.blocks); ids of messages are strings.  A block
    counts only while the message that made it is there.  Returns the messages
    that active blocks cover (session_id, message_id), and the blocks that show
    a summary (session_id, anchor_seq, block_id, active, summary): at each
    anchor the latest block, if it is active.
    """
    named = messages.select("session_id", F.col("message_id").cast("string").alias("_id"), "message_id", "seq")
    origin = named.select("session_id", F.col("_id").alias("compress_message_id"), F.lit(True).alias("origin_present"))
    b = stored.join(origin, ["session_id", "compress_message_id"], "left").withColumn("origin_present", F.coalesce("origin_present", F.lit(False)))
    spots = named.select("session_id", F.col("_id").alias("anchor_message_id"), F.col("seq").alias("anchor_seq"))
    b = bk.activity(b.join(spots, ["session_id", "anchor_message_id"], "left"))
    covered = b.filter("active").select("session_id", F.explode("effective_messages").alias("_id")).distinct().join(named, ["session_id", "_id"]).select("session_id", "message_id")
    owners = bk.anchor_owners(b.filter("anchor_seq is not null")).select("session_id", "block_id")
    shown = b.join(owners, ["session_id", "block_id"]).select("session_id", "anchor_seq", "block_id", "active", "summary")
    return covered, shown


def hints(messages: DataFrame, active: DataFrame | None, wording: Wording) -> tuple[DataFrame, dict[str, Column]]:
    """NDG-5, NDG-6: messages (or their anchors) with ``_n`` and ``_names`` of their session's active blocks, and the hint of each kind with guidance."""
    none = F.lit(wording.no_blocks)
    if active is None:
        m = messages.withColumns({"_n": F.lit(0).cast("long"), "_names": none})
    else:
        names = F.concat_ws(", ", F.transform(F.sort_array(F.collect_set("block_id")), lambda b: F.concat(F.lit("b"), b.cast("string"))))
        per = active.groupBy("session_id").agg(F.countDistinct("block_id").alias("_n"), names.alias("_names"))
        m = messages.join(per, "session_id", "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_names": F.coalesce("_names", none)})
    said = F.format_string(wording.guidance, "_n", "_names")
    out = {}
    for kind, hint in wording.nudges.items():
        at = hint.rfind(wording.close_tag)
        out[kind] = F.lit(hint) if at < 0 else F.concat(F.lit(hint[:at].rstrip() + "\n\n"), said, F.lit("\n" + hint[at:]))
    return m, out


def _placed(anchors: DataFrame, m: DataFrame) -> DataFrame:
    """Stored anchors by message_id, or by stored seq, as session_id, seq, kind of the messages that are shown."""
    key = "message_id" if "message_id" in anchors.columns else "seq"
    spots = m.filter("from_seq is not null").select("session_id", F.col("message_id" if key == "message_id" else "from_seq").cast("string").alias("_key"), F.col("seq").alias("_seq"))
    named = anchors.select("session_id", F.col(key).cast("string").alias("_key"), "kind")
    return named.join(spots, ["session_id", "_key"]).select("session_id", F.col("_seq").alias("seq"), "kind")


def build(
    messages: DataFrame, config: Config, pruned: DataFrame, hidden: DataFrame, model_limit: Column | None = None, children: DataFrame | None = None, anchors: DataFrame | None = None, wording: Wording = Wording(),
    summaries: DataFrame | None = None, subagents: DataFrame | None = None, prompts: DataFrame | None = None, active: DataFrame | None = None,
) -> DataFrame:
    """Messages as a model sees them, with the columns of ``messages``; message_id is a string, and seq counts from 1.

    In order: injected tags leave; messages get their references; summaries come
    in place of covered messages, and pruned contents go; results of child
    sessions come in; nudges, with guidance on the active blocks, and references
    are put in place; a pending prompt takes the place of the last user's text;
    metadata of other models leave.

    pruned has session_id and call_id; hidden and summaries are those of
    in_force; anchors have session_id, kind and message_id (or the stored seq);
    subagents has the session_id of child sessions, prompts session_id and
    prompt, active session_id and block_id of the blocks in force (those of
    ``summaries`` by default).  Where compressing is denied nothing is put in;
    in manual mode no nudges are.  Child sessions come back as they are, unless
    the configuration allows them; then their first real user's message gets no
    reference.  Child results come in only where it allows them.

    What later steps read more than once is written in between (see
    sources.scratch), so no step is planned or run twice.
    """
    written = writer(messages.sparkSession, "context")
    whole = messages
    left = None
    flag = F.lit(False)
    if subagents is not None:
        flags = subagents.select("session_id").distinct().withColumn("_child", F.lit(True))
        whole = whole.join(flags, "session_id", "left").withColumn("_child", F.coalesce("_child", F.lit(False)))
        if not config.allow_subagents:
            left = whole.filter("_child").withColumn("message_id", F.col("message_id").cast("string")).select(*messages.columns)
            whole = whole.filter("not _child")
        flag = F.col("_child")
    refs = message_refs(whole.filter(~pt.ignored_user()), flag)
    whole = whole.select(*messages.columns)
    m = written(pt.prune(rw.scrub_parts(whole, wording.block_tag, wording.id_tag), pruned, hidden, summaries), "pruned")
    stored = m  # what is decided does not depend on the results of child sessions
    refs = refs.withColumnRenamed("seq", "from_seq").join(m.select("session_id", "from_seq", "seq"), ["session_id", "from_seq"]).select("session_id", "seq", "ref")
    if children is not None and config.allow_subagents:
        outputs = with_results(m, children, pruned, wording.block_tag, wording.id_tag)
        spots = m.select("session_id", "message_id", "seq")
        by = outputs.join(spots, ["session_id", "message_id"]).groupBy("session_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("call_id", "output"))).alias("_new"))
        new = F.transform("parts", lambda p: p.withField("output", F.coalesce(F.when(p["type"] == "tool", F.try_element_at("_new", p["call_id"])), p["output"])))
        # by session_id and seq, as nudges and references are joined, so that messages are moved once for all three
        m = m.join(by, ["session_id", "seq"], "left").withColumn("parts", F.when(F.col("_new").isNotNull(), new).otherwise(F.col("parts"))).drop("_new")
    c = config.compress
    if c.permission != "deny":
        if not config.manual:
            limit = F.lit(None).cast("long") if model_limit is None else model_limit
            old = None if anchors is None else _placed(anchors, stored)
            said = written(nd.decisions(stored, c.max_context, c.min_context, limit, c.model_max, c.model_min, at_least_one(c.iteration_threshold), at_least_one(c.nudge_frequency), old), "decided")
            places = {"context": ["context_seq"], "turn": ["turn_user_seq", "turn_assistant_seq"], "iteration": ["iteration_seq"]}
            put = [F.struct(F.lit(kind).alias("kind"), F.col(c_).alias("seq")) for kind, cols in places.items() for c_ in cols]
            new = said.select("session_id", F.explode(F.array(*put)).alias("a")).select("session_id", "a.seq", "a.kind").filter("seq is not null")
            if old is not None:
                kept = old.join(said.select("session_id", "decision"), "session_id", "left").filter("not (coalesce(decision, '') = 'compressed') and not (coalesce(decision, '') = 'below' and kind <> 'context')")
                new = nd.merged_anchors(kept.select("session_id", "seq", "kind"), new)
            in_use = active if active is not None or summaries is None else summaries.filter("active")
            new, texts = hints(new, in_use, wording)
            m = nd.apply_nudges(m, new, texts, c.nudge_force)
        m = nd.tag_messages(m, refs, wording.id_tag)
    if prompts is not None:
        m = written(m, "tagged")
    if prompts is not None:
        m = nd.apply_prompt(m, prompts)
    m = written(m, "filled")
    last = nd.current_model(m).select("session_id", F.concat_ws("/", "provider", "model").alias("_now"))
    stale = (F.col("role") == "assistant") & F.col("_now").isNotNull() & (F.concat_ws("/", "provider", "model") != F.col("_now"))
    bare = F.transform("parts", lambda p: F.when(p["type"].isin("text", "tool", "reasoning"), p.withField("metadata", F.lit(None).cast("string"))).otherwise(p))
    m = m.join(last, "session_id", "left").withColumn("parts", F.when(stale, bare).otherwise(F.col("parts"))).select(*messages.columns)
    return m if left is None else m.unionByName(left)
