"""A request's context against a plain loop over random sessions, one step after the other."""

import copy
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import parts as pt
from quillon.operators.config import load
from quillon.plans import context as cx
from quillon.sources.history import PART, PART_FIELDS

TOKENS = "struct<input:bigint,output:bigint,reasoning:bigint,cache_read:bigint,cache_write:bigint>"
MESSAGE = f"session_id long, seq long, message_id long, role string, created long, completed long, summary boolean, agent string, provider string, model string, variant string, tokens {TOKENS}, parts array<{PART}>"
COLUMNS = [x.split()[0] for x in MESSAGE.split(", ")[:11]] + ["tokens", "parts"]
BLOCK = "session_id long, block_id long, created long, anchor_message_id string, compress_message_id string, consumed array<long>, deactivated_by_user boolean, effective_messages array<string>, summary string"
WORDING = cx.Wording()


def part(kind, **more):
    return {f: None for f in PART_FIELDS} | {"type": kind, "ignored": False} | more


def sessions(seed, n=40):
    """Messages, blocks, anchors, pruned calls by session."""
    rng = random.Random(seed)
    messages, blocks, anchors, pruned = {}, {}, {}, {}
    for s in range(1, n + 1):
        rows = []
        for seq in range(1, rng.randint(2, 18)):
            role, parts = rng.choice(["user", "assistant", "assistant"]), []
            if role == "user":
                for _ in range(rng.randint(0, 2)):
                    parts.append(part("text", text=rng.choice(["ask", "ask <note>x</note>more"]) + str(seq), ignored=rng.random() < 0.3))
            else:
                parts.append(part("step-start"))
                for k in range(rng.randint(0, 2)):
                    tool, status = rng.choice(["read", "edit", "question", "compress", "task"]), rng.choice(["completed", "completed", "error"])
                    given = {"read": '{"a":"x","n":1}', "edit": '{"filePath":"f"}', "question": '{"questions":[1]}'}.get(tool, '{"a":"b"}')
                    out = f"out {seq}{k}<note>y</note>" + ("<task_result>old</task_result>" if tool == "task" else "")
                    child = json.dumps({"sessionId": str(rng.randint(1, n))}) if tool == "task" and rng.random() < 0.7 else '{"x":1}'
                    parts.append(part("tool", tool=tool, call_id=f"c{seq}{k}", status=status, input=given, output=out if status == "completed" else None, error="bad" if status == "error" else None, metadata=child))
                if rng.random() < 0.4:
                    parts.append(part("text", text=f"said {seq}"))
            for i, p in enumerate(parts):
                p["part_seq"] = i
            rows.append({
                "session_id": s, "seq": seq, "message_id": 100 * s + seq, "role": role, "created": 10 * seq + rng.choice([0, 0, 15]), "completed": None, "summary": role == "assistant" and rng.random() < 0.06, "agent": f"a{seq % 2}",
                "provider": "p", "model": f"m{rng.randint(0, 1)}", "variant": rng.choice([None, "v"]), "tokens": None if role == "user" else (rng.randint(0, 90), rng.randint(0, 2), 0, 5, 0), "parts": parts,
            })
        messages[s] = rows
        ids = [str(r["message_id"]) for r in rows]
        blocks[s] = []
        for b in range(1, rng.randint(1, 5)):
            a = rng.randrange(len(ids)) if ids else 0
            if ids:
                own = ids[a : a + rng.randint(1, 4)]
                blocks[s].append({"block_id": b, "created": rng.randint(1, 9), "anchor_message_id": own[0], "compress_message_id": rng.choice([*ids, "gone"]), "consumed": [c for c in range(1, b) if rng.random() < 0.3], "deactivated_by_user": rng.random() < 0.2, "effective_messages": own, "summary": rng.choice(["", f"sum {b}", f"sum {b}"])})
        anchors[s] = {kind: {r["message_id"] for r in rows if rng.random() < 0.15} for kind in ("context", "turn", "iteration")}
        pruned[s] = {p["call_id"] for r in rows for p in r["parts"] if p["type"] == "tool" and rng.random() < 0.4}
    return messages, blocks, anchors, pruned


def ignored(m):
    return m["role"] == "user" and all(p["ignored"] for p in m["parts"])


def last_user(rows):
    return next((m for m in reversed(rows) if m["role"] == "user" and not ignored(m)), None)


def compressed(m):
    return any(p["type"] == "tool" and p["tool"] == "compress" and p["status"] == "completed" for p in m["parts"])


def result_of(rows):
    """The text that a child session gives back."""
    text = lambda m: next((p["text"].strip() for p in reversed(m["parts"]) if p["type"] == "text" and p["text"].strip()), "")
    spoke = [m for m in rows if m["role"] == "assistant"]
    out = [text(spoke[-2])] if len(spoke) > 1 and compressed(spoke[-2]) else []
    out += [text(spoke[-1])] if spoke else []
    return "\n\n".join(x for x in out if x)


def insert(m, text):
    new = part("text", text=text, part_seq=-1)
    at = next((i for i, p in enumerate(m["parts"]) if p["type"] == "tool"), len(m["parts"]))
    m["parts"].insert(len(m["parts"]) if m["role"] == "user" else at, new)


def request(s, every, blocks, anchors, pruned, config, limit, children, prompts):
    """One session's context."""
    rows = copy.deepcopy(every[s])
    child = s in children
    if child and not config.allow_subagents:
        return rows
    for m in rows:
        for p in m["parts"]:
            for f in ("text", "output"):
                if p[f] and (f == "text" or p["status"] == "completed"):
                    p[f] = p[f].replace("<note>x</note>", "").replace("<note>y</note>", "")
    refs, skipped = {}, False
    for m in rows:
        if ignored(m):
            continue
        if child and not skipped and m["role"] == "user":
            skipped = True
            continue
        refs[m["message_id"]] = f"m{len(refs) + 1:04}"
    ids = {str(m["message_id"]) for m in rows}
    active, owner, by = set(), {}, {b["block_id"]: b for b in blocks}
    for b in sorted(blocks, key=lambda b: (b["created"], b["block_id"])):
        if b["compress_message_id"] not in ids or b["deactivated_by_user"]:
            continue
        for c in b["consumed"]:
            active.discard(c)
            if c in by and owner.get(by[c]["anchor_message_id"]) == c:
                del owner[by[c]["anchor_message_id"]]
        active.add(b["block_id"])
        owner[b["anchor_message_id"]] = b["block_id"]
    covered = {x for n in active for x in by[n]["effective_messages"]}
    summaries = [m for m in rows if m["role"] == "assistant" and m["summary"]]
    cut = summaries[-1]["created"] if summaries else 0
    out = []
    for i, m in enumerate(rows):
        b = by.get(owner.get(str(m["message_id"])))
        user = last_user(rows[: i + 1])
        if b and b["summary"] and user:
            seed = hashlib.sha256(f"{b['block_id']}:{m['message_id']}".encode()).hexdigest()[:16]
            out.append({c: None for c in COLUMNS} | {c: user[c] for c in ("session_id", "agent", "provider", "model", "variant")} | {"message_id": f"summary_{seed}", "role": "user", "summary": False, "created": max(r["created"] for r in rows), "parts": [part("text", text=b["summary"], part_seq=0)]})
        if str(m["message_id"]) not in covered:
            out.append(m)
    for m in out:
        if m["created"] < cut:
            continue
        for p in m["parts"]:
            if p["type"] == "tool" and p["call_id"] in pruned:
                if p["status"] == "completed" and p["tool"] not in ("question", "edit", "write"):
                    p["output"] = pt.OUTPUT_GONE
                if p["status"] == "completed" and p["tool"] == "question":
                    p["input"] = json.dumps({"questions": pt.QUESTIONS_GONE}, separators=(",", ":"))
                if p["status"] == "error":
                    p["input"] = json.dumps({k: pt.INPUT_GONE if isinstance(v, str) else v for k, v in json.loads(p["input"]).items()}, separators=(",", ":"))
    for m in out:
        for p in m["parts"]:
            if config.allow_subagents and p["type"] == "tool" and p["tool"] == "task" and p["status"] == "completed" and p["call_id"] not in pruned:
                result = result_of(every.get(int(json.loads(p["metadata"]).get("sessionId") or 0), []))
                if result:
                    p["output"] = p["output"].replace("<task_result>old</task_result>", f"<task_result>{result}</task_result>").replace("<note>x</note>", "").replace("<note>y</note>", "")
    c = config.compress
    if c.permission != "deny":
        if not config.manual:
            nudge(out, {k: set(v) for k, v in anchors.items()}, active, c, limit)
        for m in out:
            ref = refs.get(m["message_id"])
            if ref is None or ignored(m):
                continue
            tag = f"<mid>{ref}</mid>"
            tools = [p for p in m["parts"] if p["type"] == "tool"]
            if m["role"] == "assistant" and tools and tools[-1]["status"] == "completed":
                tools[-1]["output"] += tag
            else:
                insert(m, tag)
    if s in prompts:
        for m in reversed(out):
            shown = [p for p in m["parts"] if p["type"] == "text" and not p["ignored"]]
            if m["role"] == "user" and not ignored(m) and shown:
                shown[0]["text"] = prompts[s]
                break
    user = last_user(out)
    for m in out:
        if user and m["role"] == "assistant" and (m["provider"], m["model"]) != (user["provider"], user["model"]):
            for p in m["parts"]:
                if p["type"] in ("text", "tool", "reasoning"):
                    p["metadata"] = None
    return out


def nudge(out, anchors, active, c, limit):
    shown = [(i, m) for i, m in enumerate(out) if not ignored(m)]
    spoke = [m for m in out if m["role"] == "assistant"]
    if spoke and compressed(spoke[-1]):
        return
    tokens = next((sum(m["tokens"]) for m in reversed(out) if m["role"] == "assistant" and m["tokens"] and m["tokens"][1] > 0), 0)
    bound = lambda x: int(max(0, min(100, int(float(x[:-1]) + 0.5))) / 100 * limit + 0.5) if isinstance(x, str) else x
    over, under = tokens > bound(c.max_context), tokens < bound(c.min_context)
    if under:
        anchors["turn"], anchors["iteration"] = set(), set()

    def add(kind, at):
        old = [i for i, m in enumerate(out) if m["message_id"] in anchors[kind]]
        if not old or at - old[-1] >= c.nudge_frequency:
            anchors[kind].add(out[at]["message_id"])

    if over and shown:
        add("context", shown[-1][0])
    elif not over and not under and shown:
        if shown[-1][1]["role"] == "user" and spoke:
            anchors["turn"] |= {shown[-1][1]["message_id"], spoke[-1]["message_id"]}
        users = [i for i, m in shown if m["role"] == "user"]
        if users and shown[-1][0] > users[-1] and sum(i > users[-1] for i, _ in shown) >= c.iteration_threshold:
            add("iteration", shown[-1][0])
    said = f"Blocks in force: {len(active)} ({', '.join(f'b{b}' for b in sorted(active)) or 'none'})"
    for kind, hint in WORDING.nudges.items():
        text = hint.replace("</note>", f"\n\n{said}\n</note>")
        for m in out:
            if m["message_id"] in anchors[kind] and (kind != "turn" or m["role"] == ("user" if c.nudge_force == "strong" else "assistant")):
                insert(m, text)


def plain(m):
    """What of a message is compared: all but the numbers of parts that were put in."""
    parts = [tuple(p[f] for f in ("type", "text", "ignored", "tool", "call_id", "status", "input", "output", "error", "metadata")) for p in m["parts"]]
    tokens = m["tokens"].values() if isinstance(m["tokens"], dict) else m["tokens"]
    return (str(m["message_id"]), m["role"], m["created"], m["summary"], m["agent"], m["provider"], m["model"], m["variant"], tuple(tokens) if tokens else None, parts)


CONFIGS = [
    {"compress": {"min_context": 20, "max_context": "60.6%", "nudge_frequency": 3, "iteration_threshold": 2}},
    {"compress": {"min_context": 40, "max_context": 70, "nudge_frequency": 0, "iteration_threshold": 1, "nudge_force": "strong"}, "allow_subagents": True},
    {"compress": {"permission": "deny"}, "allow_subagents": True},
    {"manual": True},
]


@pytest.mark.parametrize("number", range(len(CONFIGS)))
def test_context_against_a_loop(spark, number):
    config, limit = load(CONFIGS[number]), 100
    every, blocks, anchors, pruned = sessions(number + 3)
    children, prompts = {s for s in every if s % 5 == 0}, {s: f"do {s}" for s in every if s % 4 == 0}
    m = spark.createDataFrame([tuple(r[c] if c != "parts" else [tuple(p[f] for f in PART_FIELDS) for p in r["parts"]] for c in COLUMNS) for rows in every.values() for r in rows], MESSAGE)
    stored = spark.createDataFrame([(s, *(b[c.split()[0]] for c in BLOCK.split(", ")[1:])) for s, own in blocks.items() for b in own], BLOCK)
    covered, shown = cx.in_force(stored, m)
    gone = spark.createDataFrame([(s, c) for s, own in pruned.items() for c in own], "session_id long, call_id string")
    old = spark.createDataFrame([(s, i, k) for s, own in anchors.items() for k, ids in own.items() for i in ids], "session_id long, message_id long, kind string")
    # the active blocks are all that are in force, with or without a summary to show
    from quillon.operators import blocks as bk

    ids = m.select("session_id", F.col("message_id").cast("string").alias("compress_message_id"), F.lit(True).alias("origin_present"))
    active = bk.activity(stored.join(ids, ["session_id", "compress_message_id"], "left").na.fill(False, ["origin_present"])).filter("active")
    out = cx.build(m, config, gone, covered, F.lit(limit), m, old, summaries=shown, subagents=spark.createDataFrame([(s,) for s in children], "session_id long"), prompts=spark.createDataFrame(list(prompts.items()), "session_id long, prompt string"), active=active.select("session_id", "block_id"))
    got = {}
    for r in out.orderBy("session_id", "seq").collect():
        got.setdefault(r["session_id"], []).append(plain(r.asDict(True)))
    freq = config.compress
    model_config = load(CONFIGS[number], {"compress": {"nudge_frequency": max(1, freq.nudge_frequency), "iteration_threshold": max(1, freq.iteration_threshold)}})
    for s in every:
        want = [plain(m) for m in request(s, every, blocks[s], anchors[s], pruned[s], model_config, limit, children, prompts)]
        assert got.get(s, []) == want, s


def test_summaries_in_place(spark):
    """An anchor before any user, an inactive block, an empty summary, two blocks at one anchor, an anchor that is gone, a covered user."""
    rows = []
    for seq, role in enumerate(["assistant", "user", "assistant", "user", "assistant", "assistant"], 1):
        rows.append((1, seq, seq, role, seq, None, False, f"a{seq}", "p", f"m{seq}", f"v{seq}", None, [tuple(part("text", text=f"t{seq}", part_seq=0)[f] for f in PART_FIELDS)]))
    m = spark.createDataFrame(rows, MESSAGE)
    told = [(1, 1, 1, True, "no user yet"), (1, 3, 2, False, "not active"), (1, 4, 3, True, ""), (1, 5, 4, True, "first"), (1, 5, 5, True, "second"), (1, 2, 6, True, "at a user"), (1, 9, 7, True, "nowhere")]
    summaries = spark.createDataFrame(told, "session_id long, anchor_seq long, block_id long, active boolean, summary string")
    hidden = spark.createDataFrame([(1, 4), (1, 5)], "session_id long, message_id long")
    got = [(r["seq"], r["from_seq"], r["parts"][0]["text"], r["agent"], r["variant"]) for r in pt.in_place(m, hidden, summaries).orderBy("seq").collect()]
    assert got == [(1, 1, "t1", "a1", "v1"), (2, None, "at a user", "a2", "v2"), (3, 2, "t2", "a2", "v2"), (4, 3, "t3", "a3", "v3"), (5, None, "second", "a4", "v4"), (6, 6, "t6", "a6", "v6")]
    assert [r["seq"] for r in pt.in_place(m, hidden).orderBy("seq").collect()] == [1, 2, 3, 4]


def test_the_last_of_equal_calls_stays(spark):
    """Four equal calls of one message and one of an earlier message, whatever the order of rows."""
    from quillon.operators import strategies as st

    rows = [(1, 1, 0, "c0"), *[(1, 2, k, f"c{k}") for k in (1, 2, 3, 4)]]
    for some in (rows, rows[::-1]):
        calls = spark.createDataFrame([(*r, "read", "{}", 1) for r in some], "session_id long, seq long, part_seq int, call_id string, tool string, parameters string, token_count long").coalesce(1)
        assert sorted(r["call_id"] for r in st.deduplicate(calls).collect()) == ["c0", "c1", "c2", "c3"]
