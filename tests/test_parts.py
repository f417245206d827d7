"""Messages with parts: micro tables with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import compact as cp
from quillon.operators import labels as lb
from quillon.operators import nudges as nd
from quillon.operators import parts as pt
from quillon.operators import rewrite as rw
from quillon.operators import subagents as sa
from quillon.operators import usage as us
from quillon.sources import states
from quillon.sources import tables as tb
from quillon.sources.history import PART

MESSAGE = f"session_id long, seq long, message_id long, role string, created long, completed long, summary boolean, agent string, provider string, model string, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache_read:bigint,cache_write:bigint>, parts array<{PART}>"
FIELDS = ("part_seq", "type", "text", "ignored", "tool", "call_id", "status", "input", "output", "error", "metadata", "tokens", "cost", "reason")


def part(seq, kind, **more):
    return tuple(({"part_seq": seq, "type": kind, "ignored": False} | more).get(f) for f in FIELDS)


def tool(seq, name, call="c", status="completed", given="{}", output=None, error=None, metadata=None):
    return part(seq, "tool", tool=name, call_id=call, status=status, input=given, output=output, error=error, metadata=metadata)


def message(seq, role, *parts, session=1, created=None, summary=False, tokens=None, model="m"):
    return (session, seq, 100 * session + seq, role, seq if created is None else created, None, summary, "a", "p", model, tokens, list(parts))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), MESSAGE)


def text(seq, words, ignored=False):
    return part(seq, "text", text=words, ignored=ignored)


LABELS = [
    ("read", '{"filePath":"a"}', "a"), ("read", '{"filePath":"a","offset":3,"limit":5}', "a (lines 3-8)"), ("read", '{"filePath":"a","offset":3}', "a (lines 3+)"), ("read", '{"filePath":"a","limit":5}', "a (lines 0-5)"),
    ("read", '{"x":1}', '{"x":1}'), ("edit", '{"filePath":"b"}', "b"), ("multiedit", '{"filePath":"b"}', "b"),
    ("apply_patch", '{"patchText":"*** Add File: x\\n*** Update File: y\\n*** Add File: x"}', "x, y"), ("apply_patch", '{"patchText":"*** Add File: x\\n*** Add File: y\\n*** Delete File: z"}', "3 files: x, y..."), ("apply_patch", '{"patchText":"none"}', "patch"),
    ("list", "{}", "(current directory)"), ("list", '{"path":"src"}', "src"), ("glob", '{"pattern":"*.py","path":"src"}', '"*.py" in src'), ("grep", '{"pattern":"x"}', '"x"'), ("grep", '{"p":1}', "(unknown pattern)"),
    ("bash", '{"command":"ls","description":"list"}', "list"), ("bash", json.dumps({"command": "x" * 51}), "x" * 50 + "..."), ("bash", '{"command":"ls"}', "ls"), ("webfetch", '{"url":"u"}', "u"), ("websearch", '{"query":"q"}', '"q"'), ("codesearch", '{"query":"q"}', '"q"'),
    ("todowrite", '{"todos":[1,2]}', "2 todos"), ("todowrite", '{"a":1}', "0 todos"), ("todoread", '{"a":1}', "read todo list"), ("task", '{"description":"d"}', "d"), ("skill", '{"name":"n"}', "n"),
    ("lsp", '{"operation":"def","filePath":"f","line":1,"character":2}', "def f:1:2"), ("lsp", '{"filePath":"f"}', "lsp f"), ("lsp", '{"x":1}', "lsp"),
    ("question", '{"questions":[{"header":"A"},{"header":""},{"header":"B"},{"header":"C"},{"header":"D"}]}', "5 questions: A, B, C (+2 more)"), ("question", '{"questions":[{"q":1}]}', "1 question"), ("question", '{"x":1}', "question"),
    ("other", '{"k":1}', '{"k":1}'), ("other", "{}", ""), ("other", None, ""), ("other", "[]", ""), ("other", json.dumps({"k": "y" * 80}), json.dumps({"k": "y" * 80})[:50]),
]


def test_labels(spark):
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(LABELS)], "i int, tool string, p string")
    got = {r["i"]: r["label"] for r in rows.select("i", lb.parameter_label(F.col("tool"), F.col("p")).alias("label")).collect()}
    assert {LABELS[i][:2]: x for i, x in got.items()} == {x[:2]: x[2] for x in LABELS}
    paths = [("/w/a/b", "a/b"), ("/w", "."), ("/wide/a", "/wide/a"), ('"*.py" in /w/src', '"*.py" in src'), ("x in y in /w", "x in y in ."), ("", "")]
    short = spark.createDataFrame(paths, "a string, b string").select("b", lb.shorten_path(F.col("a"), "/w").alias("c")).collect()
    assert all(r["b"] == r["c"] for r in short)


def test_lists_and_bars(spark):
    calls = spark.createDataFrame([(1, "c1", "read", '{"filePath":"/w/a"}'), (1, "c2", "x", "{}")], "session_id long, call_id string, tool string, parameters string")
    ids = spark.createDataFrame([(1, 0, "c2"), (1, 1, "gone"), (1, 2, "c1"), (1, 3, "lost")], "session_id long, pos long, call_id string")
    assert lb.pruned_items(ids, calls, "/w").first()["lines"] == ["→ x", "→ read: a", "→ (2 tools with unknown metadata)"]
    m = spark.createDataFrame([(1, i, i) for i in range(3)], "session_id long, seq long, message_id long")
    out = lb.progress_bars(m, m.filter("seq in (0, 2)"), m.filter("seq = 2"), 10).first()["bar"]
    assert out == "│" + lb.PRUNED * 3 + lb.ACTIVE * 3 + lb.RECENT * 4 + "│"
    n = spark.createDataFrame([(1, 8), (3, 0)], "a long, b long").select(lb.percent(F.col("a"), F.col("b")))
    assert [r[0] for r in n.collect()] == [13, 0]
    body = "\n".join(str(i) for i in range(14))
    t = spark.createDataFrame([(body, "head##" + "x" * 700, "short##x")], "a string, b string, c string")
    r = t.select(lb.first_lines(F.col("a")).alias("a"), lb.short_section(F.col("b"), "##").alias("b"), lb.short_section(F.col("c"), "##").alias("c")).first()
    assert r["a"].split("\n")[-2:] == ["10", "... and 3 more"] and len(r["b"]) == 604 and r["b"].endswith("...") and r["c"] == "short##x"


def test_tool_contents(spark):
    calls = [
        tool(0, "question", given='{"questions":[{"q":1}]}', output="long answer"), tool(1, "question", given="{}"), tool(2, "edit", given='{"a":1}', output="done"), tool(3, "write", status="error", given="", error="no"),
        tool(4, "bash", output="x" * 9, given="never counted"), tool(5, "bash", status="running", output="x"), tool(6, "bash", status="error", error="e" * 5), tool(7, "bash", output="😀"),
    ]
    rows = frame(spark, message(1, "assistant", *calls)).select(F.explode("parts").alias("p")).select("p.part_seq", pt.tool_contents(F.col("p")).alias("t"), pt.tool_tokens(F.col("p")).alias("n")).collect()
    assert {r["part_seq"]: (r["t"], r["n"]) for r in rows} == {0: (['[{"q":1}]'], 2), 1: ([], 0), 2: (['{"a":1}', "done"], 3), 3: (["no"], 1), 4: (["x" * 9], 2), 5: ([], 0), 6: (["eeeee"], 1), 7: (["😀"], 1)}
    m = frame(spark, message(1, "assistant", text(0, "ab"), part(1, "reasoning", text="zzzzzzzz"), *[tool(2, "bash", output="cdef")], text(3, "g")))
    assert m.select(pt.message_tokens()).first()[0] == 2  # "ab cdef g"


def test_pruning_keeps_types(spark):
    rows = [
        message(1, "assistant", tool(0, "bash", "c1", "error", '{"a":"x","n":5,"d":{"y":"z"},"l":["s"],"b":true,"e":null}', error="bad")),
        message(2, "assistant", tool(0, "question", "c2", given='{"questions":[{"q":1}],"k":"v"}', output="yes"), tool(1, "read", "c3", output="file"), tool(2, "edit", "c4", output="ok")),
        message(3, "assistant", tool(0, "read", "c5", "running", output="part"), tool(1, "read", "c6", output="kept"), tool(2, "bash", "c7", "error", "not json", error="bad")),
    ]
    gone = spark.createDataFrame([(1, f"c{i}") for i in (1, 2, 3, 4, 5, 7)] + [(2, "c6")], "session_id long, call_id string")
    m = pt.with_compaction(frame(spark, *rows))
    got = {r["call_id"]: (r["input"], r["output"]) for r in pt.prune_parts(m, gone).select(F.explode("parts").alias("p")).select("p.*").collect()}
    assert json.loads(got["c1"][0]) == {"a": pt.INPUT_GONE, "n": 5, "d": {"y": "z"}, "l": ["s"], "b": True, "e": None}
    assert json.loads(got["c2"][0]) == {"questions": pt.QUESTIONS_GONE, "k": "v"} and got["c2"][1] == "yes"
    assert [got[c][1] for c in ("c3", "c4", "c5", "c6")] == [pt.OUTPUT_GONE, "ok", "part", "kept"] and got["c7"][0] == "not json"
    left = pt.drop_full_tools(m, gone).collect()
    assert [[p["call_id"] for p in r["parts"]] for r in sorted(left, key=lambda r: r["seq"])] == [["c1"], ["c2", "c3"], ["c5", "c6", "c7"]]


def test_compaction_cut_is_positional(spark):
    """The last summary by place counts, with its own time; covered messages count as compacted too."""
    rows = [message(1, "user", text(0, "a"), created=5), message(2, "assistant", created=50, summary=True), message(3, "assistant", created=20, summary=True), message(4, "user", text(0, "b"), created=19), message(5, "user", created=20)]
    m = frame(spark, *rows)
    out = pt.with_compaction(m, m.filter("seq = 5").select("session_id", "message_id"))
    assert {r["seq"]: (r["last_compaction"], r["compacted"]) for r in out.collect()} == {1: (20, True), 2: (20, False), 3: (20, False), 4: (20, True), 5: (20, True)}
    made = spark.createDataFrame([(1, 19), (1, 20), (9, 0)], "session_id long, made long")
    assert sorted(map(tuple, pt.reset_on_compaction(made, m).collect())) == [(1, 20), (9, 0)]


def test_steps_and_impact(spark):
    t = lambda i, r: (i, 1, 0, r, 0)
    fin = lambda s, i, r, **k: part(s, "step-finish", tokens=t(i, r), cost=1.0, **k)
    m = frame(
        spark, message(1, "assistant", fin(0, 10, 0), tool(1, "compress"), fin(2, 20, 0, reason="stop")), message(2, "assistant", tool(0, "bash"), fin(1, 5, 15)), message(3, "assistant", tool(0, "compress"), tool(1, "compress"), fin(2, 0, 10)),
        message(4, "assistant", tool(0, "x")), message(5, "assistant", fin(0, 30, 10)), message(6, "assistant", tool(0, "compress"), fin(1, 1, 1)), message(7, "user", text(0, "hi")),
    )
    every = us.by_session(us.steps(m)).first()
    assert (every["input"], every["steps"], every["stop"], every["other"], every["cost"]) == (66, 6, 1, 5, 6)
    impact = us.impact_by_tool(us.steps(m, "first"), ["compress"]).first()
    assert (impact["calls"], impact["hit_before"], impact["hit_after"]) == (3, round((0 + 100 + 100) / 3, 6), round((75 + 25 + 25) / 3, 6))
    assert (impact["context_before"], impact["context_after"]) == (10.0, round((20 + 40 + 40) / 3, 6))
    assert [(r["distance"], r["n"], r["mean"]) for r in us.recovery(us.steps(m, "first"), ["compress"]).collect()] == [(0, 2, 50.0), (1, 2, 75.0)]
    line = {r["seq"]: r for r in us.timeline(us.steps(m, "last")).collect()}
    assert (line[1]["input_delta"], line[2]["input_delta"], line[2]["cache_read_delta"]) == (20, -15, 15)
    assert us.screening(m, ["compress"], 1).first().asDict() == {"scanned": 1, "skipped": 0, "analysed": 1, "with_calls": 1, "calls": 3, "steps": 5}


def test_subagent_results(spark):
    child = [message(1, "assistant", text(0, " early "), tool(1, "compress", status="completed"), session=7), message(2, "assistant", text(0, "x"), text(1, " last "), text(2, "  "), session=7), message(3, "user", text(0, "u"), session=7)]
    plain = [message(1, "assistant", text(0, "one"), session=8), message(2, "assistant", text(0, "two"), session=8)]
    silent = [message(1, "assistant", tool(0, "bash"), session=9)]
    children = frame(spark, *child, *plain, *silent)
    assert {r["session_id"]: r["result"] for r in sa.result_texts(children).collect()} == {7: "early\n\nlast", 8: "two", 9: ""}
    out = "a <TASK_RESULT>\nold $1\n</task_result> <task_result>b</task_result>"
    meta = lambda s: json.dumps({"sessionId": s})
    parent = frame(spark, message(1, "assistant", tool(0, "task", "c1", output=out, metadata=meta(" 7 ")), tool(1, "task", "c2", output=out, metadata=meta("8")), tool(2, "task", "c3", output=out, metadata=meta(" ")), tool(3, "task", "c4", output="no block", metadata=meta("8")), tool(4, "task", "c5", output=out, metadata=meta("9"))))
    gone = spark.createDataFrame([(1, "c2")], "session_id long, call_id string")
    got = {r["call_id"]: r["output"] for r in sa.with_results(parent, children, gone, "note", "mid").collect()}
    assert got == {"c1": "a <TASK_RESULT>\nearly\n\nlast\n</task_result> <task_result>b</task_result>", "c4": "no block"}


def test_nudges(spark):
    spent = (100, 5, 0, 0, 0)
    rows = [
        message(1, "user", text(0, "a"), session=1), message(2, "assistant", tool(0, "bash"), tokens=spent, session=1), message(3, "user", text(0, "b"), session=1),
        message(1, "user", text(0, "a"), session=2), message(2, "assistant", tool(0, "compress"), tokens=spent, session=2),
        message(1, "user", text(0, "a"), session=3), message(2, "assistant", tokens=(500, 5, 0, 0, 0), session=3), message(3, "user", text(0, "x", True), session=3),
        message(1, "user", text(0, "a"), session=4), *[message(s, "assistant", tokens=spent, session=4) for s in range(2, 6)],
        message(1, "assistant", tokens=(1, 1, 0, 0, 0), session=5),
    ]
    m = frame(spark, *rows)
    run = lambda **k: {r["session_id"]: tuple(r)[1:] for r in nd.decisions(m, 300, 50, F.lit(None).cast("long"), threshold=4, frequency=2, **k).collect()}
    assert run() == {1: ("between", None, None, 3, 2), 2: ("compressed", None, None, None, None), 3: ("over", 2, None, None, None), 4: ("between", None, 5, None, None), 5: ("below", None, None, None, None)}
    near = spark.createDataFrame([(3, "context", 1), (4, "iteration", 4)], "session_id long, kind string, seq long")
    assert run(anchors=near)[3][1] is None and run(anchors=near)[4][2] is None
    far = spark.createDataFrame([(3, "context", 0), (4, "iteration", 3)], "session_id long, kind string, seq long")
    assert run(anchors=far)[3][1] == 2 and run(anchors=far)[4][2] == 5
    assert {x[0] for x in run(denied=True).values()} == {"off"} and {x[0] for x in run(manual=True).values()} == {"off"}
    at = spark.createDataFrame([(1, 2, "context"), (1, 2, "turn"), (1, 3, "turn"), (1, 3, "iteration")], "session_id long, seq long, kind string")
    texts = {"context": "C", "turn": "T", "iteration": "I"}
    shown = lambda f: {r["seq"]: [p["text"] or p["tool"] for p in r["parts"]] for r in nd.apply_nudges(m.filter("session_id = 1"), at, texts, f).collect()}
    assert shown("soft") == {1: ["a"], 2: ["C", "T", "bash"], 3: ["b", "I"]} and shown("strong") == {1: ["a"], 2: ["C", "bash"], 3: ["b", "T", "I"]}
    assert nd.with_guidance("<r>hint \n</r>", "G", "</r>") == "<r>hint\n\nG\n</r>" and nd.with_guidance("hint", "G", "</r>") == "hint"
    assert [nd.toggled(False), nd.toggled(True), nd.toggled(False, "on"), nd.toggled(True, "off")] == [True, False, True, False]
    assert nd.trigger_prompt("a", "b", " c ") == "a\n\nb\n\nFocus:\nc" and nd.trigger_prompt("a", "b", " ") == "a\n\nb"
    assert nd.system_prompt("a\n// note\n\n \n\nb\r\n", ["c ", " "]) == "a\n\nb\n\nc"
    assert [nd.gets_prompt("s", ("x",), "allow"), nd.gets_prompt("ax", ("x",), "allow"), nd.gets_prompt("s", (), "deny"), nd.gets_prompt("s", (), "ask", True), nd.gets_prompt("s", (), "ask", True, True)] == [True, False, False, False, True]
    assert nd.merged_anchors(near, near.unionByName(far)).count() == 4


def test_tags(spark):
    refs = spark.createDataFrame([(1, s, f"m{s:04d}") for s in range(1, 7)], "session_id long, seq long, ref string")
    tag = "<id>m{:04d}</id>".format
    rows = [
        message(1, "user", text(0, "a")), message(2, "assistant", tool(0, "x", output="o"), tool(1, "y", output="p")), message(3, "assistant", text(0, "t"), tool(1, "x", status="running")), message(4, "assistant", text(0, "t")),
        message(5, "user", text(0, "i", True)), message(6, "assistant", tool(0, "x", output="o" + tag(6))),
    ]
    out = {r["seq"]: [p["text"] or p["output"] or p["tool"] for p in r["parts"]] for r in nd.tag_messages(frame(spark, *rows), refs, "id").collect()}
    assert out == {1: ["a", tag(1)], 2: ["o", "p" + tag(2)], 3: ["t", tag(3), "x"], 4: ["t", tag(4)], 5: ["i"], 6: ["o" + tag(6)]}
    clean = rw.scrub_parts(frame(spark, message(1, "assistant", text(0, "a<n>x</n>"), tool(1, "x", output="o<id>m1</id>"), tool(2, "x", status="error", output="<n>s</n>"))), "n", "id").first()
    assert [p["text"] or p["output"] for p in clean["parts"]] == ["a", "o", "<n>s</n>"]
    small = rw.minimize(frame(spark, message(1, "user", text(0, "i", True)), message(2, "assistant", part(0, "step-start"), text(1, ""), tool(2, "x", output="o")))).collect()
    assert [(r["seq"], [p["type"] for p in r["parts"]]) for r in small] == [(2, ["tool"])]


def test_protected_outputs_and_user_texts(spark):
    m = frame(
        spark, message(1, "user", text(0, " "), text(1, "word for word")), message(2, "assistant", tool(0, "task", "c1", output="big", metadata="{}"), tool(1, "read", "c2", given='{"filePath":"src/a.py"}', output="code"), tool(2, "bash", "c3", output="no")),
        message(3, "user", text(0, "hidden", True)), message(4, "assistant", text(0, "x"), tool(1, "task", "c4", "running", output="not yet")),
    )
    refs = spark.createDataFrame([(1, 1, "m0001"), (1, 2, "m0002"), (1, 4, "m0003")], "session_id long, seq long, ref string")
    known = spark.createDataFrame([(1, "c1", "whole result")], "session_id long, call_id string, output string")
    rows = cp.messages_with_parts(m, refs, ["task"], ["**/*.py"], known)
    cmds = spark.createDataFrame([(1, 1, "t", "m0001", "m0002", "short"), (1, 2, "t", "b1", "m0003", "all")], "session_id long, cmd long, topic string, start_id string, end_id string, summary string")
    out = {r["block_id"]: r for r in cp.compact(cmds, rows, keep_user_text=True).collect()}
    w = cp.Wording()
    assert cp.unwrap(out[1]["summary"]) == f"short\n\n{w.user_texts}\nword for word\n\n{w.tools}\n### Tool: task\nwhole result\n### Tool: read\ncode"
    assert out[1]["effective_tools"] == ["c1", "c2", "c3"] and list(out[2]["effective_seqs"]) == [1, 2, 4] and list(out[2]["direct_seqs"]) == [4] and out[2]["direct_tools"] == ["c4"]
    assert cp.unwrap(out[2]["summary"]) == cp.unwrap(out[1]["summary"]) + "\n\nall"


def test_saved_states(spark, tmp_path):
    block = {"active": True, "compressedTokens": -5, "consumedBlockIds": [2, 2, 0, -1], "directMessageIds": ["a", "a"], "anchorMessageId": "m"}
    good = {
        "sessionId": "a", "prune": {"tools": {"x": 3, "y": None}, "messages": {"byMessageId": {"m": {"tokenCount": 4, "allBlockIds": [1, 1, 0], "activeBlockIds": [1]}, "n": {}}, "blocksById": {"3": block, "0": block, "z": block}, "activeBlockIds": [], "nextBlockId": 2}},
        "nudges": {"turnNudgeAnchors": ["p", "p"], "contextLimitAnchors": ["q"], "iterationNudgeAnchors": []}, "stats": {"pruneTokenCounter": 0, "totalPruneTokens": 5}, "lastUpdated": "t",
    }
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"sessionId": "c", "prune": {"tools": {}}, "stats": {"totalPruneTokens": 0}}))
    (tmp_path / "d.json").write_text(json.dumps({"sessionId": "d", "stats": {"totalPruneTokens": 1}}))
    s = states.read(spark, str(tmp_path))
    assert sorted(r["sessionId"] for r in s.collect()) == ["a", "c"]
    assert states.statistics(s).first().asDict() == {"tokens": 5, "tools": 2, "messages": 2, "sessions": 1}
    assert [tuple(r) for r in states.pruned_tools(s).collect()] == [("a", "x", 3)]
    assert {r["message_id"]: (r["token_count"], r["all_blocks"], r["active_blocks"]) for r in states.pruned_messages(s).collect()} == {"m": (4, [1], [1]), "n": (0, [], [])}
    b = states.blocks(s).collect()
    assert [(r["block_id"], r["active"], r["compressed_tokens"], r["consumed"], r["direct_messages"], r["topic"]) for r in b] == [(3, True, 0, [2], ["a"], "")]
    assert {r["session_id"]: r["next_block"] for r in states.next_block(s).collect()} == {"a": 4, "c": 1}
    assert sorted(tuple(r) for r in states.anchors(s).collect()) == [("a", "context", "q"), ("a", "turn", "p")]
    states.write(s, str(tmp_path / "out"))
    again = states.read(spark, str(tmp_path / "out"))
    assert states.statistics(again).collect() == states.statistics(s).collect() and states.empty(spark).schema["prune"].dataType == s.schema["prune"].dataType


def test_stored_payloads(spark):
    data = json.dumps({"role": "assistant", "modelID": "m", "providerID": "p", "time": {"created": 5, "completed": 9}, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}})
    rows = [("x", "s", data, 10), ("w", "s", "{broken", 5), ("y", "s", None, 10)]
    m = {r["message_id"]: r for r in tb.stored_messages(spark.createDataFrame(rows, "id string, session_id string, data string, time_created long")).collect()}
    assert (m["x"]["seq"], m["x"]["created"], tuple(m["x"]["tokens"])) == (2, 5, (1, 2, 3, 4, 5)) and (m["w"]["seq"], m["w"]["role"], m["w"]["created"], m["y"]["seq"]) == (1, None, 5, 3)
    assert tb.stored_messages(spark.createDataFrame(rows, "id string, session_id string, data string, time_created long"), 1).count() == 1
    state = {"status": "completed", "input": {"filePath": "a", "n": 1}, "output": "o"}
    parts = [("2", "x", "s", json.dumps({"type": "tool", "tool": "read", "callID": "c", "state": state}), 2), ("1", "x", "s", json.dumps({"type": "text", "text": "t"}), 1), ("3", "x", "s", "nonsense", 3)]
    p = {r["type"]: r for r in tb.stored_parts(spark.createDataFrame(parts, "id string, message_id string, session_id string, data string, time_created long")).collect()}
    assert p.keys() == {"tool", "text"} and (p["text"]["part_seq"], p["tool"]["part_seq"], p["tool"]["output"]) == (0, 1, "o") and json.loads(p["tool"]["input"]) == state["input"]


def test_stream_turn_protection(spark, tmp_path):
    from quillon.streaming.sessions import stream_duplicates, stream_eligible

    schema = "session_id long, seq long, call_id long, tool string, parameters string, step_start boolean, compacted boolean"
    rows = [(1, 1, 10, "r", "{}", True, False), (1, 2, 11, "r", "{}", True, False), (1, 3, 12, "r", "{}", True, True), (1, 4, 13, "r", "{}", False, False), (2, 1, 14, "r", "{}", True, False)]
    (tmp_path / "in").mkdir()
    for k, run in enumerate((lambda s: stream_eligible(s, 1), stream_duplicates)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
        q = run(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start(str(tmp_path / f"out{k}"))
        q.awaitTermination(120)
    assert sorted((r["call_id"], r["turn"]) for r in spark.read.parquet(str(tmp_path / "out0")).collect()) == [(10, 1), (11, 2)]
    assert {r["call_id"]: r["supersedes"] for r in spark.read.parquet(str(tmp_path / "out1")).collect()} == {10: None, 11: 10, 12: None, 13: 12, 14: None}


@pytest.mark.parametrize("make", [lambda m: us.by_session(us.steps(m)), lambda m: nd.decisions(m, 1, 1, F.lit(1)), lambda m: pt.breakdown(pt.with_compaction(m), m.select("session_id", F.lit("c").alias("call_id")), m), lambda m: lb.progress_bars(m, m, m)])
def test_empty_tables(spark, make):
    assert make(frame(spark)).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    import sqlite3

    step = lambda i, r: json.dumps({"type": "step-finish", "tokens": {"input": i, "output": 1, "reasoning": 0, "cache": {"read": r, "write": 0}}, "cost": 0.25, "reason": "stop"})
    tables = {
        "project": [("p", "/w", 1)],
        "session": [("s1", "p", None, "/w", "First title", 1, 10), ("s2", "p", "s1", "/w", "second", 2, 20)],
        "message": [("m1", "s1", '{"role":"user"}', 1), ("m2", "s1", '{"role":"assistant","time":{"created":5,"completed":65005}}', 2), ("m3", "s2", "{broken", 3)],
        "part": [("a", "m1", "s1", '{"type":"text","text":"hi"}', 1), ("b", "m2", "s1", json.dumps({"type": "tool", "tool": "compress", "callID": "c", "state": {"status": "completed"}}), 2), ("c", "m2", "s1", step(10, 30), 3), ("d", "m3", "s2", step(5, 5), 4), ("e", "m3", "s2", "nonsense", 5)],
    }
    db = sqlite3.connect(tmp_path / "s.db")
    for t, rows in tables.items():
        spark.createDataFrame(rows, tb.STORE[t]).write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"CREATE TABLE {t} ({', '.join(x.split()[0] for x in tb.STORE[t].split(', '))})")
        db.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    db.commit()
    return str(tmp_path)


@pytest.mark.parametrize("kind", ["", "/s.db"])
def test_command_line(spark, store, kind, capsys):
    from quillon.__main__ import main

    def run(*args):
        assert main([args[0], "--store", store + kind, "--json", *args[1:]]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    usage = run("usage")
    assert [(r.get("session_id"), r["input"], r.get("cost")) for r in usage] == [("s2", 5, 0.25), ("s1", 10, 0.25), (None, 15, None)] and usage[1]["hit_rate"] == 75.0
    line = run("timeline", "--session", "s1")
    assert (line[0]["duration"], line[1]["uses"]) == ("1m 5s", 1)
    assert [r["id"] for r in run("find", "TITLE")] == ["s1"] and run("find", "title", "--exact") == []
    found = run("message", "m2", "nope", "m1")
    assert [(r["id"], r["error"]) for r in found] == [("m2", None), ("nope", "message_not_found"), ("m1", None)]
    assert run("impact", "--least", "1")[0] == {"scanned": 2, "skipped": 1, "analysed": 1, "with_calls": 0, "calls": 0, "steps": 1}
    assert main(["usage", "--store", store + kind]) == 0 and "cache_read" in capsys.readouterr().out
    assert main(["timeline", "--store", store + kind, "--session", "none"]) == 1 and main(["usage", "--store", store + "/nowhere"]) == 1


def test_sqlite_in_ranges(spark, store):
    rows = tb.sqlite_table(spark, store + "/s.db", "SELECT id, rowid FROM part WHERE rowid >= ? AND rowid < ?", "id string, n long", [(1, 3), (3, 100)])
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]


def test_context_of_a_request(spark):
    from quillon.operators.config import Config, load
    from quillon.plans import context as cx

    given = '{"filePath":"a"}'
    rows = [
        message(1, "user", text(0, "a<note>x</note>")), message(2, "assistant", part(0, "step-start"), tool(1, "read", "c1", given=given, output="old", metadata="{}")), message(3, "assistant", part(0, "step-start"), tool(1, "read", "c2", given=given, output="new"), tokens=(9, 1, 0, 0, 0)),
        message(4, "user", text(0, "covered")), message(5, "user", text(0, "go on"), model="other"),
    ]
    m = frame(spark, *rows)
    config = load({"compress": {"min_context": 5, "max_context": 100}})
    gone = cx.decide(m, config)
    assert [tuple(r) for r in gone.collect()] == [(1, "c1", 1)]
    assert cx.decide(m, load({"manual": True, "automatic_strategies": False})).count() == 0 and cx.decide(m, load({"deduplicate": {"protected_tools": ["read"]}})).count() == 0
    assert cx.decide(m, config, gone).count() == 0
    out = cx.build(m, config, gone, m.filter("seq = 4").select("session_id", "message_id"))
    shown = {r["seq"]: [p["text"] or p["output"] or p["type"] for p in r["parts"]] for r in out.collect()}
    assert shown == {1: ["a", "<mid>m0001</mid>"], 2: ["step-start", pt.OUTPUT_GONE + "<mid>m0002</mid>"], 3: ["step-start", "<note>compress soon\n\nBlocks in force: 0 (none)\n</note>", "new<mid>m0003</mid>"], 4: ["go on", "<mid>m0005</mid>"]}
    assert out.columns == m.columns and all(p["metadata"] is None for r in out.collect() for p in r["parts"])
    denied = cx.build(m, load({"compress": {"permission": "deny"}}), gone, m.filter("false").select("session_id", "message_id"))
    assert {r["seq"]: len(r["parts"]) for r in denied.collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 1} and Config().compress.permission == "allow"


def test_names(spark):
    from quillon.functions import text as tx

    n = spark.createDataFrame([(0,), (1,), (9999,), (10000,)], "n long")
    assert [tuple(r) for r in n.select(tx.message_ref(F.col("n")), tx.ref_tag(tx.block_ref(F.col("n")), "t"), tx.block_marker(F.col("n"))).collect()] == [(None, None, None), ("m0001", "<t>b1</t>", "(b1)"), ("m9999", "<t>b9999</t>", "(b9999)"), (None, "<t>b10000</t>", "(b10000)")]
    assert [r[0] for r in spark.createDataFrame([(0,), (None,), (1_700_000_000_000,)], "n long").select(tx.iso_time(F.col("n"))).collect()] == [None, None, "2023-11-14T22:13:20"]


def test_prompt_files(tmp_path):
    from quillon.functions import prompts as pp

    load = lambda *folders: pp.load("system", "default // kept", [str(f) for f in folders], "tag", ["manual"])
    first, second = tmp_path / "a", tmp_path / "b"
    first.mkdir(), second.mkdir()
    assert load(first, second) == "<tag>\ndefault // kept\n</tag>"
    (first / "system.md").write_text("﻿<!-- note -->a <tag> is only named\r\n// comment\r\nb<manual>x</manual>")
    assert load(first, second) == "<tag>\na <tag> is only named\nb\n</tag>"
    (second / "system.md").write_text('<TAG x="1">\nwrapped\n</tag>\n')
    assert load(first, second) == "<tag>\nwrapped\n</tag>"
    (second / "system.md").write_text("<tag>\nhalf")
    assert load(second) == "<tag>\ndefault // kept\n</tag>" and load(first, second).startswith("<tag>\na <tag>")
    assert pp.unwrapped("half </tag>", "tag") == "" and pp.wrapped(" ", "tag") == ""


def test_replies(spark, tmp_path):
    from quillon.operators import render as rd

    b = spark.createDataFrame([(1, 2000, 500, 100, 400, 1000, 3, 4)], "session_id long, total long, system long, user long, tool_tokens long, assistant long, tools_pruned long, messages_pruned long")
    lines = rd.context_reply(b, F.lit(1500), 10).first()["reply"].split("\n")
    assert lines == ["system     25.0% │███       │ 500", "user        5.0% │▓         │ 100", "assistant  50.0% │▒▒▒▒▒     │ 1K", "tool       20.0% │░░        │ 400", "pruned: 3 calls, 4 messages (1.5K)", "context: 2K", "without pruning: 3.5K"]
    assert rd.context_reply(b).first()["reply"].split("\n")[-1] == "context: 2K"
    r = spark.createDataFrame([(1, 2, 30, 1), (2, 0, 0, 0)], "session_id long, swept long, tokens long, skipped long")
    i = spark.createDataFrame([(1, ["→ a", "→ b"])], "session_id long, lines array<string>")
    assert {x["session_id"]: x["reply"] for x in rd.sweep_reply(r, i, True).collect()} == {1: "2 calls swept since the last user message, 30 tokens\n(1 protected)\n→ a\n→ b", 2: "no calls to sweep since the last user message"}
    s, every = spark.createDataFrame([(1, 5, 2, 3)], "session_id long, tokens long, tools long, messages long"), spark.createDataFrame([(5000, 20, 30, 4)], "tokens long, tools long, messages long, sessions long")
    assert rd.stats_reply(s, every).first()["reply"] == "this session: 5 tokens, 2 calls, 3 messages\nall sessions (4): 5K tokens, 20 calls, 30 messages"
    d = spark.createDataFrame([(1, 4, "off", 10), (1, 2, "on", 3), (1, 3, "on", 4)], "session_id long, block_id long, change string, compressed_tokens long")
    assert rd.change_reply(d, F.lit(4)).first()["reply"] == "block b4\nb4 shown again: 10 tokens\nb2, b3 hidden again: 7 tokens"
    k = spark.createDataFrame([(1, 2, "two", 10), (1, 1, None, 3)], "session_id long, block_id long, topic string, compressed_tokens long")
    assert rd.blocks_reply(k).first()["reply"] == "b1:  (3)\nb2: two (10)"
    us.write_report(s, every, str(tmp_path / "report"))
    saved = spark.read.json(str(tmp_path / "report/totals")).first()
    assert saved["tokens"] == 5000 and len(saved["generated_at"]) == 19


def test_blocks_in_a_range(spark):
    ranges = spark.createDataFrame([(1, 1, 2, 5, None), (1, 2, 9, 8, "bad")], "session_id long, cmd long, start_seq long, end_seq long, issues string")
    active = spark.createDataFrame([(1, 7, 4), (1, 3, 4), (1, 5, 2), (1, 9, 6), (2, 1, 3)], "session_id long, block_id long, anchor_seq long")
    assert [(r["cmd"], r["required"]) for r in cp.required_blocks(ranges, active).collect()] == [(1, [5, 3, 7])]
