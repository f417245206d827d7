"""Micro tables with results worked out by hand, and randomised comparisons with plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import blocks as bl
from quillon.operators import compact as cp
from quillon.operators import config as cf
from quillon.operators import derive as dv
from quillon.operators import permissions as pm
from quillon.operators import pressure as pr
from quillon.operators import reports as rp
from quillon.operators import strategies as st
from quillon.sources import tables as tb
from quillon.sources.scratch import writer


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.ts", "a.ts", True), ("*.ts", "b/a.ts", False), ("**/*.ts", "a.ts", True), ("**/*.ts", "b/c/a.ts", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("", "x", False), ("a/**", "a/b/c", True), ("a.b", "axb", False), ("abc", "abc\n", False), ("**", "a\nb", False), ("a[b", "a[b", True)],
)
def test_globs(spark, pattern, path, hit):
    assert spark.range(1).select(tx.path_protected(F.array(F.lit(path)), [pattern]).alias("x")).first()["x"] is hit


def test_lengths_and_formats(spark):
    d = spark.createDataFrame([("😀a",), ("",), (None,), ("x" * 10,)], "t string")
    assert [r[0] for r in d.select(tx.utf16_length(F.col("t"))).collect()] == [3, 0, None, 10]
    assert [r[0] for r in d.select(tx.token_count(F.col("t"))).collect()] == [1, 0, 0, 3]
    n = spark.createDataFrame([(999,), (1000,), (1250,), (150000,)], "n long")
    assert [r[0] for r in n.select(tx.format_tokens(F.col("n"))).collect()] == ["999", "1K", "1.3K", "150K"]
    ms = spark.createDataFrame([(5000,), (65000,), (3_720_000,)], "n long")
    assert [r[0] for r in ms.select(tx.format_duration(F.col("n"))).collect()] == ["5s", "1m 5s", "1h 2m"]
    tags = spark.createDataFrame([("a<n>x\ny</n>b<n>z</n><i>m1</i>c",)], "t string")
    assert tags.select(tx.scrub_tags(F.col("t"), "n", "i")).first()[0] == "abc"


def test_signature_ignores_order_and_top_level_nulls(spark):
    rows = [('{"b":1,"a":{"y":2,"x":null}}',), ('{"a":{"x":null,"y":2},"b":1,"c":null}',), ("not json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(tx.signature(F.lit("t"), F.col("p"))).collect()]
    assert got == ['t::{"a":{"x":null,"y":2},"b":1}', 't::{"a":{"x":null,"y":2},"b":1}', "t::not json", "t"]
    rows = [("null",), ("",), ("0",), ("false",), ('{"n":1e2,"s":"5.0,","d":1.5}',), ('{"n":100,"s":"5.0,","d":1.50}',), ('{"n":100.0,"s":"5.0,","d":1.5}',), ("[1.0]",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(tx.signature(F.lit("t"), F.col("p"))).collect()]
    assert got == ["t"] * 4 + ['t::{"d":1.5,"n":100,"s":"5.0,"}'] * 3 + ["t::[1]"]


def test_paths(spark):
    rows = [("read", '{"filePath":"a"}'), ("multiedit", '{"filePath":"a","edits":"[{\\"filePath\\":\\"b\\"},{\\"filePath\\":\\"a\\"}]"}'), ("apply_patch", '{"patchText":"*** Add File: x\\n*** Update File: y"}'), ("bash", "{}")]
    got = [r[0] for r in spark.createDataFrame(rows, "tool string, p string").select(tx.file_paths(F.col("tool"), F.col("p"))).collect()]
    assert got == [["a"], ["a", "b"], ["x", "y"], []]


CALLS = "session_id long, seq long, call_id long, tool string, status string, step_start boolean, path string, parameters string"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALLS)


def test_strategies(spark):
    c = calls(spark, [
        (1, 1, 10, "read", "completed", True, "a", '{"k":1}'), (1, 2, 11, "read", "completed", False, "a", '{"k":1}'), (1, 3, 12, "write", "completed", True, "a", '{"k":2}'),
        (1, 4, 13, "bash", "error", False, "b", '{"k":3}'), (1, 5, 14, "read", "completed", True, "a", '{"k":1}'), (1, 6, 15, "write", "completed", True, "a", '{"k":9}'), (2, 1, 16, "read", "completed", False, "a", '{"k":1}'),
    ])
    ids = lambda df: sorted(r["call_id"] for r in df.collect())
    assert ids(st.deduplicate(c)) == [10, 11]
    assert ids(st.deduplicate(c, protected_tools=["re*"])) == []
    assert ids(st.supersede_writes(c)) == [12]
    assert ids(st.purge_errors(c, 2)) == [13]
    assert ids(st.purge_errors(c, 3)) == []
    assert ids(st.sweep_last(c, 2, st.deduplicate(c))) == [14, 15, 16]
    assert ids(st.deduplicate(c, pruned=c.filter("call_id = 14"))) == [10]
    assert [st.may_run(), st.may_run(False), st.may_run(manual=True), st.may_run(manual=True, automatic=False)] == [True, False, True, False]


def test_distance(spark):
    s = spark.createDataFrame([(1, 1, "bash"), (1, 2, "compress"), (1, 3, "bash"), (1, 4, "compress")], "session_id long, seq long, tool string")
    assert [r["distance"] for r in rp.distances(s, ["compress"]).orderBy("seq").collect()] == [None, None, 0, 1]


def test_ignored_predicates(spark):
    rows = [([("text", True)],), ([("text", False)],), ([],), ([("tool", False)],)]
    d = spark.createDataFrame(rows, "parts array<struct<type:string,ignored:boolean>>")
    assert [tuple(r) for r in d.select(dv.ignored(F.col("parts")), dv.ignored_text(F.col("parts"))).collect()] == [(True, True), (False, False), (True, True), (False, False)]


def test_refs_skip_and_continue(spark):
    m = spark.createDataFrame([(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "user")], "session_id long, seq long, role string")
    assert [r["ref"] for r in dv.message_refs(m).orderBy("seq").collect()] == ["m0001", "m0002", "m0003"]
    sub = dv.message_refs(m, F.lit(True))
    assert [(r["seq"], r["ref"]) for r in sub.orderBy("seq").collect()] == [(2, "m0001"), (3, "m0002")]
    new = spark.createDataFrame([(1, 9)], "session_id long, seq long")
    assert dv.allocate_refs(new, sub).first()["ref"] == "m0003"


DENY = {"*": "deny"}


@pytest.mark.parametrize(
    ("everyone", "agents", "agent", "disabled"),
    [
        (DENY, {}, None, True),
        ({"*": "deny", "compress": "allow"}, {}, None, False),
        ({"other": "allow"}, {"a": DENY}, "a", True),
        ({"other": "allow"}, {"a": DENY}, "b", False),
        (DENY, {"a": {"compress": {"*": "allow"}}}, "a", False),
        ({"compr?ss": "deny"}, {}, None, True),
        ({"compress": {"src/*": "deny"}}, {}, None, False),
        ({"compress": {"*": "perhaps"}}, {}, None, False),
        (None, {}, None, False),
    ],
)
def test_permission_rules(everyone, agents, agent, disabled):
    assert pm.effective("allow", None, "compress", everyone, agents, agent) == ("deny" if disabled else "allow")
    assert pm.effective("ask", None, "compress", everyone, agents, agent) == ("deny" if disabled else "ask")


def test_last_user_and_what_follows(spark):
    m = spark.createDataFrame([(1, 1, "assistant", False), (1, 2, "user", False), (1, 3, "user", True), (1, 4, "assistant", False)], "session_id long, seq long, role string, ignored boolean")
    assert [tuple(r)[1:] for r in dv.last_user(m).orderBy("seq").collect()] == [(1, -1, 2), (2, 2, 1), (3, 2, 1), (4, 2, 0)]
    n = spark.createDataFrame([(10, 4, 9), (10, 40, 0)], "total long, off long, on long")
    assert [r[0] for r in n.select(bl.token_balance(F.col("total"), F.col("off"), F.col("on"))).collect()] == [15, 0]


def test_permission_details(spark):
    assert (pm.effective("ask", "allow", "compress"), pm.effective("deny", "allow", "compress"), pm.effective("allow", "deny", "compress")) == ("allow", "deny", "deny")
    assert pm.has_explicit({"a": "ask"}, "a") and not pm.has_explicit({"a*": "ask"}, "ab") and not pm.has_explicit(None, "a")
    many = pm.flatten_rules({"p": {f"x{i}": "deny" for i in range(1500)} | {"*": "allow"}}, {"q": "ask"})
    assert len(many) == 1502 and many[-1] == ("q", "*", "ask") and many[1499].pattern == "x1499"
    rules = pm.flatten_rules({"*": "ask", "run": {"git *": "allow", "git push *": "deny", "a?c": "deny"}})
    asked = [("run", "git"), ("run", "git status"), ("run", "git push x"), ("run", "git push"), ("run", "abc"), ("run", "abc\n"), ("x", "y"), ("run", "a\\c")]
    df = spark.createDataFrame(asked, "p string, t string").select(pm.last_match(F.col("p"), F.col("t"), rules)["action"])
    assert [r[0] for r in df.collect()] == ["allow", "allow", "deny", "deny", "deny", "ask", "ask", "deny"]
    assert spark.range(1).select(pm.last_match(F.lit("a"), F.lit("b"), [])["action"]).first()[0] is None
    assert [pm.wildcard_match(v, p) for v, p in (("abc\n", "abc"), ("a\nb", "a*"), ("x y", "x *"), ("x", "x *"), ("a/b", "a\\b"))] == [False, True, True, True, True]
    by = spark.createDataFrame([("a",), ("b",), (None,)], "agent string").select(pm.effective_by_agent(F.col("agent"), "ask", "compress", None, {"a": DENY}))
    assert [r[0] for r in by.collect()] == ["deny", "ask", "ask"]


def test_block_activity_against_a_fold(spark):
    rng, rows, want = random.Random(5), [], {}
    for s in range(300):
        n = rng.randint(1, 7)
        own = []
        for b in range(1, n + 1):
            eats = rng.sample(range(1, b), rng.randint(0, min(2, b - 1))) if b > 1 else []
            own.append((s, b, rng.randint(1, 4) if rng.random() < 0.3 else b, b, eats, rng.random() < 0.2, rng.random() < 0.85, 1))
        rows += own
        on: set[int] = set()
        for _, b, _, _, eats, back, there, _ in sorted(own, key=lambda r: (r[2], r[1])):
            if there and not back:
                on -= set(eats)
                on.add(b)
        want |= {(s, r[1]): r[1] in on for r in own}
    df = spark.createDataFrame(rows, "session_id long, block_id long, created long, anchor_seq long, consumed array<long>, deactivated_by_user boolean, origin_present boolean, compressed_tokens long")
    assert {(r["session_id"], r["block_id"]): r["active"] for r in bl.activity(df).collect()} == want


def test_turn_and_spaced_anchors_against_loops(spark):
    rng, rows, turn, spaced = random.Random(3), [], set(), set()
    for s in range(200):
        roles = [rng.choice(["user", "assistant", "system"]) for _ in range(rng.randint(0, 9))]
        rows += [(s, i, r) for i, r in enumerate(roles)]
        known = [(i, r) for i, r in enumerate(roles) if r != "system"]
        for (i, a), (j, b) in zip(known, known[1:], strict=False):
            if (a, b) == ("assistant", "user"):
                turn |= {(s, i), (s, j)}
        last = None
        for i, r in enumerate(roles):
            if r == "user" and (last is None or i - last >= 3):
                spaced.add((s, i))
                last = i
    m = spark.createDataFrame(rows, "session_id long, seq long, role string")
    assert {(r["session_id"], r["seq"]) for r in pr.turn_anchors(m).collect()} == turn
    assert {(r["session_id"], r["seq"]) for r in pr.spaced_anchors(m.filter("role = 'user'"), 3).collect()} == spaced


BLOCK_ROW = "session_id long, block_id long, created long, anchor_seq long, consumed array<long>, deactivated_by_user boolean, origin_present boolean, compressed_tokens long"


def test_ancestors_at_any_depth(spark):
    chain = [(1, b, b, b, [b - 1] if b > 1 else [], False, True, 1) for b in range(1, 14)]
    ring = [(2, 1, 1, 1, [2], True, True, 1), (2, 2, 2, 2, [1], True, True, 1), (3, 1, 1, 1, [], False, True, 1), (3, 2, 2, 2, [1], False, True, 1), (3, 3, 3, 3, [1], False, True, 1)]
    out = bl.ancestors(spark.createDataFrame(chain + ring, BLOCK_ROW), writer(spark, "test"))
    got = {(r["session_id"], r["block_id"]): (r["ancestor"], r["depth"]) for r in out.collect()}
    assert got == {(1, b): (13, 13 - b) for b in range(1, 13)} | {(3, 1): (2, 1)}
    assert bl.ancestors(spark.createDataFrame([], BLOCK_ROW), writer(spark, "test")).count() == 0
    texts = spark.createDataFrame([("b12",), (" 7 ",), ("B3",), ("0",), ("b0",), ("x",), (None,)], "t string")
    assert [r[0] for r in texts.select(bl.block_number(F.col("t"))).collect()] == [12, 7, 3, None, None, None, None]
    assert [r["block_id"] for r in bl.available(spark.createDataFrame(chain, BLOCK_ROW)).collect()] == [13]
    held = bl.inside_active(spark.createDataFrame(chain, BLOCK_ROW), out).filter("block_id = 4").first()
    assert held["held_by"] == 13


def test_placeholders():
    bodies = {1: "one", 2: "two", 3: "three"}
    # known and required; unknown; repeated; known but out of the range
    assert cp.expand("x (b1) (b9) (b1) {block_2}", [1], bodies) == ("x one (b9) (b1) {block_2}", [1], [])
    text, used, missing = cp.expand("x", [1], bodies)
    assert (text, used, missing) == ("x", [], [1])
    assert cp.append_missing(text, missing, bodies) == f"x\n\n{cp.Wording.blocks}\n### (b1)\none"
    # boundaries that are blocks stand before and after, unless they are marked
    assert cp.expand("x", [1, 2, 3], bodies, 1, 3) == ("one\n\nx\n\nthree", [1, 3], [2])
    assert cp.expand("(B3) x", [1, 3], bodies, 1, 3) == ("one\n\nthree x", [3, 1], [])
    assert cp.unwrap(cp.wrap(4, " body\ntext\n")) == "body\ntext" and cp.unwrap("no header [b1]") == "no header [b1]" and cp.unwrap(cp.wrap(4, " ")) == ""
    assert [cp.merge_spaced(a, b) for a, b in (("a ", " b"), (" ", "b "), ("a ", " "))] == ["a\n\nb", "b ", "a "]


def test_arguments():
    flat = {"topic": "t", "startId": "m0001", "endId": " ", "summary": 5}
    assert cp.argument_issues(cp.normalized_arguments(flat)) == ["end_id must be a text that is not blank", "summary must be a text that is not blank"]
    nested = {"topic": "t", "content": {"startId": "a", "endId": "b", "summary": "c"}}
    assert cp.normalized_arguments(nested) == {"topic": "t", "start_id": "a", "end_id": "b", "summary": "c"} and not cp.argument_issues(cp.normalized_arguments(nested))
    cp.raise_issues([])
    with pytest.raises(ValueError, match="^one$"):
        cp.raise_issues(["one"])
    with pytest.raises(ValueError, match="- one\n- two"):
        cp.raise_issues(["one", "two"])


COMMAND = "session_id long, cmd long, topic string, start_id string, end_id string, summary string"


def test_compaction_of_a_child_session(spark):
    """A child's first prompt has no reference; two messages become one block."""
    m = spark.createDataFrame([(1, 1, "user", "prompt"), (1, 2, "assistant", "reply"), (1, 3, "user", "more words")], "session_id long, seq long, role string, text string")
    refs = dv.message_refs(m, F.lit(True))
    cmds = spark.createDataFrame([(1, 1, "t", "m0001", "m0002", "short")], COMMAND)
    out = cp.compact(cmds, cp.plain_messages(m, refs)).collect()
    assert len(out) == 1 and out[0]["reply"] == "2 messages are now [compressed section]." and list(out[0]["effective_seqs"]) == [2, 3]


def test_compaction_of_one_session(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "x" * 8) for i in range(5)], "session_id long, seq long, role string, text string")
    cmds = spark.createDataFrame([(1, 1, "a", "m0001", "m0002", "first"), (1, 2, "b", "b1", " M0003", "then (b1)"), (1, 3, "c", "m0009", "m0001", "no"), (1, 4, "d", "m0002", "m0001", "no"), (1, 5, "e", "b2", "m0004", "all"), (1, 6, "f", "b1", "m0004", "no")], COMMAND)
    rows = cp.plain_messages(m, dv.message_refs(m))
    out = {r["block_id"]: r for r in cp.compact(cmds, rows).collect()}
    assert sorted(out) == [1, 2, 3]
    assert [out[b]["active"] for b in (1, 2, 3)] == [False, False, True] and [list(out[b]["consumed"]) for b in (1, 2, 3)] == [[], [1], [2]] and [list(out[b]["parents"]) for b in (1, 2, 3)] == [[2], [3], []]
    assert [out[b]["compressed_tokens"] for b in (1, 2, 3)] == [4, 2, 2] and list(out[3]["direct_seqs"]) == [3] and out[3]["n_messages"] == 4
    assert "then first" in out[2]["summary"] and cp.unwrap(out[3]["summary"]) == "then first\n\nall"
    errors = {r["cmd"]: r["error"] for r in cp.compact(cmds, rows, errors=True).collect() if r["error"]}
    assert errors == {3: "start: no such reference: m0009", 4: "start is after end", 6: "start: no such reference: b1"}
    ids = sorted((r["block_id"], r["seq"]) for r in cp.effective_ids(cp.compact(cmds, rows)).collect())
    assert ids == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3)]
    covered = {r["seq"]: (list(r["all_blocks"]), list(r["active_blocks"]), r["tokens"]) for r in cp.covered_messages(cp.compact(cmds, rows), rows).collect()}
    assert covered == {0: ([1, 2, 3], [3], 2), 1: ([1, 2, 3], [3], 2), 2: ([2, 3], [3], 2), 3: ([3], [3], 2)}


def folded(commands, tokens, ignored, tools):
    """A session's commands over plain sets: what is covered now and before, block by block."""
    blocks, refs = {}, [s for s in sorted(tokens) if s not in ignored]
    for start, end, marks in commands:
        def at(name):
            if name[0] == "b":
                b = blocks.get(int(name[1:]))
                return (b["anchor"], int(name[1:])) if b and b["on"] else (None, None)
            i = int(name[1:])
            return (refs[i - 1], None) if 1 <= i <= len(refs) else (None, None)

        (a, sb), (z, eb) = at(start), at(end)
        if a is None or z is None or a > z:
            continue
        inside = [s for s in refs if a <= s <= z]
        need = [n for n, b in sorted(blocks.items(), key=lambda x: (x[1]["anchor"], x[0])) if b["on"] and b["anchor"] in inside]
        used = []
        for n in marks:
            if n in need and n not in used:
                used.append(n)
        missing = [n for n in need if n not in used and n not in (sb, eb)]
        for n in (sb, eb):
            if n is not None and n not in used:
                used.append(n)
        used += [n for n in missing if n not in used]
        covered = {s for b in blocks.values() if b["on"] for s in b["all"]}
        held = {t for b in blocks.values() if b["on"] for t in b["tools"]}
        whole = set(inside).union(*[blocks[n]["all"] for n in used])
        mine = {t for s in inside for t in tools.get(s, [])}.union(*[blocks[n]["tools"] for n in used])
        new = len(blocks) + 1
        blocks[new] = {"anchor": a, "on": True, "all": whole, "tools": mine, "used": used, "missing": missing, "parents": [], "tokens": sum(tokens[s] for s in whole - covered), "direct_tools": mine - held}
        for n in used:
            if blocks[n]["on"]:
                blocks[n]["on"] = False
                blocks[n]["parents"].append(new)
    return blocks


def test_nested_commands_against_a_fold(spark):
    rng, messages, commands, want = random.Random(8), [], [], {}
    for s in range(400):
        n = rng.randint(1, 14)
        tokens, ignored = {i: rng.randint(0, 9) for i in range(n)}, {i for i in range(n) if rng.random() < 0.15}
        tools = {i: [f"t{rng.randint(0, 9)}"] for i in range(n) if rng.random() < 0.5}
        names = [f"m{i:04d}" for i in range(0, n + 2)] + [f"b{i}" for i in range(1, 5)]
        mine = []
        for c in range(rng.randint(0, 7)):
            marks = [rng.randint(1, 6) for _ in range(rng.randint(0, 3))]
            mine.append((rng.choice(names), rng.choice(names), marks))
            commands.append((s, c, "t", mine[-1][0], mine[-1][1], "text " + " ".join(f"(b{k})" for k in marks)))
        place = 0
        for i in range(n):
            place += i not in ignored
            messages.append((s, i, None if i in ignored else f"m{place:04d}", tokens[i], i in ignored, None, tools.get(i, []), []))
        want |= {(s, b): x for b, x in folded(mine, tokens, ignored, tools).items()}
    df = spark.createDataFrame(messages, cp.MESSAGE)
    got = {(r["session_id"], r["block_id"]): r for r in cp.compact(spark.createDataFrame(commands, COMMAND), df).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for k, x in want.items():
        r = got[k]
        assert (r["active"], set(r["effective_seqs"]), list(r["consumed"]), list(r["missing"]), list(r["parents"]), r["compressed_tokens"]) == (x["on"], x["all"], x["used"], x["missing"], x["parents"], x["tokens"])
        assert set(r["effective_tools"]) == x["tools"] and set(r["direct_tools"]) == x["direct_tools"]


def test_limits(spark):
    d = spark.createDataFrame([("50%", 1000), ("150%", 1000), ("700", 1000), ("50%", None)], "v string, m long")
    assert [r[0] for r in d.select(pr.resolved_limit(F.col("v"), F.col("m"))).collect()] == [500, 1000, 700, None]
    cur = spark.createDataFrame([(1, 10)], "session_id long, current_tokens long")
    assert tuple(pr.over_limits(cur, F.lit(None).cast("long"), F.lit(None).cast("long")).first())[2:] == (False, True)


def test_config_layers():
    layer = cf.parse_jsonc('{ // note\n "compress": {"max_context": "80%", "protected_tools": ["a",], }, "debug": true, /* x */ }')
    c = cf.load({"compress": {"protected_tools": ["b"]}}, layer)
    assert cf.as_dict(c)["compress"]["protected_tools"] == ("b", "a")
    assert cf.type_errors({"compress": {"model_max": {"p/m": "50%", "q": "x"}, "model_min": 3, "nudge_force": "hard"}, "protected_paths": "a"}) == ["compress.model_max.q: number or percentage expected", "compress.model_min: object expected", "compress.nudge_force: soft or strong expected", "protected_paths: list of strings expected"]
    assert (c.debug, c.compress.max_context, c.compress.protected_tools, c.purge_errors.turns) == (True, "80%", ("b", "a"), 4)
    assert cf.unknown_keys({"compress": {"nope": 1}, "x": 2}) == ["compress.nope", "x"]
    assert cf.type_errors({"debug": 1, "compress": {"permission": "maybe", "max_context": "x"}}) == ["debug: boolean expected", "compress.permission: ask, allow or deny expected", "compress.max_context: number or percentage expected"]
    assert [cf.at_least_one(x) for x in (None, 0.2, 3.9)] == [1, 1, 3]


def test_sources(spark, tmp_path):
    import json
    import sqlite3

    db = tmp_path / "s.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE session (id INT, title TEXT)")
        c.executemany("INSERT INTO session VALUES (?, ?)", [(1, "a"), (2, "b")])
    assert [tuple(r) for r in tb.sqlite_table(spark, str(db), "SELECT id, title FROM session ORDER BY id", "id long, title string").collect()] == [(1, "a"), (2, "b")]
    s = spark.createDataFrame([(1, "Abc", "d", None, 5), (2, "xabc", "d", 1, 6)], "id long, title string, directory string, parent_id long, time_updated long")
    assert [r["id"] for r in tb.list_sessions(s, search="ABC").collect()] == [2, 1]
    with pytest.raises(LookupError):
        tb.get_session(s, 9)


def test_stream_matches_batch(spark, tmp_path):
    from quillon.streaming.sessions import stream_duplicates

    rows = [(1, 1, 10, "read", "completed", True, "a", '{"k":1}'), (1, 2, 11, "read", "completed", False, "a", '{"k":2}'), (1, 3, 12, "read", "completed", True, "a", '{"k":1}'), (2, 1, 13, "read", "completed", False, "a", '{"k":1}')]
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(src)
    for part in (rows[:2], rows[2:]):  # two runs from one checkpoint
        calls(spark, part).coalesce(1).write.mode("append").parquet(src)
        q = stream_duplicates(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    spark.read.parquet(str(tmp_path / "out")).createOrReplaceTempView("dups")
    got = {r["call_id"]: (r["turn"], r["supersedes"]) for r in spark.sql("SELECT * FROM dups").collect()}
    assert got == {10: (1, None), 11: (1, None), 12: (2, 10), 13: (0, None)}


def test_stream_sums(spark, tmp_path):
    from quillon.streaming.sessions import stream_token_stats

    schema = "session_id long, input long, output long, cache_read long"
    (tmp_path / "in").mkdir()
    for k in range(2):
        spark.createDataFrame([(1, 10, 1, 5), (2, 3, 1, 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out: list = []
        q = stream_token_stats(stream).writeStream.foreachBatch(lambda df, _: out.append(sorted(map(tuple, df.collect())))).outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert out[-1] == [(1, 10 * (k + 1), k + 1, 5 * (k + 1), k + 1), (2, 3 * (k + 1), k + 1, 0, k + 1)]
