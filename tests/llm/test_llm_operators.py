"""Operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, common, components, jaccard, mixing, quality, repeats, secrets, sharding, suffixes, token_counts, topk
from quillon.llm.common import Scratch
from quillon.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, n_words string, slot int, sig int, gid int"


def table(spark, rows):
    """Documents with extra columns whose names clash with what operators add."""
    full = [(i, t, lang, src, None if t is None else len(t), "x", "y", 1, 2, 3) for i, t, lang, src in rows]
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(full, SCHEMA)
    return df


@pytest.fixture(scope="module", autouse=True)
def case(spark):
    yield
    spark.conf.unset("spark.sql.caseSensitive")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(80))
    rows = [(1000, None, None, None), (1001, "", "en", "s1"), (1002, " \n\t ", "en", "s1"), (1003, "a b", "en", "s1"), (1004, "A  B", "en", "s2"), (None, "one two three four five six", "en", None)]
    for i in range(n):
        k = rng.choice([1, 4, 6, 20, 60, 150])
        text = [rng.choice(words) for _ in range(k)]
        if i % 7 == 0:
            text[k // 2 : k // 2] = passage.split()
        if i % 5 == 0 and i > 10:
            text = (rows[-3][1] or "z").split()
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text) + rng.choice(["", "\n", " end."]), rng.choice(["en", "fr"]), f"s{rng.choice([1, 1, 1, 2, 3])}"))
    return [*rows, rows[20], (5000, rows[20][1], "en", "s9")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, table(spark, rows)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows):
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)] += [r[0]] if r[0] is not None else []
    return [(r[0], len(sets[i]), min(least[root(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_shingles(docs):
    rows, _ = docs
    got = [len(s) for s in shingle_sets(pa.array([r[1] for r in rows], pa.string()))]
    assert got == [len(shingles(r[1])) for r in rows]


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_no_long_word_is_taken_for_another(spark):
    a, b = thue_morse(4096), thue_morse(4096, "ba")
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (3, f"{a} {b} x y z", "en", "s"), (4, f"{b} {a} x y z", "en", "s"), (5, "q" * 50_000, "en", "s"), (6, "q" * 50_001, "en", "s"), (7, a.upper(), "en", "s")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (1, 6), 7: (1, 1)}


def test_frequent_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i % 5 if i < 9 else 7, i) for i in range(40)] + [(None, 99)], "k long, v int")
    few = spark.createDataFrame([(k, k * 10) for k in (0, 1, 2, 7, 8)], "k long, w long")
    for how in ("inner", "left"):
        assert sorted(common.join_few(rows, few, "k", how).collect(), key=str) == sorted(rows.join(few, "k", how).collect(), key=str)


@pytest.mark.parametrize("most", [10**6, 0])
def test_near_duplicates_leave_with_and_without_broadcast(docs, most, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(common, "MOST_KEYS", most)
    want = {c for i, n, c in near_groups(rows)}
    got = [r["doc_id"] for r in jaccard.without_near_duplicates(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_jaccard_on_frequent_sets(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "MOST_HOT", 10**9)
    monkeypatch.setattr(common, "COUNTERS", 1 << 12)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=key) == sorted(near_groups(rows), key=key)
    want = {c for i, n, c in near_groups(rows)}
    assert {r["doc_id"] for r in jaccard.without_near_duplicates(df).collect()} == want


def test_sets_with_one_signature_are_told_apart(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(jaccard.Join, "clashes", lambda self, sets: frozenset(r["sig"] for r in sets.select("sig").collect()[::2]))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=key) == sorted(near_groups(rows), key=key)


def test_scratch_is_released(spark, docs, tmp_path):
    out = jaccard.near_duplicates(docs[1])
    assert out.count() == len(docs[0]) and common.Scratch.roots
    common.release(spark)
    assert not common.Scratch.roots


@pytest.mark.parametrize("light", [None, 40])
def test_jaccard(docs, light, monkeypatch):
    rows, df = docs
    if light:
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, others: light)
    got = jaccard.near_duplicates(df).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(near_groups(rows), key=key)


def test_jaccard_keeps_one(docs):
    rows, df = docs
    want = {c for i, n, c in near_groups(rows)}
    got = [r["doc_id"] for r in jaccard.without_near_duplicates(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_jaccard_judges_rows_not_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(12))
    rows = [(None, text("a")), (1, text("a") + " end"), *[(None, text(c)) for c in "bcd"], (None, text("b") + " end"), (2, text("e")), (3, text("e") + " end"), (3, text("f")), (4, text("g")), (4, text("h")), (4, text("g")), (5, None), (5, " "), (5, " "), (None, None), (None, None)]
    want = [(1, text("a") + " end"), *[(None, text(c)) for c in "bcd"], (2, text("e")), (3, text("f")), (4, text("g")), (4, text("h")), (5, None), (5, " "), (5, " "), (None, None), (None, None)]
    got = jaccard.without_near_duplicates(table(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)


@pytest.mark.parametrize("size, coarse", [(1 << 30, False), (30 << 30, False), (500 << 30, False), (100 << 40, True)])
def test_counters_never_deal_rare_lists(size, coarse):
    width = common.counters(size, jaccard.COUNTER_TEXT)
    order = jaccard.Order(np.full(1 << 12, size // 6 // width))  # a shingle for six bytes of text
    assert order.coarse == coarse
    assert (order.parts(np.arange(5000) * 977) == 1).all()


def test_long_lists_are_counted_where_counters_are_coarse(spark, monkeypatch):
    monkeypatch.setattr(common, "COUNTERS", 64)
    monkeypatch.setattr(jaccard, "BLOCK", 9)
    rng = random.Random(4)
    word = lambda: str(rng.randrange(10**9))
    shared = [[word() for _ in range(7)] for _ in range(3)]
    rows = [(None, None, "en", "s"), (-1, "", "en", "s"), (-2, "one", "en", "s")]
    for i in range(90):
        own = [word() for _ in range(rng.randint(20, 60))]
        text = " ".join(shared[i % 3] + own)
        rows += [(4 * i + c, text + f" {c}" * (c > 0), "en", "s") for c in range(rng.randint(1, 3))]
    join = jaccard.Join(table(spark, rows))
    join.scan()
    assert join.order.coarse
    join.lists()
    posts = spark.createDataFrame([tuple(r) for r in join.docs.mapInArrow(jaccard._post(join.order, join.light, join.clash), jaccard.POSTINGS).collect()], jaccard.POSTINGS)
    length = Counter(r["key"] for r in posts.filter("pos >= 0").collect())
    entries = join.entries.collect()
    assert {r["key"] for r in entries if r["part"] > 0} == {k for k, n in length.items() if n > 9} != set()
    members = Counter((r["key"], r["part"]) for r in entries)
    assert all(members[k, p] > 1 for k, p in members if p == 0)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r) for r in jaccard.near_duplicates(table(spark, rows)).collect()), key=key) == sorted(near_groups(rows), key=key)


def test_cluster_blocks_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CLUSTER_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(2)
    base = [str(rng.randrange(10**6)) for _ in range(70)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(70)] = str(rng.random())
        rows.append((i, " ".join(t), "en", "s"))
    assert sorted(tuple(r) for r in jaccard.near_duplicates(table(spark, rows)).collect()) == sorted(near_groups(rows))


@pytest.mark.parametrize("task_edges", [3, 10**6])
def test_components(spark, task_edges):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["comp"] for r in components.components(df, Scratch(spark, "test"), "c", task_edges).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def test_sharding(spark, docs):
    rows, df = docs
    got = sharding.shard_documents(df).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(24))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_equal_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 7)
    rows = [(1, "the same text", "en", "s")] * 900 + [(i, f"text {i}", "en", "s") for i in range(300)]
    got = sharding.shard_documents(table(spark, rows)).collect()
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(got) == 1200 and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert max(load.values()) - min(load.values()) <= 3 * 21 and len(load) == 24


def test_rebalancing_moves_little(spark, tmp_path):
    per = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % 9 + 1).alias("slot_bytes"))
    store = sharding.MapStore(spark, str(tmp_path / "map"))
    old = store.write(sharding.build_map(spark, per, 4, 64), 1)
    new = store.write(sharding.rebalance_map(spark, old, per, 5, 64), 2)
    a, b = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (old, new))
    sums = Counter()
    for s, n in b.items():
        sums[n] += s % 9 + 1
    assert set(b.values()) == set(range(5)) and max(sums.values()) - min(sums.values()) <= 12
    assert sum(a[s] != b[s] for s in a) <= 64 // 3
    assert store.read(1).first()["version"] == 1 and store.read(2).first()["version"] == 2


def test_secrets(spark):
    texts = ['é api_KEY = "abcdef12" x', "token=abcde token: abcdef", "AKIA" + "A" * 16 + " AKIA123", "0123456789abcdef01234567 " + "f" * 23, None, "", "550e8400-e29b-41d4-a716-446655440000", "key aB3xK9pQ7zL2mN8vR4tY6wU1"]
    out = {r["doc_id"]: r for r in secrets.scan(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), mask=True).collect()}
    assert [(out[i]["n_assign"], out[i]["n_access"], out[i]["n_hex"]) for i in range(7)] == [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert out[0]["base_sha256"] == hashlib.sha256(b"assign:2:21").hexdigest() and out[0]["spans"].startswith("assign:2:21")
    assert out[6]["n_entropy"] == 0 and out[7]["n_entropy"] == 1 and out[7]["masked"] == "key [SECRET]" and out[4]["masked"] is None


def test_window_entropy_is_incremental():
    rng = random.Random(1)
    text = "".join(rng.choice("ab1Z") for _ in range(60))
    want = [-sum(c / 20 * np.log2(c / 20) for c in Counter(text[i : i + 20]).values()) for i in range(41)]
    assert np.allclose(list(secrets.window_bits(text, 20)), want)


@pytest.mark.parametrize("key", ["9F86D081884C7D659A2FEAA0C55AD015", "9f86d081884c7d659a2f", "9F86D081884C7D659A2FEA", "k8Jq2mZx7Lw4Tn9Rb3Vc"])
@pytest.mark.parametrize("before, after", [("", ""), ("id=", ""), ("prod-", ""), ("sum_", "_old"), ("-", "/"), ("region/", "==")])
def test_a_key_is_found_whatever_touches_it(key, before, after):
    rule = secrets.Entropy()
    spans = secrets.entropy_spans(f"x {before}{key}{after} y", rule, re.compile("|".join(rule.allow)))
    at = 2 + len(before)
    assert any(a <= at and b >= at + len(key) for a, b in spans)


@pytest.mark.parametrize("text", ["/usr/lib/python3/site-packages/numpy", "order-20231105123456789012", "550e8400-e29b-41d4-a716-446655440000", "a_long_name_of_some_function_v2"])
def test_names_numbers_and_paths_are_no_keys(text):
    rule = secrets.Entropy()
    assert not secrets.entropy_spans(text, rule, re.compile("|".join(rule.allow)))


def counts(text):
    w, seen, dup = WORD.findall(text or ""), set(), 0
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality(spark, docs):
    rows, _ = docs
    rows = [*rows, (7000, "a b c d e f a b c d e f g\nx y\nx y\n$$ # x", "en", "s1"), (7001, "w " * 300, None, None), (7002, "*** " + " ".join(f"w{i}***" for i in range(50)), "en", "s1")]
    got = quality.score(table(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *counts(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert verdict[7002] is False
    kept = quality.keep(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == sum(r["kept"] for r in got)


def test_quantile_sketch_is_close(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(-2, 1) for _ in range(3000)]
    df = spark.createDataFrame([("en", "s", *([v] * len(quality.RULES))) for v in values], "lang string, source string, " + ", ".join(f"{r} double" for r in quality.RULES))
    sk = quality.sketches(df)
    found = {q["rule"]: q for q in quality.quantiles(sk, "lang", "source").collect()}
    values.sort()
    for rule, (level, _) in quality.RULES.items():
        q = found[rule]
        assert abs(q["mid"] / values[1499] - 1) < 0.03 and abs(q["high"] / values[round(3000 * level) - 1] - 1) < 0.03 and q["rows"] == 3000
    halves = [quality.sketches(df.filter(c)) for c in ("symbol_ratio < 0.1", "symbol_ratio >= 0.1")]
    both = quality.merged(halves[0].unionByName(halves[1]), "lang", "source")
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, sk.select("lang", "source", "rule", "bin", "n").collect()), key=str)


def test_fences_do_not_step_with_the_size_of_a_group(spark):
    sizes = {"a": 60, "b": 199, "c": 200, "d": 201}
    rows = [(lang, "hot", 0.01) for lang in sizes for _ in range(2000)] + [(lang, "code", 0.2 + 0.2 * i / n) for lang, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(lang, src, *([v] * len(quality.RULES))) for lang, src, v in rows], "lang string, source string, " + ", ".join(f"{r} double" for r in quality.RULES))
    top = {r["f_lang"]: r["top_symbol_ratio"] for r in quality.fences(quality.sketches(df)).filter("f_source = 'code'").collect()}
    assert max(top[x] for x in "bcd") - min(top[x] for x in "bcd") < 0.01
    assert min(top.values()) > 0.4


def test_fences_come_from_the_sketches_alone(spark):
    """Groups that differ get fences that differ, and a corpus scaled by 10 gets fences 10 times as high."""
    rng = random.Random(7)
    rows = [(src, rng.lognormvariate(mean, 0.3)) for src, mean in (("a", -4), ("b", -3), ("c", -2)) for _ in range(500)]
    names = "lang string, source string, " + ", ".join(f"{r} double" for r in quality.RULES)
    tops = []
    for scale in (1, 10):
        df = spark.createDataFrame([("en", src, *([v * scale] * len(quality.RULES))) for src, v in rows], names)
        tops.append({r["f_source"]: r for r in quality.fences(quality.sketches(df)).collect()})
    for rule in quality.RULES:
        a, b, c = (tops[0][s][f"top_{rule}"] for s in "abc")
        assert a < b < c and all(abs(tops[1][s][f"top_{rule}"] / tops[0][s][f"top_{rule}"] / 10 - 1) < 0.03 for s in "abc")


def test_a_few_symbols_are_chance(spark):
    """Where hardly a text has symbols, a few in a long text stay, many go."""
    plain = " ".join(f"word{i} is not here" for i in range(40))
    rows = [(i, f"{plain} {i}", "en", "s") for i in range(60)] + [(100, plain + " 5% & more", "en", "s"), (101, plain + " ### $$$ *** %%% |||", "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality.score(table(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] == [101]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


TEXTS = ["", "Hello  WORLD, it's <|endoftext|>É é ΣΑΣ 123 don't!!!", "<|startoftext|><|ENDOFTEXT|>", "日本語テキスト123🎉 e\u0301", "a" * 3000, "x\x1cy\x85z\xa0w ab_c ²½", "'S 're ''", "\u0558\u0d50\U00010d50 İ"]


def test_bpe_matches_the_library(spark, library, docs):
    rows = [(i, t, "en", "s") for i, t in enumerate([*TEXTS, None])] + docs[0]
    want = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    got = bpe.digests(table(spark, rows)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((r[0], len(w), sha(" ".join(map(str, w))), sha(library.decode(w, skip_special_tokens=False))) for r, w in zip(rows, want, strict=True))
    encoded = bpe.encode_documents(table(spark, rows))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((r[0], tuple(w)) for r, w in zip(rows, want, strict=True))
    texts = Counter((r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded).collect())
    assert texts == Counter((r[0], library.decode(w, skip_special_tokens=False)) for r, w in zip(rows, want, strict=True))


def test_bpe_on_random_words(library):
    rng, e = random.Random(8), bpe.Encoder(bpe.default_vocabulary())
    c = token_counts.Counter(bpe.default_vocabulary())
    for _ in range(400):
        text = "".join(rng.choice("thean ings'éü1.!<|\n") for _ in range(rng.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == ids and c.count(text) == len(ids)


def test_every_code_point_has_the_library_classes(library):
    e = bpe.Encoder(bpe.default_vocabulary())
    for c in [*range(0, 0x600), *range(0x1E00, 0x2100), *range(0x20A0, 0x20C0), *range(0x3000, 0x3100, 7), *range(0x10D40, 0x10D60)]:
        text = f"A{chr(c)}{chr(c)}1 {chr(c)}"
        assert e.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_chunk_maps_compose(library, chunk, monkeypatch):
    monkeypatch.setattr(token_counts.Counter, "CHUNK", chunk)
    monkeypatch.setattr(token_counts.Transducer, "MOST_STATES", 500)
    c = token_counts.Counter(bpe.default_vocabulary())
    rng = random.Random(chunk)
    letters = "".join(rng.choices("etaoinshr", k=900))
    for text in ("It's a test <|endoftext|> of chunks\n" * 9 + "unbroken" * 30, letters, "x" * 700, "日本語<|endoftext|>é" * 80, letters[:300] + "1!" + letters):
        ends = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in (len(text), len(text) // 2)]
        assert [c.count(text), c.count(text[: len(text) // 2])] == ends
    maps = [x.map(c.transducer) for x in c.chunks(letters)]
    prefixes = token_counts.scan(maps)
    state, total = token_counts.START, 0
    for m, prefix in zip(maps, prefixes, strict=True):
        state, n = m(state)
        total += n
        assert prefix(token_counts.START) == (state, total)
    if len(maps) > 2:
        a, b, d = maps[:3]
        left, right = token_counts.compose(token_counts.compose(a, b), d), token_counts.compose(a, token_counts.compose(b, d))
        for x in (token_counts.START, *[m(token_counts.START)[0] for m in maps[:20]]):
            assert left(x) == right(x)


def test_long_text_without_white_space(spark, library):
    rng = random.Random(4)
    rows = [(1, "".join(rng.choices("etaoinshrdlu", k=200_000)), "en", "s"), (2, "é" * 90_000, "en", "s"), (3, "ab" * 70_000 + " c", "en", "s")]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(table(spark, rows)).collect()}
    assert got == {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) for r in rows}


def test_token_counts(spark, library):
    rows = [(i, t, "en", "s") for i, t in enumerate([*TEXTS, None, "word " * 2049])]
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(table(spark, rows)).collect()}
    for i, t, _, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


def repeats_by_force(rows, length=200):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for r, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [2048, 2])
def test_repeats(spark, docs, bucket, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_RUNS", bucket)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    share, period = noise(450), noise(37) * 14
    rows = [*docs[0], (8000, noise(300) + share + noise(90), "en", "s"), (8001, noise(10) + share[:230] + noise(300), "en", "s"), (8002, period + noise(50), "en", "s"), (8003, "x" * 199, "en", "s"), (8004, "x" * 201, "en", "s"), (8005, noise(99) + share[30:229], "en", "s")]
    rows += [(8100 + k, noise(rng.randint(0, 200)) + share[k * 9 :] + noise(20), "en", "s") for k in range(12)]
    got = repeats.digests(repeats.remove_repeats(table(spark, rows))).collect()
    assert Counter(map(tuple, got)) == Counter(repeats_by_force(rows))


def test_no_built_text_is_taken_for_a_repeat(spark):
    """Blocks of one head, which is every window's least k-gram, with letters in an order on which sums of powers cancel."""
    rng = random.Random(5)
    heads = np.array([rng.choices(range(97, 123), k=32) for _ in range(40_000)], np.uint8).ravel()
    sums = repeats.prefix_sums(heads)
    at = np.arange(0, len(heads), 32)
    best = at[np.argmin(repeats.hashes(sums, at, 32))]
    head = bytes(heads[best : best + 32]).decode()
    middles = ["".join(rng.choices("abcdefghijklmnop", k=31)) for _ in range(128)]
    texts = ["".join(head + m + x for m, x in zip(middles, thue_morse(128, letters), strict=True)) for letters in ("ab", "ba")]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = repeats.digests(repeats.remove_repeats(table(spark, rows))).collect()
    assert Counter(map(tuple, got)) == Counter(repeats_by_force(rows)) and all(r["n_removed"] == 0 for r in got)


def test_a_large_bucket_is_sorted_in_portions(monkeypatch):
    monkeypatch.setattr(repeats, "SORTED_BYTES", 3000)
    rng = random.Random(3)
    base = bytes(rng.choices(range(97, 101), k=700))
    pieces = []
    for _ in range(90):
        a = rng.randrange(400)
        piece = bytearray(base[a : a + rng.randint(200, 300)])
        if rng.random() < 0.7:
            piece[rng.randrange(len(piece))] = rng.randrange(97, 101)
        pieces.append((bytes(piece), rng.random() < 0.8, rng.random() < 0.1))
    rows = [(7, i, None, None, None, 10, 0, need, piece) for i, (piece, need, _) in enumerate(pieces)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 13], strict=True), repeats.SENT_TYPES, strict=True)], repeats.SENT_NAMES) for k in range(0, 90, 13)]
    got = defaultdict(set)
    for out in repeats._sort(iter(batches)):
        for r in out.to_pylist():
            got[r["gid"]] |= set(range(r["s"] - 10, r["e"] - 9))
    seen = Counter(p[i : i + 200] for p, _, _ in pieces for i in range(len(p) - 199))
    want = {i: {k for k in range(len(p) - 199) if seen[p[k : k + 200]] > 1} for i, (p, need, _) in enumerate(pieces) if need}
    # of a string met in an earlier portion the first one is told when the next one comes
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in want.items() if s}


def test_equal_strings_are_found_beside_strings_with_an_equal_first_part():
    """Strings that differ in their last bytes alone, at places with all remainders."""
    rng = random.Random(16)
    texts = [b"b" * rng.randint(169, 230) + bytes(rng.choices(b"abc", k=rng.randint(0, 40))) for _ in range(60)]
    texts += [t + b"c" for t in texts[:20]]
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([np.arange(e - len(t), e - 199) for t, e in zip(texts, ends, strict=True)])
    seen = Counter(data[s : s + 200] for s in starts.tolist())
    dup, first = suffixes.repeated(np.frombuffer(data + bytes(8), np.uint8), starts, np.zeros(len(starts), np.int64))
    assert dup.tolist() == [seen[data[s : s + 200]] > 1 for s in starts.tolist()]
    assert sorted(data[s : s + 200] for s in starts[first].tolist()) == sorted(seen)


def test_rows_with_one_number_are_told_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats.Repeats, "clashes", lambda self, ids: [r["gid"] for r in ids.collect()[::2]])
    got = repeats.digests(repeats.remove_repeats(docs[1])).collect()
    assert Counter(map(tuple, got)) == Counter(repeats_by_force(docs[0]))


def test_what_is_kept_and_where_the_rest_was(spark, docs):
    text = {(r[0], r[1]): (r[1] or "").encode() for r in docs[0]}
    for r in repeats.remove_repeats(docs[1]).collect():
        data = [t for (i, _), t in text.items() if i == r["doc_id"] and len(t) == r["n_bytes"]]
        gone = [range(x["start"], x["end"]) for x in r["spans"]]
        assert any(bytes(r["kept"]) == bytes(b for k, b in enumerate(d) if not any(k in g for g in gone)) for d in data)


def test_suffix_sort_with_difference_cover():
    cover = suffixes.difference_cover()
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 6000, dtype=np.uint8)
    data[1000:1400] = data[100:500]
    data[3003:3303] = data[150:450]
    data[5000:5600] = np.tile(data[5000:5030], 20)
    starts = np.arange(0, 5700)
    bucket = rng.integers(0, 2, len(starts))
    seen = Counter((b, data[s : s + 200].tobytes()) for s, b in zip(starts, bucket, strict=True))
    want = [seen[b, data[s : s + 200].tobytes()] > 1 for s, b in zip(starts, bucket, strict=True)]
    assert suffixes.repeated(np.concatenate([data, np.zeros(208, np.uint8)]), starts, bucket)[0].tolist() == want


def filled(sizes, share=Fraction(3, 2), most=2):
    """Targets by pouring: what is over a cap goes back, and is shared again by weight among the others."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), order, {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets_fill_up(spark):
    rng = random.Random(17)
    tables = [{"a": 10, "b": 100, "c": 100, None: 0}, {None: 0}, {"z": 5}, {}, {"\U0001f600": 3, "\uffff": 4, "A": 9, "a": 2}]
    tables += [{f"s{k}": rng.choice([0, 1, 7, 50, 5000]) for k in range(rng.randint(1, 12))} for _ in range(6)]
    for sizes in tables:
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, words long")).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) < 1e-6 for s in want)


def mixed_by_force(rows):
    """The queue in exact fractions: finish times of two rounds in one line, cut at the budget."""
    sizes, by = Counter(), defaultdict(list)
    for k, (i, text, _, source) in enumerate(rows):
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        by[source].append((hashlib.md5(f"{'' if i is None else i}:7:{text or ''}".encode()).hexdigest(), k, n))
    target, line, taken = filled(sizes), [], Counter()
    for source, queue in by.items():
        upto = 0
        for _, k, n in sorted(queue):
            upto += n
            line += [(Fraction(upto + r * sizes[source]) / target[source], n, k) for r in (0, 1) if n and target[source]]
    spent = 0
    for f in sorted({x[0] for x in line}):
        now = [x for x in line if x[0] == f]
        spent += sum(x[1] for x in now)
        if spent > Fraction(3, 2) * sum(sizes.values()):
            break
        for _, n, k in now:
            taken[k] += n
    return Counter((r[0], len(WORD.findall(r[1] or "")), sizes[r[3]], round(float(target[r[3]]), 6), taken[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("copies", [4096, 3])
def test_mixing_by_force(spark, docs, copies, monkeypatch):
    monkeypatch.setattr(common, "COPIES", copies)
    monkeypatch.setattr(mixing, "RUN_ROWS", 9)
    rows = [*docs[0], *[(31, "the same row again and again", "en", "s1")] * 40]
    got = mixing.mix(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == mixed_by_force(rows)


@pytest.mark.parametrize("run_rows", [4096, 4])
def test_mixing(spark, docs, run_rows, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", run_rows)
    rows, df = docs
    got = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert 1.5 * total - 2 * most * 5 <= sum(r["taken"] for r in got) <= 1.5 * total
    source = defaultdict(int)
    for r in got:
        source[r["source_size"], r["target"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken - target) <= 3 * most for (_, target), taken in source.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    mixed = mixing.mixed_documents(df)
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_chat(spark):
    rng = random.Random(9)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice([None, "", "</s>[INST] ok [/INST]", "\\<s>[user]\n", "plain words " * rng.randint(1, 60), "😀\n"])))
    rows += [(None, 0, "assistant", "n"), (3, 0, None, "tie"), (50, 0, "assistant", "long " * 4000)]
    rows += [(60, None, "user", "b"), (60, None, "assistant", None), (60, None, "assistant", "a"), (60, None, "user", "b"), (-7, 0, "user", "here before")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_conversations(chat.with_probe(df), chat.Budget(tokens=200)).cache()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    conv = defaultdict(list)
    for r in [*rows, *chat.PROBE]:
        conv[r[0]].append((-1 if r[1] is None else r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
    assert set(got) == set(conv)
    for c, turns in conv.items():
        turns = [(x[2], x[4]) for x in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = [w for w in windows.collect() if w["window"] > 0]
    assert many and all(w["n_tokens"] <= 200 or (w["n_turns"], w["repeated"]) == (1, 0) for w in windows.collect())
    assert any(w["repeated"] > 0 for w in many)


def windows_by_model(sizes, system, budget, history=4):
    """(turns, repeated turns, tokens) of the windows: cut before a turn that no longer fits; then the system turn and the latest history, as far as they fit with it."""
    out, i = [], 0
    while i < len(sizes):
        again = []
        if i:
            room = budget - sizes[i]
            if system and sizes[0] <= min(budget / 2, room):
                again, room = [0], room - sizes[0]
            latest, room = [], min(room, budget / 4)
            for j in range(i - 1, max(i - 1 - history, 0 if system and sizes[0] <= budget / 2 else -1), -1):
                if sizes[j] > room:
                    break
                latest, room = [j, *latest], room - sizes[j]
            again += latest
        total, j = sum(sizes[x] for x in again), i
        while j < len(sizes) and (j == i or total + sizes[j] <= budget):
            total, j = total + sizes[j], j + 1
        out.append((list(range(i, j)), again, total))
        i = j
    return out


def test_windows_stay_within_the_budget(spark, library):
    rng = random.Random(19)
    rows, budget = [], 300
    for c in range(40):
        for t in range(rng.randint(1, 25)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "[x]"])
            rows.append((c, t, role, f"{c} {t} " + rng.choice(["word ", "</s>[INST] ", "\\ "]) * rng.choice([1, 5, 20, 60, 140])))
    rows += [(99, t, "system" if t == 0 else "user", f"{t} " + "word " * n) for t, n in enumerate([100, 165, 260, 260, 290, 400, 10])]
    got = defaultdict(list)
    for w in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.Budget(tokens=budget)).collect():
        got[w["conv_id"]].append(w)
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    for c, windows in got.items():
        turns = [(r[2], r[3]) for r in sorted(r for r in rows if r[0] == c)]
        sizes = [count(chat.formatted(*t)[0]) for t in turns]
        want = windows_by_model(sizes, turns[0][0] == "system", budget)
        windows = sorted(windows, key=lambda w: w["window"])
        assert [(w["n_turns"], w["repeated"], w["n_tokens"]) for w in windows] == [(len(a), len(b), n) for a, b, n in want]
        for w, (new, again, n) in zip(windows, want, strict=True):
            assert chat.parsed(w["text"]) == [turns[j] for j in [*again, *new]] and count(w["text"]) == n
            assert n <= budget or (len(new) == 1 and not again)


def test_many_system_turns_stay_within_the_budget(spark):
    rows = [(1, t, "system", f"rule {t} " + "w " * 58) for t in range(60)] + [(1, 60 + t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(40)]
    rows += [(2, 0, "system", "long " * 700)] + [(2, t, "assistant", "word " * 300) for t in range(1, 30)]
    rows += [(3, 0, "system", "short")] + [(3, t, "assistant", "word " * 300) for t in range(1, 30)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(w["n_tokens"] <= 1024 for w in windows)
    size = Counter()
    for w in windows:
        size[w["conv_id"]] += len(w["text"])
    for c in (1, 2, 3):
        assert size[c] < 2 * sum(len(r[3]) + 30 for r in rows if r[0] == c)
    repeated = {c: [chat.parsed(w["text"])[0] for w in windows if w["conv_id"] == c and w["window"] > 0] for c in (2, 3)}
    assert repeated[3] and all(x == ("system", "short") for x in repeated[3])
    assert repeated[2] and all(x[0] == "assistant" for x in repeated[2])


def test_top_k(spark):
    rng = random.Random(12)
    rows = [(i, [rng.choice([0.5, -0.25, 0.1, 0.003]) for _ in range(6)]) for i in range(130)]
    rows += [(200, None), (201, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (250, rows[0][1]), (300, rows[0][1]), (301, rows[0][1]), (350, [1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, a in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole.items() if i != q and len(a) == len(b))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert {tuple(r) for r in topk.search(df).collect()} == want


def test_top_k_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_TILE", 7)
    monkeypatch.setattr(topk, "MOST_TILE", 7)
    rng = random.Random(13)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() ** 6 * 9 for _ in range(5)]) for i in range(100)] + [(-50, []), (-51, []), (-52, []), (700, [0.5]), (701, [0.25])]
    rows += [rows[3]] * 9
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q, a in {x[0]: x for x in whole if x[0] % 50 == 0}.values():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_refuses_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [3e16]), (1, [3e16]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="2\\^60"):
        topk.search(df)
    near = spark.createDataFrame([(0, [2.0**21]), (1, [-(2.0**21)]), (50, [2.0**21])], "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in topk.search(near).collect()} == {(0, 50, 2**58), (0, 1, -(2**58)), (50, 0, 2**58), (50, 1, -(2**58))}


@pytest.mark.parametrize(
    "run",
    [jaccard.near_duplicates, jaccard.without_near_duplicates, sharding.shard_documents, secrets.scan, secrets.mask_documents, quality.score, quality.keep, token_counts.count_tokens, repeats.remove_repeats, mixing.mix, mixing.mixed_documents, bpe.digests, bpe.encode_documents],
)
def test_empty_table(spark, run):
    assert run(table(spark, [])).count() == 0


def test_empty_others(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
