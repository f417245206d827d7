"""Secrets, shards and the pipeline against plain loops that share no code with them."""

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillon.llm import secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def words(text):
    return WORD.findall(text)


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows):
    """A number for the group of each row."""
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def filled(sizes):
    """Targets by pouring: what is over twice a size goes back, and is shared again by weight."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), order, {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def assigns(text):
    """The pattern as a small machine: a name, an optional quote, spaces, a mark, spaces, an optional quote, a value."""
    out, i, low = [], 0, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while i < len(text):
        name = next((n for n in NAMES if low.startswith(n, i)), None)
        end = None
        if name:
            j = i + len(name)
            j += j < len(text) and text[j] in "\"'"
            while j < len(text) and text[j] == " ":
                j += 1
            if j < len(text) and text[j] in ":=":
                j += 1
                while j < len(text) and text[j] == " ":
                    j += 1
                j += j < len(text) and text[j] in "\"'"
                k = j
                while k < len(text) and text[k] in VALUE:
                    k += 1
                if k > j:
                    end = k
        if end is None:
            i += 1
            continue
        if end - j >= 6:
            out.append((i, end, "assign"))
        i = end
    return out


def stretches(text, letters):
    out, start = [], None
    for i, c in enumerate(text + "\0"):
        if c in letters and start is None:
            start = i
        elif c not in letters and start is not None:
            out.append((start, i))
            start = None
    return out


def accesses(text):
    out, i, more = [], 0, set(string.ascii_uppercase + string.digits)
    while i < len(text):
        if text.startswith("AKIA", i):
            j = i + 4
            while j < len(text) and text[j] in more:
                j += 1
            if j > i + 4:
                if j - i >= 20:
                    out.append((i, j, "access"))
                i = j
                continue
        i += 1
    return out


def base(text):
    hexes = [(a, b, "hex") for a, b in stretches(text, set("0123456789abcdef")) if b - a >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(assigns(text) + accesses(text) + hexes, key=lambda x: (x[0], order[x[2]], x[1]))


def entropies(text, rule, allowed):
    """Every window's entropy from fresh counts, against the bits of the class of its own characters."""
    out, hexes = [], set(string.hexdigits)
    digits, letters = set(string.digits), set(string.ascii_letters)

    def bits(piece):
        if all(c in hexes for c in piece):
            return rule.hex_bits
        return rule.alnum_bits if all(c in digits | letters for c in piece) else rule.base64_bits

    for a, b in stretches(text, letters | digits | set("+/_=-")):
        whole, marked = text[a:b], set()
        if b - a < rule.window or not set(whole) & digits or not set(whole) & letters or allowed(whole):
            continue
        for i in range(len(whole) - rule.window + 1):
            w = whole[i : i + rule.window]
            mixed = set(w) & digits and set(w) & letters
            need = bits(w) if mixed else bits(whole)
            if -sum(n / rule.window * math.log2(n / rule.window) for n in Counter(w).values()) >= need - 1e-12:
                marked |= set(range(a + i, a + i + rule.window))
        out += [(x, y) for x, y in spans(marked) if not allowed(text[x:y])]
    return out


def spans(places):
    out = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def random_text(rng):
    parts = ["token", "API_key", "apikey", "PassWord", "secret", " ", "  ", "=", ":", '"', "'", "AKIA", "akia", "\n", "é", "-", "/", "==", "_"]
    pools = ["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase, "01", VALUE_LIST]
    out = []
    for _ in range(rng.randint(0, 30)):
        out.append(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choices(rng.choice(pools), k=rng.randint(1, 40))))
    return "".join(out)


VALUE_LIST = "".join(sorted(VALUE))


def allowed_by(rule):
    pattern = re.compile("|".join(rule.allow))
    return lambda s: pattern.fullmatch(s) is not None


def test_secrets_by_force(spark):
    rng, rule = random.Random(21), secrets.Entropy()
    rows = [(i, random_text(rng)) for i in range(700)] + [(900, None), (901, "")]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter()
    for i, text in rows:
        text = text or ""
        b = base(text)
        wrote = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k in xs)
        assert got[i]["base_sha256"] == hashlib.sha256(wrote(b).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in b) for k in ("assign", "access", "hex")]
        order = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
        more = [(s, e, "entropy") for s, e in entropies(text, rule, allowed_by(rule))]
        assert got[i]["spans"] == wrote(sorted(b + more, key=lambda x: (x[0], order[x[2]], x[1]))), text
        found.update(x[2] for x in b + more)
    assert all(found[k] > 20 for k in ("assign", "access", "hex", "entropy"))


def test_shards_get_near_equal_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    load, slots, where = Counter(), Counter(), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["virtual_slot"]] += r["size"]
        where[r["virtual_slot"]].add(r["shard"])
    assert set(load) == set(range(24)) and all(len(x) == 1 for x in where.values())
    # each slot went to the emptiest shard, largest first
    emptiest = Counter({s: 0 for s in range(24)})
    for _, slot in sorted((-n, s) for s, n in slots.items()):
        shard = min(emptiest, key=lambda s: (emptiest[s], s))
        assert where[slot] == {shard}
        emptiest[shard] += slots[slot]
    assert max(load.values()) - min(load.values()) <= max(slots.values())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(33)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 60, 120])))
        if i % 9 == 0 and i:
            text = rows[-4][1].replace(vocabulary[1], "other")
        if i % 8 == 0:
            text += " token = " + "".join(rng.choices(string.ascii_letters + string.digits, k=30))
        if i % 13 == 0:
            text = "$$$ !!! " * 30 + text
        rows.append((i if i % 17 else None, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), len(text)))
    rows += [rows[3], rows[3], (7, "another text of the same number " * 3, "en", "a", 10), (500, None, "en", "a", None), (501, "", None, None, 0), (502, " \n ", "en", "b", 3)]
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows, str(path)


def quality_by_force(rows):
    """Fences from log bins, blended over group, language and corpus."""
    gamma = 1.01 / 0.99
    tail = {"symbol": 0.9, "upper": 0.95, "mark": 0.9, "line": 0.99, "repeat": 0.99, "length": 0.95}
    feats = []
    for _, text, lang, source, _ in rows:
        text = text or ""
        w = words(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = len({i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)})
        lines = [x for x in text.split("\n") if words(x)]
        chars = sum(map(len, w))
        of = lambda a, b: a / b if b else 0.0
        ratio = {"symbol": of(sum(c in "#*$%&|<>" for c in text), chars), "upper": of(sum(c.isupper() for c in text), chars), "mark": of(sum(c in "!?" for c in text), len(w))}
        ratio |= {"line": of(len(lines) - len(set(lines)), len(lines)), "repeat": of(repeat, len(w)), "length": of(chars, len(w))}
        size = {"symbol": chars, "upper": chars, "mark": len(w), "line": len(lines), "repeat": len(w), "length": len(w)}
        feats.append((lang, source, ratio, size, len(w) < 10 or 100 * repeat > 20 * len(w)))

    passing = [f for f in feats if not f[4]]

    def quantile(some, rule, q):
        bins = sorted(-math.inf if f[2][rule] <= 1e-4 else math.ceil(math.log(f[2][rule]) / math.log(gamma)) for f in some)
        b = bins[math.ceil(q * len(bins)) - 1]
        return 0.0 if b == -math.inf else 2 * gamma**b / (gamma + 1)

    kept = []
    for row, (lang, source, ratio, size, failed) in zip(rows, feats, strict=True):
        group, tongue = [f for f in passing if f[:2] == (lang, source)], [f for f in passing if f[0] == lang]
        fine = not failed
        for rule in tail if fine else ():
            mid, high = (
                (len(group) * quantile(group, rule, p) + 20 * ((len(tongue) * quantile(tongue, rule, p) + 20 * quantile(passing, rule, p)) / (len(tongue) + 20))) / (len(group) + 20) for p in (0.5, tail[rule])
            )
            top = high + 2 * (high - mid)
            fine = fine and ratio[rule] <= top + 3 * math.sqrt(max(top * size[rule], 1)) / max(size[rule], 1) + 1e-12
        if fine:
            kept.append(row)
    return kept


def one_of_each_group(rows):
    groups, out = defaultdict(list), []
    for k, root in enumerate(near_groups(rows)):
        if words(rows[k][1] or ""):
            groups[root].append(rows[k])
        else:
            out.append(rows[k])
    null_last = lambda r: tuple((x is None, x) for x in r)
    return out + [min(g, key=lambda r: (r[0] is None, r[0] or 0, null_last(r[1:]))) for g in groups.values()]


def masked_by_force(rows):
    rule, out = secrets.Entropy(), []
    for i, text, lang, source, n in rows:
        if text is not None:
            gone = sorted((s, e) for s, e, *_ in base(text) + entropies(text, rule, allowed_by(rule)))
            new, at = [], 0
            for s, e in gone:
                if s >= at:
                    new += [text[at:s], "[SECRET]"]
                at = max(at, e)
            text = "".join([*new, text[at:]])
            n = len(text)
        out.append((i, text, lang, source, n))
    return out


def mixed_rows(rows):
    sizes, by, out, line = Counter(), defaultdict(list), [], []
    for k, (i, text, _, source, _) in enumerate(rows):
        sizes[source] += len(words(text or ""))
        by[source].append((hashlib.md5(f"{'' if i is None else i}:7:{text or ''}".encode()).hexdigest(), k))
    target = filled(sizes)
    for source, queue in by.items():
        upto = 0
        for _, k in sorted(queue):
            n = len(words(rows[k][1] or ""))
            upto += n
            line += [((upto + r * sizes[source]) / target[source], n, k) for r in (0, 1) if n and target[source]]
    spent = 0
    for f in sorted({x[0] for x in line}):
        now = [x for x in line if x[0] == f]
        spent += sum(x[1] for x in now)
        if spent > 1.5 * sum(sizes.values()):
            break
        out += [rows[k] for _, _, k in now]
    return out


def test_pipeline_by_force(spark, small):
    from quillon.llm.bpe import default_vocabulary
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    rows, path = small
    stages = [quality_by_force, one_of_each_group, masked_by_force, mixed_rows]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, run), plain in zip(corpus_pipeline.STAGES, stages, strict=False):
        docs = run(spark, docs, path)
        rows = plain(rows)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert Counter(map(tuple, docs.collect())) == Counter(rows), name
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert want and all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).filter(F.col("n_tokens") >= 0).count() == 0
