"""Packing, whitening and hard negatives against brute force, with nulls, empties, ties, repeats and clashing columns."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import negatives, packing, whitening
from quillon.llm.queries import QUERIES


@pytest.fixture(scope="module", autouse=True)
def case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.unset("spark.sql.caseSensitive")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


# --- packing


@pytest.mark.parametrize("full", [1, 2, 8, 1024])
def test_pieces_are_the_bits_of_a_length(full):
    sizes = np.array([*range(1, 40), 1023, 1024, 1025, 5000])
    lengths, doc = packing.piece_lengths(sizes, full)
    for i, n in enumerate(sizes):
        own = lengths[doc == i].tolist()
        rest = int(n) % full
        assert own == [full] * (int(n) // full) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def texts():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> and <|endoftext|>"), (None, "no id"), (None, "no id"), (5, "é😀中\x00\n\n x"), (6, "word " * 5000), (7, " " * 300_000), (8, "x" * 50_000), (5, "again"), (9, "don't we'll 12345 \t\n  end  ")]
    return [*rows, *[(100 + i, "".join(rng.choice("ab c.\n1é'") for _ in range(rng.randint(0, 300)))) for i in range(150)]]


@pytest.mark.parametrize("full", [16, 1024])
def test_packing(spark, library, full, monkeypatch):
    monkeypatch.setattr(packing, "BATCH", 64)
    rows = texts()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, TEXT string, task int, length int").repartition(5)
    got = packing.pack(df, full).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    by_number = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_number] == sorted((r["length"] for r in got), reverse=True)
    assert all(r["length"] <= full and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] for r in got)
    have, want = defaultdict(int), defaultdict(int)
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        lengths, _ = packing.piece_lengths(np.array([len(ids)]), full)
        at = 0
        for n in lengths.tolist():
            want[i, at, n, ids[at : at + n].tobytes(), len(ids)] += 1
            at += n
    for r in got:
        have[r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]] += 1
    assert have == want
    sums = {(r["sequence_id"], r["ids_crc32"]) for r in packing.digests(packing.pack(df, full)).collect()}
    assert {c for _, c in sums} == {zlib.crc32(k[3]) for k in want}


def test_a_shuffled_numbering_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(4, "doc_id")
    monkeypatch.setattr("quillon.llm.common.MOST_KEYS", 0)
    got = packing.pack(df).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))


def test_other_vocabularies_go_to_the_library(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.Encoder(path).ranked is None and packing.Encoder(packing.default_vocabulary()).ranked is not None
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(path).encode("Some words here", add_special_tokens=False).ids) + 1
    got = packing.pack(spark.createDataFrame([(1, "Some words here")], "doc_id long, text string"), 8, path).collect()
    assert sum(r["length"] for r in got) == want == got[0]["doc_tokens"]
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1000)


def test_query_covers_every_token(spark, sf, library):
    got = QUERIES["op11_packing"](spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n"], r["m"]) for r in got} == {i: (len(library.encode(t, add_special_tokens=False).ids) + 1,) * 2 for i, t in docs.items()}


# --- whitening


def whitened_by_force(rows, k=16):
    """By numpy's eigensolver on the whole covariance: (vec_id, deviation, row) lists, eigenvalues, trace, n."""
    x = [(i, np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    every = np.unique(np.array([v for _, v in x]), axis=0)
    n, s = len(every), every.sum(axis=0)
    c = (n * every - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return [(i, int(((n * v - s) ** 2).sum()), (n * v - s) / n @ (u[:, :k] / np.sqrt(e[:k]))) for i, v in x], e, e.sum(), n


def check_whitening(got, rows, k):
    want, e, trace, n = whitened_by_force(rows, k)
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, found in by.items():
        assert abs(found[0]["explained"] / (e[c - 1] / trace) - 1) < 1e-9 and {r["n"] for r in found} == {n} and found[0]["identity_error"] < 1e-9
        have = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]) for r in found)
        force = sorted((i if i is not None else -1, d, w[c - 1]) for i, d, w in want)
        assert [h[:2] for h in have] == [f[:2] for f in force]
        a, b = np.array([h[2] for h in have]), np.array([f[2] for f in force])
        assert min(np.abs(np.sort(a) - np.sort(b)).max(), np.abs(np.sort(a) - np.sort(-b)).max()) < 1e-6


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, dims)) * np.linspace(0.2, 1, dims))]


def test_whitening(spark):
    rows = vectors(300, 20)
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[1][1]), (901, None), (902, [float("nan")] * 20), (903, [None] * 20), (904, [float("inf")] * 20)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, EMBEDDING string").repartition(6)
    check_whitening(whitening.whiten(df).collect(), rows, 16)


def test_an_offset_of_a_million_loses_nothing(spark):
    rows = [(i, [1e6 + v for v in x]) for i, x in vectors(200, 6)]
    check_whitening(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 6)


def test_low_ranks_and_odd_spaces(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).collect() == []
    line = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame([*line, (20, [1.0]), (21, [3.0]), (22, [1e300])], schema)).collect()
    assert {(r["component"], r["vec_id"] >= 20) for r in got} == {(1, False), (1, True)}
    assert len(got) == 11 and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert sorted(round(r["whitened"] ** 2, 9) for r in got if r["vec_id"] >= 20) == [1.0, 1.0]


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2**30 * (i % 7)), float(i)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {i: d for i, d, _ in whitened_by_force(rows, 2)[0]}
    assert all(r["deviation"] is None or r["deviation"] == want[r["vec_id"]] for r in got) and any(r["deviation"] is None for r in got)


@pytest.mark.parametrize("block, columns", [(8, 64), (4, 1000), (64, 256)])
def test_close_eigenvalues_are_certified(block, columns, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_COLUMNS", columns)
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.concatenate([1 + np.arange(20)[::-1] * 1e-3, np.linspace(0.99, 0, 100)])
    matrix = (q * values) @ q.T
    products = []
    e, u, residuals, passes = whitening.subspace_iteration(lambda x: products.append(x.shape) or matrix @ x, 120, 4, block)
    assert passes == len(products) and residuals.max() <= 1e-13
    assert np.abs(e - values[:4]).max() < 1e-12 and np.abs(np.abs(u.T @ q[:, :4]) - np.eye(4)).max() < 1e-9


# --- hard negatives


def mined_by_force(rows, every=100, noisy=7):
    good = [(i, (y + 1) % 10 if i % noisy == 0 else y, [int(np.floor(256 * c)) for c in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = defaultdict(int)
    for a in {r[0]: r for r in reversed(good) if r[0] % every == 0}.values():
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in good if r[0] != a[0] and len(r[2]) == len(a[2]))
        for p in [s for s in scored if s[2] == a[1]][:5]:
            window = [s for s in scored if s[2] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            for rank, s in enumerate(window, 1):
                out[a[0], p[1], rank, s[1], -p[0], -s[0]] += 1
    return out


def labelled_rows(n=500, dims=8, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    return [(i, (centres[i % 6] + 0.5 * rng.standard_normal(dims)).round(2).tolist(), int(rng.integers(0, 4) if i % 3 else 1)) for i in range(n)]


def counted(df):
    out = defaultdict(int)
    for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect():
        out[tuple(r)] += 1
    return out


SCHEMA = "vec_id long, embedding array<double>, label int, tile int, LABEL string"


@pytest.mark.parametrize("tile, pivots", [(1 << 17, 16), (40, 16), (40, 1)])
def test_hard_negatives(spark, tile, pivots, monkeypatch):
    for name, value in {"MOST_TILE": tile, "LEAST_TILE": min(tile, 1024), "STRETCH": 16, "ANCHOR_ROWS": 3}.items():
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives, "MOST_ANCHORS", 3 if tile == 40 else 1 << 17)
    plain = negatives.choose
    monkeypatch.setattr(negatives, "choose", lambda rows: plain(rows, pivots, 50))
    rows = labelled_rows()
    copy = rows[300][1]
    rows += [(700 + i, copy, i % 3) for i in range(60)]  # ties among labels, and with an anchor
    rows += [(None, copy, 1), (1000, None, 1), (1100, copy, None), (1200, [None] * 8, 1), (1300, [float("nan")] * 8, 1), (1400, [1.0, 2.0], 1), (1401, [1.0, 2.0], 1), (1402, [1.0, 1.9], 2), (1500, [], 0), (1501, [], 0), (1502, [], 3), (1600, [0.0] * 8, 9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got, want = counted(negatives.mine_table(df)), mined_by_force(rows)
    assert got == want and len({k[0] for k in got}) > 6


def test_repeated_rows_count_each(spark):
    rows = [(0, [1.0, 0.0], 0), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [0.9, 0.0], 2), (5, [0.9, 0.0], 2), (0, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = negatives.mine_table(df).collect()
    assert len(got) == 4 and {(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in got} == {(0, 3, 5)}


def test_brackets_hold_the_scores():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-200, 200, (300, 12)), rng.integers(-200, 200, (20, 12))
    top = float((x**2).sum(axis=1).max())
    pivots = negatives.Pivots(top, {12: x[:8].astype(float)})
    near, asked = pivots.distances(x, False), pivots.distances(q, True)
    a = object.__new__(negatives.Anchors)
    a.near, a.square = asked, (q.astype(float) ** 2).sum(axis=1) + top
    under, over = a.bracket(np.arange(20), near, near)
    score = q @ x.T
    assert (under <= score).all() and (score <= over).all()
    under, over = a.bracket(np.arange(20), near.min(axis=0)[None], near.max(axis=0)[None])
    assert (under[:, 0] <= score.min(axis=1)).all() and (score.max(axis=1) <= over[:, 0]).all()


def test_close_rows_are_bracketed_away():
    """On rows in clusters most are settled by their stored distances alone."""
    rng = np.random.default_rng(9)
    centres = rng.integers(-2000, 2000, (8, 16))
    x = centres[np.arange(4000) % 8] + rng.integers(-20, 20, (4000, 16))
    pivots = negatives.Pivots(float((x**2).sum(axis=1).max()), {16: centres.astype(float)})
    near = pivots.distances(x, False)
    a = object.__new__(negatives.Anchors)
    a.near, a.square = pivots.distances(x[:8], True), (x[:8].astype(float) ** 2).sum(axis=1) + pivots.top
    fifth = np.sort(x[:8] @ x.T, axis=1)[:, -5]
    over = a.bracket(np.arange(8), near, near)[1]
    assert (over >= fifth[:, None]).mean() < 0.3


def test_refuses_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [3e8], 1, 1, "x"), (1, [1.0], 1, 1, "x")], SCHEMA)
    with pytest.raises(ValueError, match="2\\^60"):
        negatives.mine_table(df)


def test_empty_tables(spark):
    assert negatives.mine_table(spark.createDataFrame([], SCHEMA)).collect() == []
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
