"""DuckDB twins of the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

import math

from quillon.llm.quality import CHANCE, FENCE, GAMMA, HALF_ROWS, LEAST, RULES

WORD = r"[^\x20\x09-\x0D]"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0e0 END"


RATIOS = {
    "symbol_ratio": _ratio("n_symbols", "word_chars"),
    "upper_ratio": _ratio("n_upper", "word_chars"),
    "mark_ratio": _ratio("n_marks", "n_words"),
    "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    "repeat_ratio": _ratio("n_repeat_words", "n_words"),
    "word_len": _ratio("word_chars", "n_words"),
}


def _weighed(rows: str, own: str, rest: str) -> str:
    return f"(({rows} * {own} + {HALF_ROWS} * ({rest})) / ({rows} + {HALF_ROWS}))"


def _quantiles(name: str, *by: str) -> str:
    """mid, high and rows of every group and rule, from bins that add up."""
    keys = "".join(f"{b}, " for b in by)
    level = " ".join(f"WHEN '{r}' THEN {q!r}e0" for r, (q, _) in RULES.items())
    return f"""
        {name} AS (
            SELECT {keys}rule, max(n) AS n, min(CASE WHEN upto >= 0.5e0 * n THEN value END) AS mid, min(CASE WHEN upto >= CASE rule {level} END * n THEN value END) AS high
            FROM (
                SELECT *, sum(c) OVER (PARTITION BY {keys}rule ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY {keys}rule) AS n,
                       coalesce(2e0 * pow({GAMMA!r}, bin) / {GAMMA + 1!r}, 0e0) AS value
                FROM (SELECT {keys}rule, bin, CAST(count(*) AS DOUBLE) AS c FROM bins GROUP BY ALL)
            ) GROUP BY ALL
        )"""


def quality_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {r} AS x FROM ratios WHERE NOT base_failed" for r in RULES)
    mid, high = (_weighed("o.n", f"o.{q}", _weighed("l.n", f"l.{q}", f"a.{q}")) for q in ("mid", "high"))
    tops = ", ".join(f"max(CASE WHEN rule = '{r}' THEN top END) AS top_{r}" for r in RULES)
    ok = " AND ".join(f"{r} <= top_{r} + {CHANCE!r}e0 * sqrt(greatest(top_{r} * {size}, 1e0)) / greatest({size}, 1)" for r, (_, size) in RULES.items())
    return f"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
        ), split AS (
            SELECT rid, doc_id, lang, source, regexp_extract_all(text, '{WORD}+') AS words,
                   [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper
            FROM d
        ), windows AS (
            SELECT rid, i, words[i:i + 4] AS w FROM split, unnest(range(1, len(words) - 3)) AS t(i)
        ), again AS (
            SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows) WHERE c > 1
        ), covered AS (
            SELECT rid, CAST(sum(least(5, i - coalesce(before, i - 5))) AS BIGINT) AS n FROM again GROUP BY rid
        ), counts AS (
            SELECT s.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, len(lines) AS n_lines,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM split s LEFT JOIN covered c ON c.rid = s.rid
        ), ratios AS (
            SELECT *, {", ".join(f"{sql} AS {r}" for r, sql in RATIOS.items())}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
        ), bins AS (
            SELECT lang, source, rule, CASE WHEN x > {LEAST!r} THEN CAST(ceil(ln(x) / {math.log(GAMMA)!r}) AS INTEGER) END AS bin FROM ({rules})
        ), {_quantiles("own", "lang", "source")}, {_quantiles("by_lang", "lang")}, {_quantiles("every")},
        fences AS (
            SELECT lang, source, {tops} FROM (
                SELECT o.lang, o.source, o.rule, {high} + {FENCE!r} * ({high} - {mid}) AS top
                FROM own o JOIN by_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rule = o.rule JOIN every a ON a.rule = o.rule
            ) GROUP BY lang, source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {ok}, NOT base_failed) AS kept
        FROM ratios r LEFT JOIN fences f ON f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source
    """


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0
        ), sets AS (
            SELECT rid, md5(string_agg(s, chr(10) ORDER BY s)) AS node, CAST(count(*) AS BIGINT) AS n FROM shingles GROUP BY rid
        ), nodes AS (
            SELECT s.node, min(s.n) AS n, min(d.doc_id) AS least, min(s.rid) AS rid FROM sets s JOIN d ON d.rid = s.rid GROUP BY s.node
        ), held AS (
            SELECT n.node, n.n, s.s FROM nodes n JOIN shingles s ON s.rid = n.rid
        ), shared AS (
            SELECT a.node AS a, b.node AS b, a.n + b.n AS total, count(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.node < b.node GROUP BY ALL
        ), edges AS (
            SELECT a, b FROM shared WHERE 100 * c >= 75 * (total - c) UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 75 * (total - c)
        ), reach AS (
            SELECT node, node AS other FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other
        ), comps AS (
            SELECT r.node, min(n.least) AS component_id FROM reach r JOIN nodes n ON n.node = r.other GROUP BY r.node
        )
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.node IS NULL THEN d.doc_id ELSE c.component_id END AS component_id
        FROM d LEFT JOIN sets s ON s.rid = d.rid LEFT JOIN comps c ON c.node = s.node
    """,
    "op6_suffix_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), starts AS (
            SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM d, unnest(range(0, length(h) // 2 - 199)) AS t(i) WHERE length(h) >= 400
        ), again AS (
            SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS c FROM starts) WHERE c > 1
        ), numbered AS (
            SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM again
        ), spans AS (
            SELECT rid, span, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY rid, span
        ), pieces AS (
            SELECT s.rid, s.a, s.b, substr(d.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.rid ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.rid ORDER BY s.a), 0))) AS piece
            FROM spans s JOIN d ON d.rid = s.rid
        ), kept AS (
            SELECT rid, string_agg(piece, '' ORDER BY a) AS head, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM pieces GROUP BY rid
        )
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN kept k ON k.rid = d.rid
    """,
    "op4_quality_rules": quality_sql(),
    "op7_mixing": """
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7:' || coalesce(text, '')) AS h
            FROM documents
        ), ranked AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source
        ), weighed AS (
            SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 2e0 * words AS cap FROM ranked
        ), levels AS (
            SELECT *, cap / weight AS ratio,
                   (1.5e0 * (SELECT CAST(sum(words) AS BIGINT) FROM ranked) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
                   / sum(weight) OVER (ORDER BY cap / weight, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed
        ), targets AS (
            SELECT source, words, coalesce(least(cap, weight * (SELECT level FROM levels WHERE level * weight < cap ORDER BY ratio, rn LIMIT 1)), cap) AS target FROM levels
        ), placed AS (
            SELECT doc_id, size, words, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
            FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
        ), line AS (
            SELECT size, (upto + r * words) / target AS f FROM placed, (VALUES (0), (1)) AS rounds(r) WHERE size > 0 AND target > 0
        ), cut AS (
            SELECT coalesce(max(f), 0e0) AS f FROM (SELECT f, sum(size) OVER (ORDER BY f) AS run FROM line) WHERE run <= 1.5e0 * (SELECT sum(size) FROM d)
        )
        SELECT doc_id, size, words AS source_size, target,
               CAST(CASE WHEN target > 0 THEN size * ((upto / target <= cut.f)::INT + ((upto + words) / target <= cut.f)::INT) ELSE 0 END AS BIGINT) AS taken
        FROM placed, cut
    """,
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same
        ), r AS (
            SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND nth <= 5 AND 80 * positive_score <= 100 * score AND score <= positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
    """,
}
