"""DuckDB twins of the queries."""

from __future__ import annotations

from quillon.plans import history_oracles

CALLS = """
    calls AS (
        SELECT user_id AS session_id, event_id AS call_id, epoch_us(ts) // 1000 AS created,
               CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'compress' ELSE 'bash' END AS tool,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status,
               event_type = 'click' AS step_start, json_extract_string(props, '$.k') AS path,
               CAST(floor(value) AS BIGINT) AS input, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cache_read,
               CAST(length(props) AS BIGINT) AS output, CAST(floor(value * 1e2) AS BIGINT) AS cost, props AS parameters,
               CASE WHEN event_type IN ('view', 'purchase') THEN 'tool-calls' WHEN event_type = 'click' THEN 'stop' ELSE 'other' END AS reason,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
        FROM events
    )"""
MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS seq, role, text FROM conversations)"
TURNS = """
    turns AS (
        SELECT *, CAST(sum(CAST(step_start AS INT)) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn,
               CAST(sum(CAST(step_start AS INT)) OVER (PARTITION BY session_id) AS BIGINT) AS now
        FROM calls
    )"""
DEDUP = """
    dedup AS (
        SELECT session_id, call_id, CAST(floor(length(parameters) / 4.0 + 0.5) AS BIGINT) AS token_count FROM (
            SELECT *, row_number() OVER (PARTITION BY session_id, tool, cache_read ORDER BY seq DESC) AS rn FROM calls
        ) WHERE rn > 1
    )"""
PURGE = "purge AS (SELECT session_id, call_id, now - turn AS age FROM turns WHERE status = 'error' AND now - turn >= 4)"
BLOCKS = """
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS block_id FROM calls WHERE tool = 'compress'
    ),
    blocks AS (
        SELECT session_id, block_id, seq AS created, seq AS anchor_seq, CASE WHEN block_id % 4 <> 1 THEN block_id - 1 END AS eats,
               call_id % 11 = 0 AS taken_back, call_id % 13 <> 0 AS present, input AS compressed_tokens
        FROM numbered
    )"""


def _active(source: str, name: str) -> str:
    return f"""
    {name} AS (
        SELECT c.*, c.present AND NOT c.taken_back AND NOT EXISTS (
            SELECT 1 FROM {source} b WHERE b.session_id = c.session_id AND b.eats = c.block_id AND b.present AND NOT b.taken_back
              AND (b.created > c.created OR (b.created = c.created AND b.block_id > c.block_id))
        ) AS active FROM {source} c
    )"""


ACTIVE = _active("blocks", "active")
REFS = "refs AS (SELECT session_id, seq, 'm' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS VARCHAR), 4, '0') AS ref FROM messages WHERE role IN ('user', 'assistant'))"
RANGES = """
    ranges AS (
        SELECT i.session_id, s.seq AS start_seq, e.seq AS end_seq,
               nullif(concat_ws(chr(10), CASE WHEN s.seq IS NULL THEN 'start: not found: m0002' END, CASE WHEN e.seq IS NULL THEN 'end: not found:  M0003' END), '') AS issues
        FROM (SELECT DISTINCT session_id FROM messages) i
        LEFT JOIN refs s ON s.session_id = i.session_id AND s.ref = 'm0002'
        LEFT JOIN refs e ON e.session_id = i.session_id AND e.ref = 'm0003'
    )"""
SESSIONS = """
    sessions AS (
        SELECT doc_id AS id, left(split_part(text, chr(10), 1), 60) AS title, source AS directory,
               CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id / 5 AS BIGINT) END AS parent_id, doc_id AS time_updated
        FROM documents
    )"""
ANCHORS = """
    pairs AS (
        SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS next FROM messages WHERE role IN ('user', 'assistant')
        WINDOW w AS (PARTITION BY session_id ORDER BY seq)
    ),
    anchors AS (SELECT session_id, seq, role FROM pairs WHERE (role = 'user' AND before = 'assistant') OR (role = 'assistant' AND next = 'user'))"""


def hit(read: str, fresh: str) -> str:
    return f"CASE WHEN {read} + {fresh} > 0 THEN floor(1e3 * ({read}) / ({read} + {fresh}) + 0.5e0) / 1e1 ELSE 0e0 END"


SUMS = "CAST(coalesce(sum(input), 0) AS BIGINT) AS sum_input, CAST(coalesce(sum(output), 0) AS BIGINT) AS sum_output, CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS sum_cache_read, CAST(coalesce(sum(cost), 0) AS BIGINT) AS sum_cost, count(*) AS steps"
DERIVED = f"*, sum_input + sum_output + sum_cache_read AS total, {hit('sum_cache_read', 'sum_input')} AS hit_rate"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _sum(x: str, name: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {name}"


NEXT = "SELECT *, lead(seq) OVER w AS next_seq, lead(input) OVER w AS next_input, lead(cache_read) OVER w AS next_cache_read FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY seq)"
DISTANCE = "dist AS (SELECT *, seq - max(CASE WHEN tool = 'compress' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS distance FROM calls)"
MEAN = "CASE WHEN calls > 0 THEN CAST(floor(({0} + {1}) / calls) AS BIGINT) ELSE 0 END"

ORACLE_SQL = {
    "distance_since_compress": with_(CALLS, DISTANCE) + "SELECT session_id, seq, distance FROM dist",
    "turn_counts": with_(CALLS) + "SELECT session_id, CAST(sum(CAST(step_start AS INT)) AS BIGINT) AS turns FROM calls GROUP BY 1",
    "call_turns": with_(CALLS, TURNS) + "SELECT session_id, call_id, turn FROM turns",
    "dedup_calls": with_(CALLS, DEDUP) + "SELECT * FROM dedup",
    "purge_errors": with_(CALLS, TURNS, PURGE) + "SELECT * FROM purge",
    "supersede_writes": with_(CALLS) + "SELECT session_id, call_id, path FROM calls w WHERE tool = 'write' AND EXISTS (SELECT 1 FROM calls r WHERE r.tool = 'read' AND r.session_id = w.session_id AND r.path = w.path AND r.seq > w.seq)",
    "eligible_calls": with_(CALLS, TURNS) + "SELECT session_id, call_id, turn FROM turns WHERE now - turn >= 2",
    "sweep_last_n": with_(CALLS, DEDUP, "ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM calls)")
    + "SELECT session_id, call_id FROM ranked WHERE rn <= 5 AND tool <> 'compress' AND call_id NOT IN (SELECT call_id FROM dedup)",
    "block_activity": with_(CALLS, BLOCKS, ACTIVE) + "SELECT session_id, block_id, active FROM active",
    "block_anchor_owners": with_(CALLS, BLOCKS, ACTIVE) + "SELECT session_id, anchor_seq, block_id FROM active WHERE active",
    "block_ancestors": with_(CALLS, BLOCKS, ACTIVE).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, up AS (
        SELECT session_id, block_id, block_id AS child, 0 AS depth, CAST(NULL AS BIGINT) AS ancestor FROM active WHERE NOT active
        UNION ALL
        SELECT u.session_id, u.block_id, p.block_id, u.depth + 1, CASE WHEN p.active THEN p.block_id END
        FROM up u JOIN active p ON p.session_id = u.session_id AND p.eats = u.child WHERE u.ancestor IS NULL
    ) SELECT session_id, block_id, ancestor, CAST(depth AS INTEGER) AS depth FROM up WHERE ancestor IS NOT NULL""",
    "block_guidance": with_(CALLS, BLOCKS, ACTIVE) + "SELECT session_id, count(*) AS n, string_agg('b' || block_id, ', ' ORDER BY block_id) AS names FROM active WHERE active GROUP BY 1",
    "recompressible_blocks": with_(CALLS, BLOCKS) + "SELECT session_id, block_id FROM blocks WHERE taken_back AND present",
    "decompress_diff": with_(
        CALLS, BLOCKS, ACTIVE, "newest AS (SELECT session_id, max(block_id) AS block_id FROM active WHERE active GROUP BY 1)",
        "later AS (SELECT b.* REPLACE (b.taken_back OR n.block_id IS NOT NULL AS taken_back) FROM blocks b LEFT JOIN newest n ON n.session_id = b.session_id AND n.block_id = b.block_id)", _active("later", "after_"),
    )
    + "SELECT a.session_id, a.block_id, CASE WHEN b.active THEN 'on' ELSE 'off' END AS change, a.compressed_tokens FROM active a JOIN after_ b USING (session_id, block_id) WHERE a.active <> b.active",
    "recompress_diff": with_(CALLS, BLOCKS, ACTIVE, "later AS (SELECT * REPLACE (taken_back AND NOT present AS taken_back) FROM blocks)", _active("later", "after_"))
    + "SELECT a.session_id, a.block_id, CASE WHEN b.active THEN 'on' ELSE 'off' END AS change, a.compressed_tokens FROM active a JOIN after_ b USING (session_id, block_id) WHERE a.active <> b.active",
    "message_refs": with_(MESSAGES, REFS) + "SELECT * FROM refs",
    "last_user_message": with_(MESSAGES)
    + """SELECT session_id, seq, coalesce(max(CASE WHEN role = 'user' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS last_user_seq,
        count(*) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM messages""",
    "turn_anchors": with_(MESSAGES, ANCHORS) + "SELECT * FROM anchors",
    "scrub_tags": with_(MESSAGES) + "SELECT session_id, seq, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS tokens, md5(text) AS digest FROM messages",
    "inject_message_refs": with_(MESSAGES, REFS) + "SELECT session_id, seq, md5(CASE WHEN ref IS NULL THEN text ELSE text || chr(10) || '<mid>' || ref || '</mid>' END) AS digest FROM messages LEFT JOIN refs USING (session_id, seq)",
    "inject_nudges": with_(MESSAGES, ANCHORS)
    + """SELECT m.session_id, m.seq, md5(CASE WHEN a.seq IS NULL THEN m.text WHEN m.role = 'user' THEN m.text || chr(10) || '[compress soon]' ELSE '[compress soon]' || chr(10) || m.text END) AS digest
        FROM messages m LEFT JOIN anchors a ON a.session_id = m.session_id AND a.seq = m.seq""",
    "strip_stale_metadata": with_(MESSAGES, "tagged AS (SELECT *, 'model-' || CAST(seq % 4 AS VARCHAR) AS model FROM messages)")
    + """SELECT session_id, seq, CASE WHEN NOT (role = 'assistant' AND now IS NOT NULL AND model <> now) THEN role END AS metadata FROM (
        SELECT *, arg_max(model, seq) FILTER (WHERE role = 'user') OVER (PARTITION BY session_id) AS now FROM tagged)""",
    "recent_sessions_topk": with_(SESSIONS) + "SELECT id, directory, time_updated FROM sessions ORDER BY time_updated DESC, id DESC LIMIT 10",
    "session_list_page": with_(SESSIONS) + "SELECT id, parent_id, title FROM sessions WHERE parent_id IS NULL AND contains(lower(title), 'the') ORDER BY time_updated DESC, id DESC LIMIT 20 OFFSET 5",
    "session_title_search": with_(SESSIONS) + "SELECT id, title FROM sessions WHERE contains(lower(title), 'the and')",
    "sessions_last_used": with_(SESSIONS) + "SELECT id, coalesce(nullif(time_updated, 0), 0) / 1e3 AS last_used FROM sessions",
    "message_lookup": with_(MESSAGES, "wanted AS (SELECT * FROM (VALUES (0, 3, 1), (1, 1000000000, 0), (2, 1, 0)) AS t(pos, session_id, seq))")
    + "SELECT CAST(pos AS INTEGER) AS pos, CAST(w.session_id AS BIGINT) AS session_id, CAST(w.seq AS BIGINT) AS seq, role, CASE WHEN role IS NULL THEN 'not found' END AS error FROM wanted w LEFT JOIN messages m ON m.session_id = w.session_id AND m.seq = w.seq",
    "glob_protected": """SELECT page_id, regexp_full_match(path, '(?s)(.*/)?[^/]*1') OR regexp_full_match(path, '[^/]*/p[^/]') OR regexp_full_match(path, '(?s)(.*/)?a/.*') AS protected
        FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)""",
    "permission_last_match": with_(CALLS)
    + """SELECT call_id AS request_id, CASE rule WHEN 0 THEN '*' WHEN 1 THEN '*' WHEN 2 THEN 'src*' WHEN 3 THEN '*1*' ELSE '*7' END AS pattern, CASE rule WHEN 0 THEN 'ask' WHEN 1 THEN 'allow' ELSE 'deny' END AS action FROM (
        SELECT call_id, CASE WHEN tool = 'read' AND path LIKE '%7' THEN 4 WHEN tool = 'bash' AND path LIKE '%1%' THEN 3 WHEN tool = 'write' THEN 2 WHEN tool = 'read' THEN 1 ELSE 0 END AS rule FROM calls)""",
    "tool_signatures": with_(CALLS) + "SELECT call_id, tool || '::' || replace(parameters, ' ', '') AS signature FROM calls",
    "stable_ids": with_(MESSAGES) + "SELECT session_id, seq, 'msg_' || left(sha256(session_id || ':' || seq), 16) AS id FROM messages",
    "formatted_counts": with_(CALLS, "c AS (SELECT call_id, input * 37 AS n, CAST(floor(input * 37 / 1e2 + 0.5e0) AS BIGINT) AS t, input * (cache_read + 1) AS s, input FROM calls)")
    + """SELECT call_id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN t % 10 = 0 THEN (t // 10) || 'K' ELSE (t // 10) || '.' || (t % 10) || 'K' END AS tokens,
        CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS duration,
        CAST(greatest(0, floor(input / 500e0 * 20 + 0.5e0)) AS BIGINT) AS bar FROM c""",
    "message_tokens": with_(MESSAGES) + "SELECT session_id, seq, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS tokens, md5(CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END) AS short FROM messages",
    "range_issues": with_(MESSAGES, REFS, RANGES) + "SELECT session_id, CAST(1 AS BIGINT) AS cmd, start_seq, end_seq, issues FROM ranges",
    "range_collapse": with_(MESSAGES, REFS, RANGES)
    + """SELECT m.session_id, m.seq, 1 AS rank, m.role FROM messages m LEFT JOIN ranges r ON r.session_id = m.session_id AND r.issues IS NULL WHERE r.session_id IS NULL OR m.seq NOT BETWEEN r.start_seq AND r.end_seq
        UNION ALL SELECT r.session_id, r.start_seq, 0, 'user' FROM ranges r WHERE issues IS NULL AND start_seq >= (SELECT min(seq) FROM messages m WHERE m.session_id = r.session_id AND role = 'user')""",
    "compressed_tokens": with_(MESSAGES, REFS, RANGES)
    + "SELECT m.session_id, CAST(sum(CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT)) AS BIGINT) AS compressed_tokens, count(*) AS n_messages FROM messages m JOIN ranges r ON r.session_id = m.session_id AND r.issues IS NULL AND m.seq BETWEEN r.start_seq AND r.end_seq GROUP BY 1",
    "stats_overview": with_(CALLS, TURNS, DEDUP, PURGE, BLOCKS, ACTIVE, "gone AS (SELECT session_id, call_id FROM dedup UNION SELECT session_id, call_id FROM purge)", "g AS (SELECT session_id, count(*) AS n FROM gone GROUP BY 1)", "a AS (SELECT session_id, count(*) AS n, sum(compressed_tokens) AS t FROM active WHERE active GROUP BY 1)")
    + "SELECT count(*) AS sessions, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS pruned_calls, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS active_blocks, CAST(coalesce(sum(a.t), 0) AS BIGINT) AS block_tokens FROM g FULL JOIN a USING (session_id)",
}

#: The four commands of nested_compaction by hand: which references a block spans, from where on it exists, what it consumed and what its body says.
NESTED = """
    said(block_id, first, last, least, consumed, body, active_from) AS (VALUES
        (1, 1, 2, 2, '', 'first part', 0), (2, 1, 3, 3, '1', 'second first part part (b1) (b9)', 0), (3, 4, 4, 4, '', 'third', 0), (4, 1, 4, 4, '2,3', 'all of it second first part part (b1) (b9)' || chr(10) || chr(10) || 'third', 0)
    ),
    counted AS (SELECT session_id, count(*) AS n FROM refs GROUP BY 1),
    nested AS (
        SELECT c.session_id, CAST(s.block_id AS BIGINT) AS block_id, a.seq AS start_seq, b.seq AS end_seq, s.consumed, '[compressed section]' || chr(10) || s.body || chr(10) || chr(10) || '[b' || s.block_id || ']' AS summary,
               s.block_id = CASE WHEN c.n >= 4 THEN 4 WHEN c.n = 3 THEN 2 ELSE 1 END AS active
        FROM counted c JOIN said s ON c.n >= s.least JOIN refs a ON a.session_id = c.session_id AND a.ref = 'm000' || s.first JOIN refs b ON b.session_id = c.session_id AND b.ref = 'm000' || s.last
    ),
    held AS (SELECT n.session_id, n.block_id, n.active, m.seq, CAST(floor(length(m.text) / 4.0 + 0.5) AS BIGINT) AS tokens FROM nested n JOIN messages m ON m.session_id = n.session_id AND m.seq BETWEEN n.start_seq AND n.end_seq)"""

ORACLE_SQL |= {
    "effective_ids": with_(MESSAGES, REFS, NESTED) + "SELECT session_id, block_id, seq FROM held",
    "covered_messages": with_(MESSAGES, REFS, NESTED)
    + "SELECT session_id, seq, string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY block_id) AS all_blocks, coalesce(string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY block_id) FILTER (WHERE active), '') AS active_blocks, max(tokens) AS tokens FROM held GROUP BY 1, 2",
    "placeholder_expand": with_(MESSAGES, REFS, NESTED) + "SELECT session_id, block_id, summary, CAST(CASE WHEN consumed = '' THEN 0 ELSE 1 + length(consumed) - length(replace(consumed, ',', '')) END AS BIGINT) AS n_consumed, CAST(0 AS BIGINT) AS n_missing FROM nested",
    # a block's new messages are those that no block active before it covers: block 2 has one more range than block 1, block 4 what lies between blocks 2 and 3
    "nested_compaction": with_(MESSAGES, REFS, NESTED)
    + """SELECT n.session_id, n.block_id, n.start_seq, n.end_seq, n.active, n.consumed, n.summary, count(*) AS n_messages,
            CAST(coalesce(sum(h.tokens) FILTER (WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.session_id = h.session_id AND o.seq = h.seq AND o.block_id < h.block_id)), 0) AS BIGINT) AS compressed_tokens
        FROM nested n JOIN held h ON h.session_id = n.session_id AND h.block_id = n.block_id GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "iteration_anchors": with_(
        MESSAGES, "since AS (SELECT *, seq - max(CASE WHEN role = 'user' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM messages)", "late AS (SELECT session_id, seq FROM since WHERE n >= 1)",
        "picks AS (SELECT session_id, min(seq) AS seq FROM late GROUP BY 1 UNION ALL SELECT p.session_id, min(l.seq) FROM picks p JOIN late l ON l.session_id = p.session_id AND l.seq >= p.seq + 3 GROUP BY p.session_id, p.seq)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT session_id, seq FROM picks",
}
ORACLE_SQL |= history_oracles.ORACLE_SQL
