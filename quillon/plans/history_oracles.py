"""DuckDB twins of the queries over messages with parts, written from the events table."""

from __future__ import annotations

BASE = """
    ev AS (
        SELECT event_id AS e, user_id AS session_id, epoch_us(ts) // 1000 AS created, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(floor(value) AS BIGINT) AS v, props FROM events
    ),
    msgs AS (
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created, e) AS seq, e AS message_id, CASE WHEN event_type = 'click' THEN 'user' ELSE 'assistant' END AS role, created,
               CASE WHEN event_type <> 'click' AND e % 5 <> 0 THEN CASE WHEN e % 9 = 0 THEN 0 ELSE created + v * 10 END END AS completed, event_type <> 'click' AND e % 211 = 0 AS summary,
               'agent-' || (e % 2) AS agent, 'p' || (e % 2) AS provider, 'm' || (e % 3) AS model, CASE WHEN event_type = 'click' AND e % 4 = 1 THEN 'fast' END AS variant, event_type <> 'click' AS spoke, v AS t_in, (e % 4) * 10 AS t_out, e % 7 AS t_think, k * 10 AS t_read, e % 3 AS t_write
        FROM ev
    ),
    tools AS (
        SELECT *, CASE WHEN event_type = 'error' AND tool = 'bash' THEN 'error' WHEN e % 13 = 0 THEN 'running' ELSE 'completed' END AS status,
               '"filePath":"' || CASE WHEN k % 2 = 0 THEN '/work/app/' ELSE '' END || 'src/k' || (k % 20) || '.py"' AS file FROM (
            SELECT *, CASE event_type WHEN 'view' THEN CASE WHEN e % 5 = 0 THEN 'list' ELSE 'read' END WHEN 'purchase' THEN CASE WHEN e % 2 = 0 THEN 'write' ELSE 'edit' END
                WHEN 'signup' THEN CASE WHEN e % 3 = 0 THEN 'task' ELSE 'compress' END ELSE CASE WHEN e % 4 = 3 THEN 'question' ELSE 'bash' END END AS tool
            FROM ev WHERE event_type <> 'click')
    ),
    parts AS (
        SELECT session_id, e AS message_id, 0 AS part_seq, 'text' AS type, 'ask ' || props AS text, e % 7 = 0 AS ignored, NULL AS tool, NULL AS call_id, NULL AS status, NULL AS input, NULL AS output, NULL AS error,
               NULL AS child, NULL AS s_in, NULL AS s_out, NULL AS s_think, NULL AS s_read, NULL AS s_write, NULL AS cost, NULL AS reason
        FROM ev WHERE event_type = 'click' AND e % 11 > 0
        UNION ALL SELECT session_id, e, 1, 'text', 'and more ' || e, e % 7 = 0 AND e % 2 = 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ev WHERE event_type = 'click' AND e % 11 > 0 AND e % 3 = 0
        UNION ALL SELECT session_id, e, 0, 'step-start', NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tools
        UNION ALL SELECT session_id, e, 1, 'reasoning', 'thinking of ' || k, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tools WHERE e % 3 = 1
        UNION ALL SELECT session_id, e, place, 'tool', NULL, false, tool, CASE WHEN place > 2 OR e % 53 > 0 THEN letter || e END, status,
               CASE tool WHEN 'read' THEN '{' || file || CASE WHEN e % 3 > 0 THEN ',"offset":' || k ELSE '' END || CASE WHEN e % 3 = 2 THEN ',"limit":50' ELSE '' END || '}' WHEN 'list' THEN CASE WHEN e % 2 = 0 THEN '{"path":"src"}' ELSE '{}' END
                   WHEN 'write' THEN '{' || file || ',"content":"line ' || k || '"}' WHEN 'edit' THEN '{' || file || ',"content":"line ' || k || '"}' WHEN 'compress' THEN '{"topic":"t' || k || '","n":' || k || ',"nested":{"a":"b"},"none":null}'
                   WHEN 'task' THEN '{"description":"part ' || k || '","prompt":"do"}' WHEN 'question' THEN '{"questions":[{"header":"H' || (k % 3) || '","question":"why"},{"header":"","question":"how"}]}'
                   ELSE '{"command":"run --all --of --the --steps --up --to --number ' || k || '","n":' || k || ',"deep":{"x":"y"}}' END,
               CASE WHEN status = 'completed' THEN 'out ' || props || CASE WHEN tool = 'task' THEN chr(10) || '<Task_Result>' || chr(10) || 'old' || chr(10) || '</Task_Result> <task_result>kept</task_result>' ELSE '' END END,
               CASE WHEN status = 'error' THEN 'failed with ' || k END, CASE WHEN tool = 'task' AND e % 2 = 0 THEN session_id + 1 END, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tools JOIN (VALUES (2, 'c', 1), (6, 'd', 5), (7, 'b', 10)) AS again(place, letter, every) ON e % every = 0
        UNION ALL SELECT session_id, e, 3, 'text', ' done ' || k || CASE WHEN e % 12 = 0 THEN '<note>gone</note>' ELSE '' END, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tools WHERE e % 6 = 0
        UNION ALL SELECT session_id, e, 4, 'step-finish', NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, v, (e % 4) * 10, e % 7, k * 10, e % 3, v * 3,
               CASE WHEN event_type IN ('view', 'purchase') THEN 'tool-calls' WHEN event_type = 'signup' THEN 'stop' END FROM tools WHERE e % 17 > 0
        UNION ALL SELECT session_id, e, 5, 'step-finish', NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, v + 7, (e % 4) * 10, e % 7, k * 10, e % 3, v, 'stop' FROM tools WHERE e % 19 = 0
    ),
    kinds AS (SELECT message_id, bool_and(ignored) AS all_ignored, bool_or(type = 'tool' AND tool = 'compress' AND status = 'completed') AS compressed FROM parts GROUP BY 1),
    m AS (
        SELECT msgs.*, role = 'user' AND coalesce(all_ignored, true) AS ignored, coalesce(compressed, false) AS compressed,
               coalesce(arg_max(created, seq) FILTER (WHERE role = 'assistant' AND summary) OVER (PARTITION BY msgs.session_id), 0) AS last_compaction,
               created < coalesce(arg_max(created, seq) FILTER (WHERE role = 'assistant' AND summary) OVER (PARTITION BY msgs.session_id), 0) AS compacted
        FROM msgs LEFT JOIN kinds USING (message_id)
    ),
    content AS (
        SELECT message_id, part_seq, CASE WHEN tool = 'question' THEN CAST(json_extract(input, '$.questions') AS VARCHAR) WHEN tool IN ('edit', 'write') THEN concat_ws(' ', input, output, error) ELSE coalesce(output, error) END AS said FROM parts WHERE type = 'tool'
    ),
    started AS (
        SELECT p.*, m.seq, sum(CASE WHEN type = 'step-start' THEN 1 ELSE 0 END) OVER (PARTITION BY p.session_id ORDER BY m.seq, part_seq ROWS UNBOUNDED PRECEDING) AS turn,
               sum(CASE WHEN type = 'step-start' THEN 1 ELSE 0 END) OVER (PARTITION BY p.session_id) AS current_turn
        FROM parts p JOIN m USING (message_id) WHERE NOT m.compacted
    ),
    calls AS (
        SELECT s.session_id, s.seq, s.message_id, s.part_seq, call_id, tool, status, input, CAST(turn AS BIGINT) AS turn, CAST(current_turn AS BIGINT) AS current_turn, CAST(floor(coalesce(length(said), 0) / 4.0 + 0.5) AS BIGINT) AS token_count
        FROM started s JOIN content USING (message_id, part_seq) WHERE call_id IS NOT NULL
    ),
    every AS (SELECT p.*, m.seq, m.created, m.completed FROM parts p JOIN m USING (message_id) WHERE type = 'step-finish'),
    used AS (SELECT message_id, tool, count(*) AS uses FROM parts WHERE type = 'tool' GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY part_seq) AS up, row_number() OVER (PARTITION BY message_id ORDER BY part_seq DESC) AS down FROM every),
    firsts AS (SELECT ranked.* EXCLUDE (tool), used.tool, used.uses FROM ranked JOIN used USING (message_id) WHERE up = 1),
    lasts AS (SELECT ranked.* EXCLUDE (tool), used.tool, used.uses FROM ranked JOIN used USING (message_id) WHERE down = 1)"""


def tokens(x: str) -> str:
    return f"CAST(floor(coalesce(length({x}), 0) / 4.0 + 0.5) AS BIGINT)"


def hit(read: str, fresh: str) -> str:
    return f"CASE WHEN {read} + {fresh} > 0 THEN floor(1e3 * ({read}) / ({read} + {fresh}) + 0.5e0) / 1e1 ELSE 0e0 END"


def rate(read: str, fresh: str) -> str:
    return f"CASE WHEN {read} + {fresh} > 0 THEN 1e2 * {read} / ({read} + {fresh}) ELSE 0e0 END"


def total(x: str, name: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {name}"


USED = "('compress', 'write', 'task')"
SUMS = ", ".join(total(f"s_{a}", b) for a, b in (("in", "input"), ("out", "output"), ("think", "reasoning"), ("read", "cache_read"), ("write", "cache_write")))
STATS = f"""
    stats AS (
        SELECT *, input + output + cache_read AS total, {hit("cache_read", "input")} AS hit_rate FROM (
            SELECT session_id, {SUMS}, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost, count(*) AS steps, count(*) FILTER (WHERE reason = 'tool-calls') AS tool_calls, count(*) FILTER (WHERE reason = 'stop') AS stop,
                   count(*) FILTER (WHERE coalesce(reason, '?') NOT IN ('tool-calls', 'stop')) AS other FROM every GROUP BY 1)
    )"""
AHEAD = "ahead AS (SELECT *, lead(s_in) OVER (PARTITION BY session_id ORDER BY seq) AS n_in, lead(s_read) OVER (PARTITION BY session_id ORDER BY seq) AS n_read FROM firsts)"
EVENTS = f"events_ AS (SELECT ahead.* FROM ahead JOIN range(1, 4) copies(i) ON copies.i <= uses WHERE tool IN {USED} AND n_in IS NOT NULL)"
#: Rows with equal tools and inputs have equal signatures here, as inputs are written in one way.
DEDUP = "dedup AS (SELECT session_id, call_id, token_count FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tool, input ORDER BY seq DESC, part_seq DESC) AS rn FROM calls) WHERE rn > 1)"
OPEN_DEDUP = """
    open_dedup AS (
        SELECT session_id, call_id, token_count FROM (
            SELECT *, row_number() OVER (PARTITION BY session_id, tool, input ORDER BY seq DESC, part_seq DESC) AS rn FROM calls
            WHERE tool <> 'compress' AND NOT coalesce(json_extract_string(input, '$.filePath') IN ('src/k3.py', '/work/app/src/k3.py'), false)) WHERE rn > 1
    )"""
#: Blocks at every 23rd message: every fifth without text, some not active, some with a second block at the same place.
SUMMARIES = """
    told AS (
        SELECT session_id, seq, message_id, block, text FROM (
            SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY block DESC) AS rn FROM (
                SELECT session_id, seq, message_id, message_id AS block, CASE WHEN message_id % 5 = 0 THEN '' ELSE 'sum ' || message_id END AS text FROM m WHERE message_id % 23 = 0 AND message_id % 3 > 0
                UNION ALL SELECT session_id, seq, message_id, message_id + 1000000, 'later' FROM m WHERE message_id % 92 = 0 AND message_id % 8 > 0)) WHERE rn = 1 AND text <> ''
    ),
    carried AS (
        SELECT *, last_value(CASE WHEN role = 'user' AND NOT ignored THEN {'agent': agent, 'model': model, 'variant': variant} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS who FROM m
    ),
    in_place AS (
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY spot, rank) AS seq, message_id, role, agent, model, variant, text FROM (
            SELECT t.session_id, t.seq AS spot, 0 AS rank, 'summary_' || left(sha256(t.block || ':' || t.message_id), 16) AS message_id, 'user' AS role, c.who.agent AS agent, c.who.model AS model, c.who.variant AS variant, t.text
            FROM told t JOIN carried c USING (message_id) WHERE c.who IS NOT NULL
            UNION ALL SELECT session_id, seq, 1, CAST(message_id AS VARCHAR), role, agent, model, variant, NULL FROM m WHERE message_id % 29 <> 0)
    )"""
PURGE = "purge AS (SELECT session_id, call_id, current_turn - turn AS age FROM calls WHERE status = 'error' AND current_turn - turn >= 4)"
REFS = "refs AS (SELECT session_id, seq, message_id, 'm' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS VARCHAR), 4, '0') AS ref FROM m WHERE NOT ignored)"
CURRENT = "current AS (SELECT session_id, CAST(coalesce(arg_max(t_in + t_out + t_think + t_read + t_write, seq) FILTER (WHERE spoke AND t_out > 0), 0) AS BIGINT) AS current_tokens FROM m GROUP BY 1)"
MODEL = "model AS (SELECT session_id, arg_max(agent, seq) AS agent, arg_max(provider, seq) AS provider, arg_max(model, seq) AS model, arg_max({'v': variant}, seq).v AS variant FROM m WHERE role = 'user' AND NOT ignored GROUP BY 1)"
MESSAGE_TOKENS = f"""
    message_tokens AS (
        SELECT m.session_id, m.seq, m.message_id, m.ignored, {tokens("t.said")} AS tokens FROM m LEFT JOIN (
            SELECT message_id, string_agg(said, ' ' ORDER BY part_seq) AS said FROM (
                SELECT message_id, part_seq, text AS said FROM parts WHERE type = 'text' UNION ALL SELECT message_id, part_seq, said FROM content WHERE said IS NOT NULL) GROUP BY 1) t USING (message_id)
    )"""
RANGES = """
    ranges AS (
        SELECT s.session_id, a.seq AS start_seq, b.seq AS end_seq FROM (SELECT DISTINCT session_id FROM m) s JOIN refs a ON a.session_id = s.session_id AND a.ref = 'm0002' JOIN refs b ON b.session_id = s.session_id AND b.ref = 'm0004'
    ),
    inside AS (SELECT r.session_id, r.start_seq, r.end_seq, m.seq, m.message_id FROM ranges r JOIN m ON m.session_id = r.session_id AND m.seq BETWEEN r.start_seq AND r.end_seq AND NOT m.ignored)"""
ANCHORS = "anchors AS (SELECT session_id, seq, message_id, 'context' AS kind FROM m WHERE message_id % 8 = 0 UNION ALL SELECT session_id, seq, message_id, 'turn' FROM m WHERE message_id % 9 = 0 UNION ALL SELECT session_id, seq, message_id, 'iteration' FROM m WHERE message_id % 10 = 0)"
LABEL = """CASE tool WHEN 'read' THEN json_extract_string(input, '$.filePath') || CASE WHEN input LIKE '%"limit"%' THEN ' (lines ' || k || '-' || (k + 50) || ')' WHEN input LIKE '%"offset"%' THEN ' (lines ' || k || '+)' ELSE '' END
    WHEN 'write' THEN json_extract_string(input, '$.filePath') WHEN 'edit' THEN json_extract_string(input, '$.filePath') WHEN 'list' THEN coalesce(json_extract_string(input, '$.path'), '(current directory)')
    WHEN 'task' THEN 'part ' || k WHEN 'question' THEN '2 questions: H' || (k % 3)
    WHEN 'bash' THEN CASE WHEN length(json_extract_string(input, '$.command')) > 50 THEN left(json_extract_string(input, '$.command'), 50) || '...' ELSE json_extract_string(input, '$.command') END ELSE left(input, 50) END"""
LABELS = f"labels AS (SELECT message_id, call_id, tool, label, CASE WHEN starts_with(label, '/work/app/') THEN substr(label, 11) ELSE label END AS short FROM (SELECT p.*, {LABEL} AS label FROM parts p JOIN ev ON ev.e = p.message_id WHERE type = 'tool'))"
RESULTS = """
    spoken AS (SELECT session_id, seq, message_id, compressed, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM m WHERE role = 'assistant'),
    texts AS (SELECT s.session_id, s.rn, s.compressed, trim(p.text) AS text FROM spoken s LEFT JOIN parts p ON p.message_id = s.message_id AND p.type = 'text' WHERE rn <= 2),
    results AS (
        SELECT session_id, concat_ws(chr(10) || chr(10), nullif(max(CASE WHEN rn = 2 AND compressed THEN text END), ''), nullif(max(CASE WHEN rn = 1 THEN text END), '')) AS result FROM texts GROUP BY 1
    )"""


def digest(changed: str, order: str = "part_seq", more: str = "") -> str:
    """A digest of each message's parts, after ``changed`` has made them (message_id, place, type, text, input, output)."""
    return f""", changed AS ({changed})
        SELECT m.session_id, m.message_id, md5(coalesce(string_agg(concat_ws('|', c.type, c.text, c.input, c.output), chr(10) ORDER BY c.place), '')) AS digest
        FROM m LEFT JOIN changed c USING (message_id) GROUP BY 1, 2"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join((BASE, *ctes)) + " "


#: Where put text goes: behind everything with users, before the tool part (place 2) with assistants.
PUT = "CASE WHEN m.role = 'user' THEN 9.0 + {n} / 100.0 ELSE 1.5 + {n} / 100.0 END"
PLAIN = "SELECT message_id, CAST(part_seq AS DOUBLE) AS place, type, text, input, output FROM parts"

ORACLE_SQL = {
    "token_stats_by_session": with_(STATS) + "SELECT * FROM stats",
    "token_stats_rollup": with_(STATS)
    + f"""SELECT *, {hit("cache_read", "input")} AS hit_rate, CASE WHEN sessions > 0 THEN round(CAST(steps AS DOUBLE) / sessions, 1) ELSE 0e0 END AS mean_steps FROM (
        SELECT count(*) AS sessions, {", ".join(total(c, c) for c in ("input", "output", "reasoning", "cache_read", "cache_write", "steps", "total"))} FROM stats)""",
    "finish_reason_histogram": with_(STATS) + "SELECT session_id, tool_calls, stop, other FROM stats",
    "timeline_deltas": with_()
    + f"""SELECT session_id, seq, message_id, coalesce(reason, 'unknown') AS reason, s_read - lag(s_read, 1, 0) OVER w AS cache_read_delta, s_in - lag(s_in, 1, 0) OVER w AS input_delta,
        CASE WHEN lag(completed) OVER w <> 0 AND created <> 0 THEN created - lag(completed) OVER w END AS gap, CASE WHEN created <> 0 AND completed <> 0 THEN completed - created END AS duration, {hit("s_read", "s_in")} AS hit_rate
        FROM lasts WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
    "timeline_summary": with_()
    + f"""SELECT *, {hit("cache_read", "input")} AS hit_rate FROM (SELECT session_id, count(*) AS steps, {total("s_in", "input")}, {total("s_out", "output")}, {total("s_read", "cache_read")}, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost,
        {total("CASE WHEN created <> 0 AND completed <> 0 THEN completed - created END", "duration")}, {total(f"CASE WHEN tool IN {USED} THEN uses ELSE 0 END", "uses")} FROM lasts GROUP BY 1)""",
    "tool_impact": with_(AHEAD, EVENTS)
    + f"""SELECT tool, count(*) AS calls, round(sum({rate("s_read", "s_in")}) / count(*), 6) AS hit_before, round(sum({rate("n_read", "n_in")}) / count(*), 6) AS hit_after,
        round(CAST(sum(s_in + s_read) AS DOUBLE) / count(*), 6) AS context_before, round(CAST(sum(n_in + n_read) AS DOUBLE) / count(*), 6) AS context_after FROM events_ GROUP BY 1""",
    "cost_impact": with_(AHEAD, EVENTS)
    + f"""SELECT calls, CASE WHEN calls > 0 THEN round(CAST(ib + cb AS DOUBLE) / calls, 6) ELSE 0e0 END AS context_before, CASE WHEN calls > 0 THEN round(CAST(ia + ca AS DOUBLE) / calls, 6) ELSE 0e0 END AS context_after,
        {hit("cb", "ib")} AS hit_before, {hit("ca", "ia")} AS hit_after FROM (SELECT count(*) AS calls, {total("s_in", "ib")}, {total("s_read", "cb")}, {total("n_in", "ia")}, {total("n_read", "ca")} FROM events_)""",
    "cache_recovery_curve": with_(f"numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM firsts)", f"far AS (SELECT *, max(CASE WHEN tool IN {USED} THEN n END) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM numbered)")
    + f"SELECT n - last - 1 AS distance, count(*) AS n, round(sum({rate('s_read', 's_in')}) / count(*), 6) AS mean, round(min({rate('s_read', 's_in')}), 6) AS least, round(max({rate('s_read', 's_in')}), 6) AS most FROM far WHERE last IS NOT NULL GROUP BY far.n - last - 1 ORDER BY 1 LIMIT 15",
    "impact_overview": with_(
        AHEAD, EVENTS, "users AS (SELECT session_id, count(*) FILTER (WHERE role = 'user' AND NOT ignored) AS n FROM m GROUP BY 1)",
        "per AS (SELECT u.session_id, u.n, coalesce(s.steps, 0) AS steps, coalesce(c.calls, 0) AS calls FROM users u LEFT JOIN (SELECT session_id, count(*) AS steps FROM firsts GROUP BY 1) s USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS calls FROM events_ GROUP BY 1) c USING (session_id))",
    )
    + f"SELECT count(*) AS scanned, count(*) FILTER (WHERE n < 10) AS skipped, count(*) FILTER (WHERE n >= 10) AS analysed, count(*) FILTER (WHERE n >= 10 AND calls > 0) AS with_calls, {total('CASE WHEN n >= 10 THEN calls END', 'calls')}, {total('CASE WHEN n >= 10 THEN steps END', 'steps')} FROM per",
    "real_user_messages": with_() + "SELECT session_id, count(*) FILTER (WHERE role = 'user' AND NOT ignored) AS user_messages FROM m GROUP BY 1",
    "current_tokens": with_(CURRENT) + "SELECT * FROM current",
    "over_limits": with_(CURRENT) + "SELECT *, current_tokens > 200 AS over_max, current_tokens >= 100 AS over_min FROM current",
    "agent_permissions": with_(MODEL) + "SELECT session_id, CASE agent WHEN 'agent-1' THEN 'deny' ELSE 'ask' END AS permission FROM model",
    "system_tokens": with_(
        "shown AS (SELECT message_id, string_agg(text, '' ORDER BY part_seq) AS text FROM parts WHERE type = 'text' AND NOT ignored GROUP BY 1)",
        "opened AS (SELECT m.session_id, arg_min(t_in + t_read + t_write, seq) FILTER (WHERE spoke AND t_in + t_read + t_write > 0) AS opening, arg_min(coalesce(text, ''), seq) FILTER (WHERE role = 'user' AND NOT ignored) AS text FROM m LEFT JOIN shown USING (message_id) GROUP BY 1)",
    )
    + f"SELECT session_id, CASE WHEN opening - {tokens('text')} > 0 THEN opening - {tokens('text')} END AS system_tokens FROM opened",
    "last_messages": with_() + "SELECT session_id, max(seq) AS seq, arg_max(role, seq) AS role, arg_max(message_id, seq) AS message_id FROM m WHERE NOT ignored GROUP BY 1",
    "compacted_messages": with_() + "SELECT session_id, message_id, last_compaction, compacted OR message_id % 29 = 0 AS compacted FROM m",
    "tool_call_view": with_() + "SELECT session_id, seq, call_id, tool, status, turn, current_turn, token_count FROM calls",
    "tool_id_list": with_() + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, part_seq) - 1 AS pos, call_id FROM calls",
    "total_tool_tokens": with_() + "SELECT session_id, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS calls FROM calls WHERE message_id % 29 <> 0 GROUP BY 1",
    "message_token_totals": with_(MESSAGE_TOKENS) + "SELECT session_id, message_id, tokens FROM message_tokens",
    "dedup_tool_calls": with_()
    + """SELECT session_id, call_id, token_count FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tool, input ORDER BY seq DESC, part_seq DESC) AS rn FROM calls WHERE tool <> 'compress' AND NOT (message_id % 31 = 0 AND part_seq = 2)
        AND NOT coalesce(json_extract_string(input, '$.filePath') IN ('src/k3.py', '/work/app/src/k3.py'), false)) WHERE rn > 1""",
    "purge_tool_errors": with_(PURGE) + "SELECT * FROM purge",
    "eligible_tool_calls": with_() + "SELECT session_id, call_id, turn FROM calls WHERE current_turn - turn >= 3",
    "summaries_in_place": with_(SUMMARIES) + "SELECT session_id, seq, message_id, role, agent, model, variant, text FROM in_place",
    "pruned_parts_rewrite": with_(OPEN_DEDUP, PURGE, SUMMARIES, "gone AS (SELECT call_id FROM open_dedup UNION SELECT call_id FROM purge)")
    + """SELECT p.session_id, CAST(p.message_id AS VARCHAR) AS message_id, tool, status, CAST(NULL AS VARCHAR) AS text,
        CASE WHEN g.call_id IS NOT NULL AND status = 'error' THEN '{"command":"[pruned input]","deep":{"x":"y"},"n":' || json_extract_string(input, '$.n') || '}' WHEN g.call_id IS NOT NULL AND status = 'completed' AND tool = 'question' THEN '{"questions":"[pruned questions]"}' ELSE input END AS input,
        CASE WHEN g.call_id IS NOT NULL AND status = 'completed' AND tool NOT IN ('question', 'edit', 'write') THEN '[pruned]' ELSE output END AS output
        FROM parts p JOIN m USING (message_id) LEFT JOIN gone g ON g.call_id = p.call_id AND NOT m.compacted WHERE type = 'tool' AND message_id % 29 <> 0
        UNION ALL SELECT session_id, message_id, NULL, NULL, text, NULL, NULL FROM in_place WHERE text IS NOT NULL""",
    "full_tools_dropped": with_(OPEN_DEDUP, PURGE, "gone AS (SELECT call_id FROM open_dedup UNION SELECT call_id FROM purge)")
    + """SELECT m.session_id, m.message_id, count(p.type) AS n_parts FROM m LEFT JOIN (
            SELECT p.* FROM parts p JOIN m USING (message_id) LEFT JOIN gone g ON g.call_id = p.call_id WHERE m.compacted OR g.call_id IS NULL OR tool NOT IN ('edit', 'write')) p USING (message_id) GROUP BY 1, 2""",
    "kept_after_compaction": with_() + "SELECT session_id, message_id FROM m WHERE role = 'assistant' AND NOT compacted",
    "sweep_since_user": with_(DEDUP, "since AS (SELECT session_id, max(seq) AS last_user FROM m WHERE role = 'user' AND NOT ignored GROUP BY 1)")
    + "SELECT c.session_id, c.call_id, c.token_count, tool = 'compress' OR coalesce(regexp_full_match(json_extract_string(input, '$.filePath'), 'src/k[^/]\\.py'), false) AS protected FROM calls c JOIN since s ON s.session_id = c.session_id AND c.seq > s.last_user WHERE c.call_id NOT IN (SELECT call_id FROM dedup)",
    "sweep_report": with_(DEDUP, "late AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, part_seq DESC) AS rn FROM calls)")
    + """SELECT session_id, count(*) FILTER (WHERE NOT kept) AS swept, CAST(coalesce(sum(token_count) FILTER (WHERE NOT kept), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE kept) AS skipped FROM (
        SELECT *, tool IN ('compress', 'bash') OR coalesce(regexp_full_match(json_extract_string(input, '$.filePath'), 'src/k[^/]\\.py'), false) AS kept FROM late WHERE rn <= 9 AND call_id NOT IN (SELECT call_id FROM dedup)) GROUP BY 1""",
    "context_breakdown": with_(
        DEDUP, CURRENT, "mm AS (SELECT * REPLACE (compacted OR message_id % 29 = 0 AS compacted), message_id % 29 = 0 AS covered FROM m)",
        "user_texts AS (SELECT m.session_id, m.seq, m.compacted, p.text, p.part_seq FROM mm m JOIN parts p USING (message_id) WHERE m.role = 'user' AND NOT m.ignored AND p.type = 'text')",
        "users AS (SELECT session_id, string_agg(text, chr(10) ORDER BY seq, part_seq) AS said FROM user_texts WHERE NOT compacted GROUP BY 1)",
        "first_user AS (SELECT session_id, min(seq) AS seq FROM mm WHERE role = 'user' AND NOT ignored GROUP BY 1)",
        "first_said AS (SELECT f.session_id, string_agg(t.text, '' ORDER BY t.part_seq) AS said FROM first_user f JOIN user_texts t ON t.session_id = f.session_id AND t.seq = f.seq AND NOT t.compacted GROUP BY 1)",
        "opened AS (SELECT session_id, arg_min(t_in + t_read + t_write, seq) AS opening FROM mm WHERE spoke AND t_in + t_read + t_write > 0 GROUP BY 1)",
        "tl AS (SELECT m.session_id, m.seq, m.compacted, m.covered, p.call_id, p.status, p.input, p.output, d.call_id IS NOT NULL AS gone FROM mm m JOIN parts p USING (message_id) LEFT JOIN dedup d ON d.call_id = p.call_id WHERE p.type = 'tool')",
        "tt AS (SELECT session_id, string_agg(input, chr(10)) FILTER (WHERE NOT compacted AND NOT gone) AS given, string_agg(output, chr(10)) FILTER (WHERE NOT compacted AND NOT gone AND status = 'completed') AS made, count(DISTINCT call_id) AS tools, count(DISTINCT call_id) FILTER (WHERE NOT compacted AND NOT gone) AS tools_in_context, count(DISTINCT call_id) FILTER (WHERE gone OR covered) AS tools_pruned FROM tl GROUP BY 1)",
        f"j AS (SELECT c.session_id, c.current_tokens AS total, CASE WHEN opening > 0 THEN greatest(0, opening - {tokens('f.said')}) ELSE 0 END AS system, {tokens('u.said')} AS user_, {tokens('given')} + {tokens('made')} AS tool_tokens, coalesce(tools, 0) AS tools, coalesce(tools_in_context, 0) AS tools_in_context, coalesce(tools_pruned, 0) AS tools_pruned, (SELECT count(*) FROM mm WHERE mm.session_id = c.session_id AND covered) AS messages_pruned FROM current c LEFT JOIN opened USING (session_id) LEFT JOIN users u USING (session_id) LEFT JOIN first_said f USING (session_id) LEFT JOIN tt USING (session_id))",
    )
    + "SELECT session_id, total, CAST(system AS BIGINT) AS system, user_ AS user, tool_tokens, CAST(greatest(0, total - system - user_ - tool_tokens) AS BIGINT) AS assistant, tools, tools_in_context, tools_pruned, messages_pruned FROM j",
    "call_labels": with_(LABELS) + "SELECT message_id, label, short FROM labels",
    "pruned_items": with_(
        DEDUP, LABELS,
        "listed AS (SELECT c.session_id, c.seq, c.part_seq, '→ ' || c.tool || CASE WHEN l.short <> '' THEN ': ' || CASE WHEN length(l.short) > 60 THEN left(l.short, 57) || '...' ELSE l.short END ELSE '' END AS line FROM dedup d JOIN calls c USING (call_id) JOIN labels l USING (call_id))",
        "whole AS (SELECT session_id, seq, part_seq, line FROM listed UNION ALL SELECT DISTINCT session_id, 1000000000, 0, '→ (1 tool with unknown metadata)' FROM m)",
    )
    + "SELECT session_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY seq, part_seq)) AS digest FROM whole GROUP BY 1",
    "message_progress": with_(
        "placed AS (SELECT session_id, message_id, seq - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM m)",
        "cells AS (SELECT p.session_id, c.cell, CASE WHEN message_id % 17 = 0 THEN '⣿' WHEN message_id % 29 = 0 THEN '░' ELSE '█' END AS mark FROM placed p JOIN range(20) c(cell) ON c.cell >= floor(p.i::DOUBLE / p.n * 20e0) AND c.cell < floor((p.i + 1)::DOUBLE / p.n * 20e0))",
    )
    + "SELECT session_id, '│' || string_agg(mark, '' ORDER BY cell) || '│' AS bar FROM cells GROUP BY 1",
    "current_models": with_(MODEL) + "SELECT * FROM model",
    "nudge_decisions": with_(
        CURRENT, MODEL, ANCHORS,
        "last AS (SELECT session_id, max(seq) AS seq, arg_max(role, seq) AS role FROM m WHERE NOT ignored GROUP BY 1)",
        "spoke AS (SELECT session_id, max(seq) AS seq, arg_max(compressed, seq) AS compressed FROM m WHERE role = 'assistant' GROUP BY 1)",
        "user_ AS (SELECT session_id, max(seq) AS seq FROM m WHERE role = 'user' AND NOT ignored GROUP BY 1)",
        "since AS (SELECT m.session_id, count(*) AS n FROM m JOIN user_ u ON u.session_id = m.session_id AND m.seq > u.seq WHERE NOT m.ignored GROUP BY 1)",
        "old AS (SELECT session_id, max(CASE WHEN kind = 'context' THEN seq END) AS context_at, max(CASE WHEN kind = 'iteration' THEN seq END) AS iteration_at FROM anchors WHERE seq % 5 = 0 GROUP BY 1)",
        """j AS (SELECT c.session_id, l.seq AS last_seq, l.role AS last_role, s.seq AS spoke_seq, u.seq AS user_seq, coalesce(n.n, 0) AS since, context_at, iteration_at,
            CASE WHEN s.compressed THEN 'compressed' WHEN current_tokens > CASE WHEN provider || '/' || model = 'p1/m2' THEN 250 ELSE 540 END THEN 'over'
                 WHEN current_tokens >= CASE WHEN provider || '/' || model = 'p0/m0' THEN 240 ELSE 120 END THEN 'between' ELSE 'below' END AS decision
            FROM current c LEFT JOIN last l USING (session_id) LEFT JOIN spoke s USING (session_id) LEFT JOIN user_ u USING (session_id) LEFT JOIN since n USING (session_id) LEFT JOIN old USING (session_id) LEFT JOIN model USING (session_id))""",
    )
    + """SELECT session_id, decision, CASE WHEN decision = 'over' AND (context_at IS NULL OR last_seq - context_at >= 3) THEN last_seq END AS context_seq,
        CASE WHEN decision = 'between' AND last_seq > user_seq AND since >= 2 AND (iteration_at IS NULL OR last_seq - iteration_at >= 3) THEN last_seq END AS iteration_seq,
        CASE WHEN decision = 'between' AND last_role = 'user' AND spoke_seq IS NOT NULL THEN last_seq END AS turn_user_seq, CASE WHEN decision = 'between' AND last_role = 'user' THEN spoke_seq END AS turn_assistant_seq FROM j""",
    "nudged_parts": with_(ANCHORS)
    + digest(
        PLAIN
        + f""" UNION ALL SELECT a.message_id, {PUT.format(n="CASE a.kind WHEN 'context' THEN 1 WHEN 'turn' THEN 2 ELSE 3 END")}, 'text', CASE a.kind WHEN 'context' THEN '[C]' WHEN 'turn' THEN '[T]' ELSE '[I]' END, NULL, NULL
            FROM anchors a JOIN m USING (message_id) WHERE a.kind <> 'turn' OR m.role = 'assistant'"""
    ),
    "tagged_parts": with_(REFS)
    + digest(
        f"""SELECT p.message_id, CAST(part_seq AS DOUBLE) AS place, type, text, input, CASE WHEN type = 'tool' AND status = 'completed' AND part_seq = (SELECT max(part_seq) FROM parts x WHERE x.message_id = p.message_id AND x.type = 'tool') THEN output || '<mid>' || ref || '</mid>' ELSE output END AS output FROM parts p LEFT JOIN refs USING (message_id)
            UNION ALL SELECT r.message_id, {PUT.format(n=1)}, 'text', '<mid>' || ref || '</mid>', NULL, NULL FROM refs r JOIN m USING (message_id) LEFT JOIN (SELECT DISTINCT message_id, status FROM parts WHERE type = 'tool') p ON p.message_id = r.message_id WHERE p.status IS DISTINCT FROM 'completed'"""
    ),
    "manual_prompt": with_("target AS (SELECT m.session_id, max(m.seq) AS seq FROM m JOIN parts p USING (message_id) WHERE m.role = 'user' AND NOT m.ignored AND p.type = 'text' AND NOT p.ignored GROUP BY 1)", "spot AS (SELECT m.message_id, min(p.part_seq) AS part_seq FROM target t JOIN m ON m.session_id = t.session_id AND m.seq = t.seq JOIN parts p USING (message_id) WHERE p.type = 'text' AND NOT p.ignored GROUP BY 1)")
    + digest("SELECT p.message_id, CAST(p.part_seq AS DOUBLE) AS place, type, CASE WHEN s.message_id IS NOT NULL THEN 'do it' ELSE text END AS text, input, output FROM parts p LEFT JOIN spot s ON s.message_id = p.message_id AND s.part_seq = p.part_seq"),
    "scrubbed_parts": with_() + digest("SELECT message_id, CAST(part_seq AS DOUBLE) AS place, type, CASE WHEN type = 'text' THEN replace(text, '<note>gone</note>', '') ELSE text END AS text, input, output FROM parts"),
    "snapshot": with_() + "SELECT m.session_id, m.seq, provider || '/' || model AS model, count(*) AS n_parts FROM m JOIN parts p USING (message_id) WHERE p.type IN ('text', 'reasoning', 'tool') AND NOT (p.type = 'text' AND p.ignored) GROUP BY 1, 2, 3",
    "subagent_results": with_(RESULTS) + "SELECT * FROM results",
    "subagent_outputs": with_(DEDUP, RESULTS)
    + """SELECT p.session_id, p.message_id, p.call_id, md5(replace(replace(p.output, chr(10) || 'old' || chr(10), chr(10) || r.result || chr(10)), '<note>gone</note>', '')) AS digest FROM parts p JOIN results r ON r.session_id = p.child AND r.result <> ''
        WHERE p.tool = 'task' AND p.status = 'completed' AND p.call_id IS NOT NULL AND p.call_id NOT IN (SELECT call_id FROM dedup)""",
    "sessions_with_parts": with_() + "SELECT m.session_id, m.message_id, role, count(p.type) AS n_parts FROM m LEFT JOIN parts p USING (message_id) GROUP BY 1, 2, 3",
    "compressed_ranges": with_(REFS, RANGES, MESSAGE_TOKENS)
    + """SELECT i.session_id, i.start_seq, i.end_seq, count(*) AS n_messages, CAST(sum(t.tokens) AS BIGINT) AS compressed_tokens, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS n_tools
        FROM inside i JOIN message_tokens t USING (message_id) LEFT JOIN (SELECT message_id, count(DISTINCT call_id) AS n FROM parts WHERE type = 'tool' GROUP BY 1) p USING (message_id) GROUP BY 1, 2, 3""",
    "pruned_counts": with_(REFS, RANGES, DEDUP, "ids AS (SELECT session_id, call_id FROM dedup UNION SELECT i.session_id, p.call_id FROM inside i JOIN parts p USING (message_id) WHERE p.call_id IS NOT NULL)")
    + "SELECT session_id, coalesce(t.n, 0) AS tools, coalesce(i.n, 0) AS messages FROM (SELECT session_id, count(*) AS n FROM ids GROUP BY 1) t FULL JOIN (SELECT session_id, count(*) AS n FROM inside GROUP BY 1) i USING (session_id)",
    "project_list": "SELECT lang AS id, arg_max(source, doc_id) AS worktree FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY max(doc_id) DESC, 1",
    "session_row_list": "SELECT doc_id AS id, lang AS \"projectID\", CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id / 5 AS BIGINT) END AS \"parentID\", source AS directory, left(split_part(text, chr(10), 1), 60) AS title, doc_id AS created, doc_id AS updated FROM documents",
    "child_session_messages": "SELECT conv_id AS session_id, CAST(conv_id / 5 AS BIGINT) AS parent_session_id, turn AS seq, role FROM conversations WHERE conv_id % 5 = 0 AND conv_id IN (SELECT doc_id FROM documents)",
}
