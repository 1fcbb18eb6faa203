"""The registered queries restated in SQL over the same tables, for checking.

``WIRE`` repeats the derivation of ``bridge.event_frames``; the queries then state
their answer with plain windows and joins, independent of the Spark plans.
"""

from __future__ import annotations

_K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"


def wire(session: str = "'u' || user_id", extra: str = "", source: str = "events") -> str:
    """CTEs k, w (classified lines), p (pairing) and e (events)."""
    return f"""
k AS (SELECT {session} AS session_id, {extra} event_id AS ord, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
             event_type AS t, {_K} AS k FROM {source}),
w AS (SELECT *, 't' || (k % 20) AS tool,
        CASE WHEN t = 'click' OR (t = 'view' AND k < 50) THEN 'call'
             WHEN t = 'view' AND k < 60 THEN 'client_note'
             WHEN t = 'view' AND k < 70 THEN 'client_request'
             WHEN t = 'view' AND k < 80 THEN 'server_message'
             WHEN t = 'view' AND k < 90 THEN 'client_reply'
             WHEN t = 'view' AND k < 95 THEN 'client_request'
             WHEN t = 'view' THEN 'raw' ELSE 'response' END AS role,
        CASE WHEN t = 'click' OR (t = 'view' AND k < 50) THEN 'tools/call'
             WHEN t <> 'view' THEN NULL
             WHEN k < 60 THEN 'notifications/initialized'
             WHEN k < 70 THEN 'tools/list'
             WHEN k < 80 THEN ['sampling/createMessage','roots/list','elicitation/create','ping','custom/notify'][k % 5 + 1]
             WHEN k < 90 THEN NULL WHEN k < 95 THEN 'initialize' END AS method,
        CASE WHEN t = 'view' AND k BETWEEN 70 AND 89 THEN k % 3
             WHEN t = 'view' AND (k BETWEEN 50 AND 59 OR k >= 95) THEN NULL ELSE k % 5 END AS id,
        CASE WHEN t = 'click' AND k % 25 = 0 THEN 'blocked' WHEN t = 'click' AND k % 25 = 1 THEN 'gate_skipped'
             WHEN t = 'error' AND k % 25 = 0 THEN 'injected'
             WHEN t = 'view' AND k % 25 = 2 THEN 'gate_disabled' END AS gate
      FROM k),
s AS (SELECT *, CASE WHEN id IS NULL THEN NULL
                     WHEN role IN ('call', 'client_request', 'response') THEN 'client'
                     WHEN role IN ('server_message', 'client_reply') THEN 'server' END AS space,
             role IN ('call', 'client_request', 'server_message') AS opens,
             CASE WHEN role = 'call' THEN tool ELSE '<' || method || '>' END AS label FROM w),
p AS (SELECT *, lag(opens) OVER q AS b_opens, lag(label) OVER q AS b_label, lag(ord) OVER q AS b_ord
      FROM s WINDOW q AS (PARTITION BY session_id, space, id ORDER BY ord)),
m AS (SELECT *, role IN ('response', 'client_reply') AND space IS NOT NULL AND coalesce(b_opens, false) AS matched FROM p),
e AS (SELECT session_id, ord, ts, t, k, role, method, id, tool, gate, label, matched, {('server_key,' if extra else '')}
        CASE WHEN role IN ('raw', 'server_message', 'response') THEN 'server' ELSE 'client' END AS actor,
        CASE WHEN role = 'call' THEN 'tool_call'
             WHEN role = 'response' AND matched AND NOT starts_with(b_label, '<') THEN 'tool_result'
             WHEN role = 'response' THEN 'state_change' ELSE 'message' END AS kind,
        CASE WHEN matched THEN b_label END AS responds_to, CASE WHEN matched THEN b_ord END AS request,
        role IN ('response', 'client_reply') AND NOT matched AS orphaned,
        t = 'error' AS has_error FROM m)"""


WIRE = wire()

_DECLARED = "d AS (SELECT DISTINCT session_id, tool FROM e WHERE t = 'signup')"
_NAMES = "n AS (SELECT session_id, ord, tool FROM e WHERE kind = 'state_change' AND t = 'signup' AND responds_to = '<tools/list>')"
_STEPS = """c AS (SELECT session_id,
        min(CASE WHEN role = 'client_note' THEN ord END) AS init_ord,
        min(CASE WHEN role = 'client_request' AND method = 'tools/list' THEN ord END) AS list_ord,
        min(CASE WHEN kind = 'state_change' AND t = 'signup' AND responds_to = '<tools/list>' THEN ord END) AS surface_ord,
        max(CASE WHEN method = 'initialize' THEN ord END) AS hello_ord,
        max(CASE WHEN t = 'purchase' AND k >= 90 AND responds_to = '<initialize>' THEN ord
                 WHEN t IN ('purchase', 'signup') AND responds_to = '<initialize>' THEN ord END) AS welcome_ord
      FROM e GROUP BY session_id)"""

# ---- findings, one CTE per detector ----------------------------------------------------

_FINDINGS = f"""{_DECLARED}, {_NAMES}, {_STEPS},
f_fab AS (SELECT e.session_id, e.ord AS seq, 'hallucination' AS kind, 'fabricated_tool_call' AS subcategory, 3 AS severity,
    'tools/call ''' || e.tool || ''' is outside the declared surface' AS explanation, e.tool
  FROM e WHERE kind = 'tool_call' AND NOT EXISTS (SELECT 1 FROM d WHERE d.session_id = e.session_id AND d.tool = e.tool)),
f_surface AS (SELECT session_id, ord AS seq, 'divergence' AS kind, 'surface_change' AS subcategory, 2 AS severity,
    'tools/list surface changed mid-session; delta: [''' || least(tool, first_tool) || ''', ''' || greatest(tool, first_tool) || ''']' AS explanation,
    NULL AS tool
  FROM (SELECT *, first_value(tool) OVER (PARTITION BY session_id ORDER BY ord) AS first_tool FROM n) WHERE tool <> first_tool),
f_order AS (SELECT e.session_id, e.ord AS seq, 'anomaly' AS kind,
    CASE WHEN coalesce(init_ord < ord, false) THEN 'call_before_declaration' ELSE 'premature_call' END AS subcategory,
    CASE WHEN coalesce(init_ord < ord, false) THEN 1 ELSE 2 END AS severity,
    'tools/call ''' || tool || CASE WHEN coalesce(init_ord < ord, false) THEN ''' and no tools/list request was ever sent'
         ELSE ''' before notifications/initialized' END AS explanation, tool
  FROM e JOIN c USING (session_id) WHERE kind = 'tool_call'
   AND (NOT coalesce(init_ord < ord, false) OR (NOT coalesce(surface_ord < ord, false) AND NOT coalesce(list_ord < ord, false)))),
f_schema AS (SELECT e.session_id, e.ord AS seq, 'divergence' AS kind, 'schema_violation' AS subcategory, 2 AS severity,
    '''' || e.tool || ''': ' || CASE k % 4 WHEN 0 THEN 'missing required argument ''q'''
       WHEN 1 THEN 'argument ''q'' is int, schema expects string'
       ELSE 'unexpected argument ''extra'' (additionalProperties: false)' END AS explanation, e.tool
  FROM e JOIN d ON d.session_id = e.session_id AND d.tool = e.tool WHERE e.t = 'click' AND k % 4 < 3),
h AS (SELECT e.session_id, CASE WHEN e.k % 2 = 0 THEN 'sampling' ELSE 'roots' END AS granted FROM e JOIN c ON e.session_id = c.session_id AND e.ord = c.hello_ord),
f_server AS (SELECT e.session_id, e.ord AS seq, 'anomaly' AS kind,
    CASE WHEN method = 'custom/notify' THEN 'unknown_server_request' ELSE 'capability_violation' END AS subcategory,
    CASE WHEN method = 'custom/notify' THEN 2 ELSE 3 END AS severity,
    CASE WHEN method = 'custom/notify' THEN 'server-initiated request ''custom/notify'' is not a known MCP client capability'
         ELSE 'server requested ''' || method || ''' but the client never granted the ''' || split_part(method, '/', 1) || ''' capability' END AS explanation,
    NULL AS tool
  FROM e LEFT JOIN h USING (session_id) WHERE role = 'server_message' AND method <> 'ping'
   AND (method = 'custom/notify' OR (granted IS NOT NULL AND granted <> split_part(method, '/', 1)))),
f_orphan AS (SELECT session_id, ord AS seq, 'anomaly' AS kind, 'orphaned_response' AS subcategory, 1 AS severity,
    'response id=' || id || ' matched no request' AS explanation, NULL AS tool FROM e WHERE orphaned),
f_gate AS (SELECT session_id, ord AS seq, 'info' AS kind,
    CASE gate WHEN 'blocked' THEN 'gate_blocked' WHEN 'injected' THEN 'gate_injected_response' ELSE 'gate_skipped' END AS subcategory,
    1 AS severity,
    CASE gate WHEN 'blocked' THEN 'gate blocked tools/call ''' || tool || ''' — outside the declared surface; the server never saw this frame'
       WHEN 'injected' THEN 'error response synthesized by the gate for blocked call ''' || tool || '''; the server never sent this frame'
       ELSE 'gate failed open for tools/call ''' || tool || ''' — no tools/list response arrived within the hold window, so this call was forwarded unenforced' END AS explanation,
    tool FROM e WHERE gate IN ('blocked', 'injected', 'gate_skipped')),
f AS (SELECT * FROM f_fab UNION ALL SELECT * FROM f_surface UNION ALL SELECT * FROM f_order UNION ALL SELECT * FROM f_schema
      UNION ALL SELECT * FROM f_server UNION ALL SELECT * FROM f_orphan UNION ALL SELECT * FROM f_gate)"""

_FINDING_COLUMNS = "session_id, seq, kind, subcategory, severity, explanation, tool"


def _finding(cte: str) -> str:
    return f"WITH {WIRE}, {_FINDINGS} SELECT {_FINDING_COLUMNS} FROM {cte}"


EVENT_SQL = {
    "event_classification": f"WITH {WIRE} SELECT session_id, actor, role, kind, count(*) AS events FROM e GROUP BY ALL",
    "request_pairing": f"""WITH {WIRE} SELECT session_id, ord AS seq, kind, responds_to, request AS request_seq, orphaned
        FROM e WHERE role IN ('response', 'client_reply')""",
    "pairing_totals": f"""WITH {WIRE} SELECT role, count(*) AS responses, count(*) FILTER (WHERE matched) AS matched,
        count(*) FILTER (WHERE orphaned) AS orphaned FROM e WHERE role IN ('response', 'client_reply') GROUP BY role""",
    "causal_parent": f"""WITH {WIRE} SELECT session_id, ord AS seq,
        coalesce(request, lag(ord) OVER (PARTITION BY session_id ORDER BY ord)) AS parent_seq FROM e""",
    "declared_surface": f"WITH {WIRE}, {_DECLARED} SELECT session_id, tool AS tool_name FROM d",
    "unused_declared": f"""WITH {WIRE}, {_DECLARED} SELECT session_id, tool AS tool_name FROM d
        WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'tool_call' AND e.session_id = d.session_id AND e.tool = d.tool)""",
    "called_tools": f"""WITH {WIRE} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS nth,
        tool AS tool_name, ord AS seq FROM e WHERE kind = 'tool_call'""",
    "session_context": f"""WITH {WIRE}, {_STEPS} SELECT c.session_id,
        '{{"' || CASE a.k % 2 WHEN 0 THEN 'sampling' WHEN 1 THEN 'roots' END || '":{{}}}}' AS client_capabilities,
        CASE WHEN b.t = 'purchase' AND b.k >= 90 THEN 'srv' || (b.k % 3) END AS server_name,
        CASE WHEN b.t = 'purchase' AND b.k >= 90 THEN '1.' || (b.k % 2) END AS server_version,
        x.first_ts, x.last_ts, x.event_count, x.final_state
      FROM c JOIN (SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS event_count,
                     CASE WHEN bool_or(has_error) THEN 'failed' ELSE 'completed' END AS final_state FROM e GROUP BY 1) x USING (session_id)
      LEFT JOIN e a ON a.ord = c.hello_ord LEFT JOIN e b ON b.ord = c.welcome_ord""",
    "fabricated_calls": _finding("f_fab"),
    "surface_changes": _finding("f_surface"),
    "call_order": _finding("f_order"),
    "schema_violations": _finding("f_schema"),
    "server_requests": _finding("f_server"),
    "orphaned_responses": _finding("f_orphan"),
    "gate_actions": _finding("f_gate"),
    "all_findings": f"WITH {WIRE}, {_FINDINGS} SELECT session_id, subcategory, severity, count(*) AS findings, min(seq) AS first_seq FROM f GROUP BY ALL",
}

# ---- roll-ups ----------------------------------------------------------------------------

_ALL = f"WITH {WIRE}, {_FINDINGS}"
_SEVERE = "sv AS (SELECT session_id, seq, max(severity) FILTER (WHERE kind <> 'info') AS severity, bool_or(kind = 'info') AS is_info FROM f GROUP BY 1, 2)"
_CONSOLE = """CASE WHEN role = 'raw' THEN 'raw (unparsed line)' WHEN kind = 'tool_call' THEN 'tools/call ' || tool
    WHEN kind = 'tool_result' THEN 'result id=' || id WHEN method IS NOT NULL THEN method ELSE 'result id=' || id END"""
_TEXT = f"substr(ts, 12, 8) || ' ' || CASE WHEN actor = 'client' THEN '→' ELSE '←' END || ' ' || {_CONSOLE}"

ROLLUP_SQL = {
    "session_verdicts": f"""{_ALL}, x AS (SELECT session_id, coalesce(max(severity), 0) AS max_severity,
          count(*) FILTER (WHERE severity = 3) AS severity_3, count(*) FILTER (WHERE severity = 2) AS severity_2,
          count(*) FILTER (WHERE severity = 1) AS severity_1
        FROM (SELECT DISTINCT session_id FROM e) LEFT JOIN (SELECT * FROM f WHERE kind <> 'info') USING (session_id) GROUP BY 1)
      SELECT *, ['CLEAN', 'WORTH A LOOK', 'SHOULD NOT HAPPEN', 'HOSTILE OR HALLUCINATED'][max_severity + 1] AS verdict,
        ['behavior matched declaration', 'low-severity anomalies present', 'protocol contract broken',
         'calls or requests outside any declaration'][max_severity + 1] AS verdict_text FROM x""",
    "session_summary": f"""{_ALL}, called AS (SELECT session_id, tool, count(*) AS calls FROM e WHERE kind = 'tool_call' GROUP BY 1, 2),
        t AS (SELECT session_id, count(d.tool) AS declared_tools, coalesce(sum(calls), 0)::BIGINT AS calls, count(called.tool) AS called_tools,
          count(*) FILTER (WHERE called.tool IS NULL) AS unused_declared,
          coalesce(sum(calls) FILTER (WHERE d.tool IS NULL), 0)::BIGINT AS fabricated_calls
          FROM d FULL JOIN called USING (session_id, tool) GROUP BY 1)
      SELECT x.session_id, frames_parsed, coalesce(declared_tools, 0) AS declared_tools, coalesce(calls, 0) AS calls,
        coalesce(called_tools, 0) AS called_tools, coalesce(unused_declared, 0) AS unused_declared,
        coalesce(fabricated_calls, 0) AS fabricated_calls, coalesce(v.n, 0) AS context_violations
      FROM (SELECT session_id, count(*) FILTER (WHERE role <> 'raw') AS frames_parsed FROM e GROUP BY 1) x
      LEFT JOIN t USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS n FROM f WHERE kind <> 'info' AND subcategory <> 'fabricated_tool_call' GROUP BY 1) v USING (session_id)""",
    "error_taxonomy": f"""WITH {WIRE} SELECT session_id, ord AS seq,
        CASE WHEN kind = 'state_change' THEN 'protocol_error' ELSE 'tool_error' END AS error_kind,
        CASE WHEN has_error THEN 'e' || (k % 10) ELSE '{{"content":[],"isError":true}}' END AS message
      FROM e WHERE (has_error AND kind IN ('state_change', 'tool_result')) OR (kind = 'tool_result' AND t = 'purchase' AND k < 90 AND k % 7 = 0)""",
    "tool_heatmap": f"""{_ALL}, {_SEVERE} SELECT e.session_id, rt AS tool, count(*) FILTER (WHERE e.kind = 'tool_call') AS calls,
        count(*) FILTER (WHERE e.kind = 'tool_result' AND (has_error OR (t = 'purchase' AND k < 90 AND k % 7 = 0))) AS errors,
        coalesce(max(sv.severity), 0) AS max_severity, bool_and(d.tool IS NULL) AS fabricated
      FROM (SELECT *, CASE WHEN kind = 'tool_call' THEN tool ELSE responds_to END AS rt FROM e WHERE kind IN ('tool_call', 'tool_result')) e
      LEFT JOIN sv ON sv.session_id = e.session_id AND sv.seq = e.ord
      LEFT JOIN d ON d.session_id = e.session_id AND d.tool = rt GROUP BY 1, 2 HAVING count(*) FILTER (WHERE e.kind = 'tool_call') > 0""",
    "session_counters": f"""{_ALL} SELECT session_id, frames, server_requests, gate_on, coalesce(fabricated, 0) AS fabricated, coalesce(violations, 0) AS violations
      FROM (SELECT session_id, count(*) AS frames, count(*) FILTER (WHERE role = 'server_message') AS server_requests,
              bool_or(gate IS NOT NULL) AS gate_on FROM e GROUP BY 1)
      LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE subcategory = 'fabricated_tool_call') AS fabricated,
              count(*) FILTER (WHERE kind <> 'info' AND subcategory <> 'fabricated_tool_call') AS violations FROM f GROUP BY 1) USING (session_id)""",
    "report_labels": f"""WITH {WIRE} SELECT CASE WHEN kind = 'tool_call' THEN 'tools/call · ' || tool
        WHEN kind = 'tool_result' THEN 'tool result · ' || responds_to || CASE WHEN has_error OR (t = 'purchase' AND k < 90 AND k % 7 = 0) THEN ' · ERROR' ELSE '' END
        WHEN role = 'raw' THEN 'unparseable wire line'
        WHEN kind = 'message' AND responds_to IS NOT NULL THEN 'reply to ' || responds_to
        WHEN role = 'server_message' THEN method || ' · server-initiated request'
        WHEN role = 'client_note' THEN method || ' · notification'
        WHEN kind = 'message' THEN coalesce(method, 'message') WHEN has_error THEN 'protocol error'
        WHEN responds_to IS NOT NULL THEN 'response · ' || responds_to ELSE 'state change' END AS label, count(*) AS events FROM e GROUP BY 1""",
    "timeline_view": f"""{_ALL}, {_SEVERE}, x AS (SELECT e.session_id, row_number() OVER (PARTITION BY e.session_id ORDER BY ord) - 1 AS row_index,
          count(*) OVER (PARTITION BY e.session_id) AS n, {_TEXT} AS text, coalesce(sv.severity, 0) AS severity, coalesce(is_info, false) AS is_info
        FROM e LEFT JOIN sv ON sv.session_id = e.session_id AND sv.seq = e.ord)
      SELECT session_id, row_index, text, severity, is_info, 0 AS collapsed_rows FROM x""",
    "timeline_search": f"""WITH {WIRE} SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS row_index, {_TEXT} AS text FROM e)
      WHERE contains(lower(text), 'tools/list')""",
    "findings_view": f"""{_ALL}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY severity DESC, seq, subcategory, explanation) AS rank FROM f)
      SELECT session_id, rank, seq, severity, subcategory FROM x""",
    "severity_floor": f"{_ALL} SELECT subcategory, CASE severity WHEN 3 THEN 'error' ELSE 'warning' END AS level, count(*) AS findings FROM f WHERE severity >= 2 GROUP BY 1, 2",
    "gate_status": f"WITH {WIRE} SELECT session_id, count(*) AS blocked_count FROM e WHERE gate = 'blocked' GROUP BY 1",
    "policy_verdicts": f"""WITH {WIRE}, u AS (SELECT *, CASE WHEN t = 'signup' THEN tool END AS listed, CASE WHEN t = 'signup' THEN ts END AS listed_at FROM e),
        x AS (SELECT *, last_value(listed IGNORE NULLS) OVER b AS latest, first_value(listed IGNORE NULLS) OVER a AS nxt,
                first_value(listed_at IGNORE NULLS) OVER a AS nxt_at FROM u
              WINDOW b AS (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     a AS (PARTITION BY session_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        y AS (SELECT *, CASE WHEN latest IS NOT NULL THEN latest
                WHEN epoch_us(nxt_at::TIMESTAMP) - epoch_us(ts::TIMESTAMP) <= 3600000000 THEN nxt END AS known FROM x WHERE kind = 'tool_call')
      SELECT session_id, ord AS seq, tool AS tool_name, CASE WHEN known IS NULL THEN 'gate_skipped' WHEN known = tool THEN 'forward' ELSE 'blocked' END AS verdict FROM y""",
}

# ---- one log per user and day --------------------------------------------------------------

_DAILY = wire(
    "strftime(ts, '%Y%m%d') || '_s' || (user_id % 10) || '_u' || user_id", "'s' || (user_id % 10) AS server_key,"
)
_LOGS = "l AS (SELECT session_id, server_key, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS frames, count(*) FILTER (WHERE gate = 'blocked') AS blocked FROM e GROUP BY 1, 2)"
_WELCOME = "z AS (SELECT session_id, CASE WHEN t = 'purchase' AND k >= 90 THEN 'srv' || (k % 3) END AS server_name, CASE WHEN t = 'purchase' AND k >= 90 THEN '1.' || (k % 2) END AS server_version, CASE WHEN t = 'purchase' AND k >= 90 THEN 'cap' || (k % 4) END AS cap FROM e WHERE t <> 'error' AND role = 'response' AND responds_to = '<initialize>' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) = 1)"
_HASH = "substr(sha256('{\"additionalProperties\":false,\"properties\":{\"n\":{\"type\":\"integer\"},\"q\":{\"type\":\"string\"}},\"required\":[\"q\"],\"type\":\"object\"}'), 1, 12)"
_ITEMS = f"""{_DECLARED}, {_WELCOME},
i AS (SELECT session_id, 'declared' AS kind, tool AS item FROM d
  UNION ALL SELECT DISTINCT session_id, 'called', tool FROM e WHERE kind = 'tool_call'
  UNION ALL SELECT DISTINCT e.session_id, 'fabricated', e.tool FROM e ANTI JOIN d USING (session_id, tool) WHERE e.kind = 'tool_call'
  UNION ALL SELECT DISTINCT session_id, 'request', method FROM e WHERE role = 'server_message'
  UNION ALL SELECT session_id, 'capability', cap FROM z WHERE cap IS NOT NULL)"""
_DRIFT = f"""{_ITEMS}, {_LOGS},
o AS (SELECT *, row_number() OVER (PARTITION BY server_key ORDER BY first_ts, session_id) AS nth FROM l LEFT JOIN z USING (session_id)),
pl AS (SELECT o.server_key, o.nth, i.* FROM i JOIN o USING (session_id)),
first_seen AS (SELECT *, row_number() OVER (PARTITION BY server_key, kind, item ORDER BY nth) AS rn FROM pl),
novel AS (SELECT server_key, session_id, CASE kind WHEN 'declared' THEN 'new_declared_tool' WHEN 'fabricated' THEN 'new_fabricated_tool'
     WHEN 'called' THEN 'new_called_tool' WHEN 'request' THEN 'new_server_request' ELSE 'new_capability' END AS kind,
   CASE kind WHEN 'declared' THEN 2 WHEN 'fabricated' THEN 3 WHEN 'request' THEN 2 ELSE 1 END AS severity,
   CASE kind WHEN 'declared' THEN 'server now declares ''' || item || ''' — never in its surface before'
     WHEN 'fabricated' THEN 'tools/call ''' || item || ''' outside any declared surface, first time in this server''s history'
     WHEN 'called' THEN '''' || item || ''' called for the first time across all sessions'
     WHEN 'request' THEN 'server-initiated request ''' || item || ''' never seen before'
     ELSE 'server now advertises the ''' || item || ''' capability' END AS explanation
   FROM first_seen fs WHERE rn = 1 AND nth > 1
    AND NOT (kind = 'called' AND EXISTS (SELECT 1 FROM pl WHERE pl.kind = 'fabricated' AND pl.session_id = fs.session_id AND pl.item = fs.item))),
listed AS (SELECT DISTINCT server_key, session_id, nth FROM pl WHERE kind = 'declared'),
prev AS (SELECT *, lag(session_id) OVER (PARTITION BY server_key ORDER BY nth) AS prev_session FROM listed),
removed AS (SELECT prev.server_key, prev.session_id, 'removed_declared_tool' AS kind, 1 AS severity,
   '''' || d.tool || ''' disappeared from the declared surface' AS explanation
   FROM prev JOIN d ON d.session_id = prev.prev_session
   WHERE NOT EXISTS (SELECT 1 FROM d d2 WHERE d2.session_id = prev.session_id AND d2.tool = d.tool)),
named AS (SELECT * FROM o WHERE server_name IS NOT NULL),
renamed AS (SELECT server_key, session_id, 'server_identity_changed' AS kind, 2 AS severity, 'serverInfo.name changed to ''' || server_name || '''' AS explanation
   FROM (SELECT *, row_number() OVER (PARTITION BY server_key, server_name ORDER BY nth) AS rn, min(nth) OVER (PARTITION BY server_key) AS any_nth FROM named) WHERE rn = 1 AND nth > any_nth),
upgraded AS (SELECT server_key, session_id, 'server_version_changed' AS kind, 1 AS severity, '''' || server_name || ''' version changed to ' || server_version AS explanation
   FROM (SELECT *, row_number() OVER (PARTITION BY server_key, server_name, server_version ORDER BY nth) AS rn,
           min(nth) OVER (PARTITION BY server_key, server_name) AS name_nth FROM named) WHERE rn = 1 AND nth > name_nth),
g AS (SELECT * FROM novel UNION ALL SELECT * FROM removed UNION ALL SELECT * FROM renamed UNION ALL SELECT * FROM upgraded)"""

DAILY_SQL = {
    "session_metrics": f"""WITH {_DAILY} SELECT session_id, count(*) AS frames_seen, count(*) FILTER (WHERE gate = 'blocked') AS frames_blocked,
        round((epoch_us(max(ts)::TIMESTAMP) - epoch_us(min(ts)::TIMESTAMP)) / 1e6, 3) AS session_duration_s FROM e GROUP BY 1""",
    "session_listing": f"""WITH {_DAILY}, {_LOGS} SELECT session_id, frames,
        (epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(last_ts::TIMESTAMP)) / 1e6 < 5 AS live FROM l""",
    "health_of_newest": f"""WITH {_DAILY}, {_LOGS}, x AS (SELECT * FROM l ORDER BY session_id DESC LIMIT 10)
      SELECT count(*) AS sessions, sum(frames)::BIGINT AS frames_seen, sum(blocked)::BIGINT AS frames_blocked,
        round(sum(round((epoch_us(last_ts::TIMESTAMP) - epoch_us(first_ts::TIMESTAMP)) / 1e6, 3)), 3) AS session_duration_s,
        0 AS sessions_missing_metrics, 0 AS detector_errors, 0 AS tail_only_sessions, 'healthy' AS verdict FROM x""",
    "retention_plan": f"""WITH {_DAILY}, {_LOGS} SELECT session_id, 'delete' AS action FROM l
        WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last_ts::TIMESTAMP)) >= 864000""",
    "retention_result": f"""WITH {_DAILY}, {_LOGS} SELECT count(*) AS candidates, count(*) AS deletable, 0 AS protected, count(*) > 100 AS breach FROM l
        WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last_ts::TIMESTAMP)) >= 864000""",
    "fingerprints": f"""WITH {_DAILY}, {_LOGS}, {_WELCOME} SELECT session_id, server_key, first_ts, last_ts, server_name, frames AS event_count
        FROM l LEFT JOIN z USING (session_id)""",
    "fingerprint_items": f"WITH {_DAILY}, {_ITEMS} SELECT session_id, kind, count(*) AS items FROM i GROUP BY 1, 2",
    "schema_hashes": f"WITH {_DAILY}, {_ITEMS} SELECT session_id, tool AS item, {_HASH} AS hash FROM d",
    "drift": f"WITH {_DAILY}, {_DRIFT} SELECT * FROM g",
    "drift_histogram": f"""WITH {_DAILY}, {_DRIFT} SELECT server_key, l.session_id, coalesce(a, 0) AS severity_3, coalesce(b, 0) AS severity_2,
        coalesce(c, 0) AS severity_1, coalesce(w, 0) AS worst, coalesce(w, 0) >= 2 AS alert
      FROM l LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE severity = 3) AS a, count(*) FILTER (WHERE severity = 2) AS b,
          count(*) FILTER (WHERE severity = 1) AS c, max(severity) AS w FROM g GROUP BY 1) x ON x.session_id = l.session_id""",
}

# ---- sensitive values -----------------------------------------------------------------------
#
# RE2 has no look-around.  A pattern bounded by characters outside its own alphabet
# matches whole runs of that alphabet, so runs are extracted and matched in full; for
# private addresses every separator is doubled so that neighbours keep their own.


def _values(text: str) -> str:
    """SQL list of (category, severity, value) hits of a text expression.

    Only the categories whose shapes occur in the tables are restated; the others
    are covered by fixtures.
    """

    def runs(alphabet: str, category: str, severity: int, test: str) -> str:
        return (
            f"[{{'category': '{category}', 'severity': {severity}, 'value': v}} "
            f"for v in regexp_extract_all({text}, '[{alphabet}]+') if {test}]"
        )

    luhn = _luhn("v")
    parts = [
        runs("A-Za-z0-9/+=", "aws_secret_key", 3, f"len(v) = 40 AND {_entropy('v')} > 4.0"),
        runs("0-9", "credit_card", 3,
             "regexp_full_match(v, '4[0-9]{12}([0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(011|5[0-9]{2})[0-9]{12}') AND " + luhn),
        runs("A-Z0-9", "iban", 3, f"regexp_full_match(v, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND {_IBAN}"),
        f"[{{'category': 'email_address', 'severity': 1, 'value': v}} for v in regexp_extract_all({text}, '[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9.-]{{1,255}}\\.[A-Za-z]{{2,}}')]",
        f"[{{'category': 'private_ip', 'severity': 1, 'value': v}} for v in regexp_extract_all(' ' || regexp_replace({text}, '([^0-9.])', '\\1\\1', 'g') || ' ', "
        "'[^0-9](10\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}|172\\.(?:1[6-9]|2[0-9]|3[01])\\.[0-9]{1,3}\\.[0-9]{1,3}|192\\.168\\.[0-9]{1,3}\\.[0-9]{1,3})[^0-9]', 1)]",
    ]
    joined = " || ".join(parts)
    return f"list_distinct({joined})"


def _luhn(value: str) -> str:
    return (
        f"list_sum([CASE WHEN (len({value}) - i) % 2 = 0 THEN substr({value}, i, 1)::INT "
        f"ELSE (substr({value}, i, 1)::INT * 2) // 10 + (substr({value}, i, 1)::INT * 2) % 10 END "
        f"for i in range(1, len({value}) + 1)]) % 10 = 0"
    )


_IBAN = (
    "list_reduce([0] || [CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END "
    "for c in string_split(substr(v, 5) || substr(v, 1, 4), '')], "
    "lambda a, d: CASE WHEN d >= 10 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) = 1"
)


def _entropy(value: str) -> str:
    """Bits per character: the sum over distinct characters of -p log2 p."""
    share = f"(len({value}) - len(replace({value}, c, ''))) / len({value})::DOUBLE"
    return f"list_sum([-({share}) * log2({share}) for c in list_distinct(string_split({value}, ''))])"


def _tagged(text: str, hits: str) -> str:
    """The text with every hit value replaced by its tag, longest value first."""
    ordered = f"list_sort([{{'n': -len(h.value), 'v': h.value, 'c': h.category}} for h in {hits}])"
    return (
        f"list_reduce([{{'n': 0, 'v': {text}, 'c': ''}}] || {ordered}, "
        "lambda a, h: {'n': 0, 'v': replace(a.v, h.v, '[' || h.c || ' redacted · ' || len(h.v) || ' chars]'), 'c': ''}).v"
    )


_HITS = f"h AS (SELECT doc_id, lang, source, text, unnest({_values('text')}) AS hit FROM documents)"
_DESCRIPTIONS = """CASE hit.category WHEN 'aws_secret_key' THEN 'AWS secret access key (entropy)' WHEN 'credit_card' THEN 'credit card number (Luhn)'
    WHEN 'iban' THEN 'International Bank Account Number (IBAN, MOD-97)' WHEN 'email_address' THEN 'email address' ELSE 'private IP address (RFC 1918)' END"""
# A value is replaced at its first place only, so a text that repeats one is withheld.
_SHOWN = f"""x AS (SELECT doc_id, text, {_values('text')} AS hits FROM documents),
    y AS (SELECT doc_id, text, CASE WHEN len([h for h in hits if len(text) - len(replace(text, h.value, '')) > len(h.value)]) > 0
        THEN '[redaction unavailable — content withheld]' ELSE {_tagged('text', 'hits')} END AS shown FROM x)"""

TEXT_SQL = {
    "document_hits": f"WITH {_HITS} SELECT doc_id, hit.category AS category, hit.severity AS severity, hit.value AS value FROM h",
    "page_hits": f"WITH h AS (SELECT page_id, unnest({_values('html')}) AS hit FROM pages) SELECT page_id, hit.category AS category, count(*) AS values FROM h GROUP BY 1, 2",
    "argument_leaks": f"""WITH j AS (SELECT doc_id, lang, source, CAST(to_json(text) AS VARCHAR) AS text FROM documents),
        h AS (SELECT doc_id, lang, source, unnest({_values('text')}) AS hit FROM j)
      SELECT source AS session_id, doc_id AS seq, 'pii_' || hit.category AS subcategory, hit.severity AS severity,
        'tools/call ''read_' || lang || ''' argument contains ' || {_DESCRIPTIONS} || ': [' || hit.category || ' redacted · ' || len(hit.value) || ' chars]' AS explanation FROM h""",
    "result_leaks": f"""WITH j AS (SELECT doc_id, source, CAST(to_json(text) AS VARCHAR) AS text FROM documents),
        h AS (SELECT doc_id, source, unnest({_values('text')}) AS hit FROM j)
      SELECT source AS session_id, doc_id * 2 + 1 AS seq, 'pii_in_result_' || hit.category AS subcategory, 3 AS severity,
        'tool result leaks ' || {_DESCRIPTIONS} AS explanation FROM h WHERE hit.severity = 3""",
    "redacted_documents": f"WITH {_SHOWN} SELECT doc_id, len(shown) AS chars, shown <> text AS changed, md5(shown) AS digest FROM y",
    "displayed_documents": f"""WITH {_SHOWN}
      SELECT doc_id, len(shown) AS chars, md5(shown) AS digest FROM y""",
    "secret_documents": f"""WITH x AS (SELECT source, {_values('text')} AS hits FROM documents)
      SELECT source, count(*) FILTER (WHERE len([h for h in hits if h.severity >= 3]) > 0) AS documents FROM x GROUP BY 1""",
    "card_numbers": f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS digits FROM documents)
      SELECT doc_id, digits, {_luhn('digits')} AS valid FROM r WHERE len(digits) >= 13""",
    "token_entropy": f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9/+=]{{30,}}')) AS token FROM documents),
        b AS (SELECT doc_id, token, {_entropy('token')} AS raw FROM r)
      SELECT doc_id, token, round(raw, 6) AS bits, raw > CASE WHEN regexp_full_match(token, '[0-9a-fA-F]+') THEN 3.0
          WHEN regexp_matches(token, '[+/=]') THEN 4.5 ELSE 3.7 END AS random FROM b""",
    "inline_values": f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'))) AS word FROM documents),
        c AS (SELECT doc_id, word, regexp_full_match(word, '[\\pL\\pM\\p{{Nd}}\\pN_.\\-/:@]+') AS shaped FROM w),
        g AS (SELECT doc_id, word, shaped, len([h for h in {_values('word')} if h.severity >= 3]) > 0 AS secret FROM c)
      SELECT doc_id, count(*) FILTER (WHERE shaped AND NOT secret) AS quoted, count(*) FILTER (WHERE NOT shaped OR secret) AS redacted,
        (sum(len('[word redacted · ' || len(word) || ' chars]')) FILTER (WHERE NOT shaped OR secret))::BIGINT AS redacted_chars
      FROM g GROUP BY 1""",
}

# ---- hosts -------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '(?i)https?://([A-Za-z0-9.\\-]+)', 1))"
_PAGES = f"g AS (SELECT page_id, url, regexp_extract(url, '/([a-z]{{2}})/', 1) AS session_id, {_HOST} AS host FROM pages), q AS (SELECT DISTINCT session_id, host FROM g WHERE contains(url, '?'))"

HOST_SQL = {
    "egress_findings": f"""WITH {_PAGES} SELECT session_id, page_id * 2 AS seq, 2 AS severity, 'tools/call ''fetch'' reaches ' || host || ' (undeclared)' AS explanation
        FROM g ANTI JOIN q USING (session_id, host)""",
    "declared_hosts": f"WITH {_PAGES} SELECT session_id, host FROM q",
    "fingerprint_hosts": "SELECT lower(regexp_extract(url, '(?i)https?://([^/]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "trusted_hosts": "SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_matches(url, 'https?://[^/]+\\.example\\.net(/|$)') AS trusted FROM pages",
    "unparsed_lines": """SELECT 'c' || conv_id AS session_id, turn AS seq, CASE WHEN role = 'user' THEN 'client' ELSE 'server' END AS actor, 'message' AS kind,
        'text' AS part_kind, true AS unparsed, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_seq, 't' || turn AS clock, len(text) AS chars FROM conversations""",
}

# ---- source trees and dependencies ----------------------------------------------------------------

_SECRET = "(?i)\\b(?:api[_-]?key|apikey|secret|token|password|passwd)\\s*[=:]\\s*[\"\'\']([A-Za-z0-9_\\-]{16,})[\"\'\']"
_AUDIT = f"""fl AS (SELECT source AS repo, 'd' || doc_id || '.js' AS path, text, regexp_extract_all(text, '{_SECRET}') AS found, regexp_extract_all(text, '{_SECRET}', 1) AS secret FROM documents),
af AS (SELECT repo, path, 'secret-hardcoded' AS rule, 'critical' AS severity,
    len(substr(text, 1, instr(text, found[1]) - 1)) - len(replace(substr(text, 1, instr(text, found[1]) - 1), chr(10), '')) + 1 AS line,
    'possible hardcoded API key/secret: ''' || substr(secret[1], 1, 4) || '…(redacted)''' AS detail, len(found) AS count FROM fl WHERE len(found) > 0
  UNION ALL SELECT DISTINCT repo, '.', 'no-license', 'info', 0, 'no LICENSE/COPYING file found', 1 FROM fl),
sc AS (SELECT repo, CASE WHEN bool_or(rule = 'secret-hardcoded') THEN 75 ELSE 100 END AS score FROM af GROUP BY 1)"""
_DEPS = """dp AS (SELECT DISTINCT 's' || l_suppkey AS repo, l_partkey AS part, CASE WHEN l_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem,
    CASE WHEN l_partkey % 2 = 0 THEN 'package.json' ELSE 'requirements.txt' END AS manifest FROM lineitem),
rg AS (SELECT p_partkey AS part, p_size, CASE WHEN p_size % 10 = 0 THEN 'not_found' WHEN p_size % 10 = 1 THEN 'error' ELSE 'ok' END AS status FROM part),
jn AS (SELECT * FROM dp LEFT JOIN rg USING (part))"""

TREE_SQL = {
    "audit_findings": f"WITH {_AUDIT} SELECT * FROM af",
    "audit_deductions": f"WITH {_AUDIT} SELECT repo, rule, severity, 25 AS points, sum(count)::BIGINT AS hits FROM af WHERE severity = 'critical' GROUP BY 1, 2, 3",
    "audit_scores": f"WITH {_AUDIT} SELECT repo, score, CASE WHEN score >= 90 THEN 'A' ELSE 'C' END AS grade FROM sc",
    "audit_profiles": "SELECT source AS repo, 'node' AS runtime, count(*) AS files_scanned, 0 AS depth_ast, count(*) AS depth_pattern, 0 AS dependency_count FROM documents GROUP BY 1",
    "rule_prevalence": f"""WITH {_AUDIT} SELECT rule, count(DISTINCT repo) AS servers, round(100.0 * count(DISTINCT repo) / (SELECT count(DISTINCT repo) FROM fl), 1) AS pct FROM af GROUP BY 1""",
    "survey_scores": f"WITH {_AUDIT} SELECT count(*) AS servers_audited, list_sort(list(score))[count(*) // 2 + 1] AS median_score FROM sc",
    "audit_sarif": f"""WITH {_AUDIT} SELECT repo AS document, section, lines, CASE WHEN section IN (1, 3) THEN lines - 1 ELSE CASE WHEN section = 4 THEN 0 ELSE 0 END END AS commas FROM (
        SELECT repo, section, CASE section WHEN 1 THEN count(DISTINCT rule) WHEN 3 THEN count(*) ELSE 1 END AS lines FROM af, (SELECT unnest([0, 1, 2, 3, 4]) AS section) GROUP BY 1, 2)""",
    "audit_advisory": f"""WITH {_AUDIT} SELECT repo AS document, CASE severity WHEN 'critical' THEN 3 ELSE 1 END AS severity,
        '- **[`' || severity || '`] `' || rule || '`** — `base/' || path || ':' || line || '`: flagged by this rule. Open the file to inspect.' AS text FROM af""",
    "provenance_findings": f"""WITH {_DEPS}, al AS (
        SELECT repo, ecosystem, manifest, 'prov-not-in-registry' AS rule, 'high' AS severity, 'the ' || ecosystem || ' registry does not know this dependency: a misspelt name or a private one' AS detail FROM jn WHERE status = 'not_found'
        UNION ALL SELECT repo, ecosystem, manifest, 'prov-deprecated', 'medium', 'the registry lists the newest release as ' || CASE ecosystem WHEN 'pypi' THEN 'yanked' ELSE 'deprecated' END FROM jn WHERE status = 'ok' AND p_size % 7 = 0
        UNION ALL SELECT repo, ecosystem, manifest, 'prov-stale', 'low', 'no release for ' || (p_size * 30) || ' days, over the limit of 730' FROM jn WHERE status = 'ok' AND p_size * 30 > 730
        UNION ALL SELECT repo, ecosystem, manifest, 'prov-single-maintainer', 'note', 'one account alone maintains the package' FROM jn WHERE status = 'ok' AND ecosystem = 'npm' AND p_size % 4 = 0
        UNION ALL SELECT repo, ecosystem, manifest, 'prov-unsigned', 'note', 'the newest release carries neither signature nor attestation' FROM jn WHERE status = 'ok' AND p_size % 3 <> 0
        UNION ALL SELECT repo, '', '', 'prov-unavailable', 'note', count(*) || ' dependenc' || CASE WHEN count(*) = 1 THEN 'y' ELSE 'ies' END || ' without an answer of the registry: the check is incomplete' FROM jn WHERE status IS NULL GROUP BY repo)
      SELECT repo, ecosystem, manifest, rule, severity, detail, count(*) AS packages FROM al GROUP BY ALL""",
    "provenance_notes": f"""WITH {_DEPS} SELECT repo, 'note' AS severity, count(*) || ' dependenc' || CASE WHEN count(*) = 1 THEN 'y' ELSE 'ies' END
        || ' without an answer of the registry: the check is incomplete' AS detail FROM jn WHERE status IS NULL OR status = 'error' GROUP BY repo""",
    "registry_facts": f"""WITH {_DEPS} SELECT 'p' || part AS name, status, p_size % 7 = 0 AS deprecated, strftime(DATE '2026-07-05' - (p_size * 30)::INTEGER, '%Y-%m-%d') AS newest,
        CASE WHEN part % 2 = 1 THEN NULL WHEN p_size % 4 = 0 THEN 1 ELSE 2 END AS maintainers, p_size % 3 = 0 AS signed FROM rg""",
}

# ---- reports of sessions ---------------------------------------------------------------------------

REPORT_SQL = {
    "session_sarif": f"""{_ALL}, num AS (SELECT session_id, ord AS seq, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS line FROM e)
      SELECT DISTINCT f.session_id, subcategory || ':' || f.seq AS print, CASE severity WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END AS level, line
      FROM f JOIN num USING (session_id, seq) WHERE kind <> 'info' AND subcategory <> 'fabricated_tool_call'""",
    "runtime_advisory": f"""{_ALL} SELECT session_id AS document, seq AS ord, severity, '- **[' || CASE severity WHEN 3 THEN 'critical' ELSE 'warning' END || ']' ||
        CASE subcategory WHEN 'premature_call' THEN ' Early call** — a tool was called before the handshake had ended.'
          WHEN 'surface_change' THEN ' Changed surface** — later listings differ from the first; difference: `' || replace(regexp_extract(explanation, '\\[''(.*)''\\]', 1), ''', ''', '`, `') || '`.'
          ELSE '** flagged by `' || subcategory || '` at severity ' || severity || '.' END AS text FROM f WHERE severity >= 2""",
    "session_report": f"""{_ALL} SELECT e.session_id, row_number() OVER (PARTITION BY e.session_id ORDER BY ord) - 1 AS row_index,
        CASE WHEN e.kind = 'tool_call' THEN 'tools/call · ' || tool
        WHEN e.kind = 'tool_result' THEN 'tool result · ' || responds_to || CASE WHEN has_error OR (t = 'purchase' AND k < 90 AND k % 7 = 0) THEN ' · ERROR' ELSE '' END
        WHEN role = 'raw' THEN 'unparseable wire line' WHEN e.kind = 'message' AND responds_to IS NOT NULL THEN 'reply to ' || responds_to
        WHEN role = 'server_message' THEN method || ' · server-initiated request' WHEN role = 'client_note' THEN method || ' · notification'
        WHEN e.kind = 'message' THEN coalesce(method, 'message') WHEN has_error THEN 'protocol error'
        WHEN responds_to IS NOT NULL THEN 'response · ' || responds_to ELSE 'state change' END AS label,
        coalesce(request, lag(ord) OVER (PARTITION BY e.session_id ORDER BY ord)) AS parent_seq, CASE WHEN orphaned THEN 1 ELSE 0 END AS severity,
        CASE WHEN role = 'raw' THEN 'text' WHEN e.kind = 'tool_call' THEN 'tool_use' WHEN e.kind = 'tool_result' THEN 'tool_result'
             WHEN e.kind = 'state_change' AND has_error THEN 'error' ELSE 'json' END AS part_kind FROM e""",
    "log_writer": f"""WITH {WIRE} SELECT session_id, 'wire' AS record_kind, CASE WHEN role = 'raw' THEN NULL WHEN actor = 'client' THEN 'c2s' ELSE 's2c' END AS dir,
        count(*) AS records, sum(ord)::BIGINT AS seqs, min(ts) AS first_ts, count(gate) AS gated FROM e GROUP BY 1, 2, 3""",
}

LIVE_SQL = {
    "finding_places": f"""{_ALL}, num AS (SELECT session_id, ord AS seq, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS row_index FROM e)
      SELECT session_id, seq, subcategory, row_index FROM f_server JOIN num USING (session_id, seq)""",
    "exported_events": f"""WITH {WIRE} SELECT session_id AS document, '{{"session_id":"' || session_id || '","seq":' || ord || ',"tool_name":"' || tool || '","args":' ||
        CASE WHEN t = 'view' OR k % 4 = 3 THEN '{{"n":' || k || ',"q":"x"}}' WHEN k % 4 = 0 THEN '{{"n":' || k || '}}'
             WHEN k % 4 = 1 THEN '{{"q":' || k || '}}' ELSE '{{"extra":true,"q":"x"}}' END || '}}' AS text FROM e WHERE kind = 'tool_call'""",
    "live_findings": f"""{_ALL} SELECT session_id, seq, subcategory, severity, explanation FROM f
        WHERE subcategory IN ('fabricated_tool_call', 'orphaned_response', 'schema_violation')""",
}

# Four growing prefixes of the events, each with sessions of its own.
_PREFIXES = """(SELECT events.*, n FROM events, (SELECT unnest(range(4)) AS n), (SELECT max(event_id) AS top FROM events)
                WHERE floor(event_id * 4 / (top + 1)) <= n)"""
_GROWING = f"WITH {wire(session="n || '|u' || user_id", source=_PREFIXES)}, {_FINDINGS}"
_WATCHED = f"""{_GROWING}, seen AS (SELECT CAST(split_part(session_id, '|', 1) AS BIGINT) AS after, split_part(session_id, '|', 2) AS session_id,
      seq, kind, subcategory, severity, explanation FROM f
      WHERE subcategory IN ('fabricated_tool_call', 'orphaned_response', 'unknown_server_request', 'capability_violation'))"""

GROWING_SQL = {
    "live_drift": DAILY_SQL["drift"],
    "live_changes": f"{_WATCHED} SELECT after, session_id, seq, subcategory, severity, explanation FROM seen",
    "live_retractions": f"""{_WATCHED} SELECT after + 1 AS batch, session_id, seq, subcategory, count(*) AS copies FROM
        (SELECT after, session_id, seq, subcategory, severity, explanation FROM seen WHERE after < 3 EXCEPT ALL
         SELECT after - 1, session_id, seq, subcategory, severity, explanation FROM seen) GROUP BY ALL""",
    "live_counters_feed": f"""{_WATCHED}, counted AS (SELECT CAST(split_part(session_id, '|', 1) AS BIGINT) AS batch,
          split_part(session_id, '|', 2) AS session_id, count(*) AS frames,
          count(*) FILTER (WHERE role = 'server_message' AND id IS NOT NULL) AS server_requests, bool_or(gate IS NOT NULL) AS gate_on FROM e GROUP BY 1, 2),
        judged AS (SELECT after AS batch, session_id, count(*) FILTER (WHERE subcategory = 'fabricated_tool_call') AS fabricated,
          count(*) FILTER (WHERE kind <> 'info' AND subcategory <> 'fabricated_tool_call') AS violations FROM seen GROUP BY 1, 2),
        shown AS (SELECT batch, session_id, frames, coalesce(fabricated, 0) AS fabricated, coalesce(violations, 0) AS violations, server_requests, gate_on
          FROM counted LEFT JOIN judged USING (batch, session_id))
      SELECT a.batch, CASE WHEN b.session_id IS NULL THEN 'insert' ELSE 'update' END AS op, a.*EXCLUDE (batch)
      FROM shown a LEFT JOIN shown b ON b.session_id = a.session_id AND b.batch = a.batch - 1
      WHERE b.session_id IS NULL OR (a.frames, a.fabricated, a.violations, a.server_requests, a.gate_on)
         IS DISTINCT FROM (b.frames, b.fabricated, b.violations, b.server_requests, b.gate_on)""",
    "live_request_pairing": f"""WITH {WIRE} SELECT session_id, ord AS seq, role, responds_to, request AS request_seq, orphaned
        FROM e WHERE role IN ('response', 'client_reply')""",
    "live_open_requests": f"""WITH {WIRE}, z AS (SELECT *, lead(ord) OVER (PARTITION BY session_id, space, id ORDER BY ord) AS later FROM s WHERE space IS NOT NULL)
      SELECT session_id, space, CAST(id AS VARCHAR) AS id_key, ord AS seq, label FROM z WHERE opens AND later IS NULL""",
}

# ---- audits of trees with every rule ---------------------------------------------------------------

# What the snippets of ``bridge.document_tree`` hold: snippet, rule, line in it, hits, detail.
_PLANTED = (
    (0, "shell-injection", 2, 2, "os.system()"), (0, "cmd-exec", 4, 1, "subprocess.run()"), (0, "exec-dynamic", 5, 1, "eval()"),
    (1, "net-egress", 1, 2, "imports from http"), (1, "fs-write", 3, 1, "open(mode='wb')"), (1, "fs-delete", 5, 1, "shutil.rmtree()"),
    (3, "exec-dynamic", 1, 2, "pattern match: 'eval ('"),
    (4, "net-egress", 1, 2, "pattern match: \"require('https')\""), (4, "shell-injection", 2, 1, "pattern match: 'execSync('"),
    (5, "cmd-exec", 1, 1, "pattern match: 'child_process'"), (5, "fs-delete", 2, 2, "pattern match: 'rmSync('"),
    (6, "runtime-install", 1, 1, "npx auto-install flag (-y/--yes)"),
    (7, "unicode-hidden", 1, 1, "2 invisible/bidi character(s), first is U+202E"),
    (8, "unicode-hidden", 1, 1, "1 invisible/bidi character(s), first is U+200B"), (8, "tool-poisoning", 1, 1, "directive text: 'ignore all\\nprevious instructions'"),
    (9, "secret-hardcoded", 4, 4, "OpenAI-style secret key: 'sk-a…(redacted)'"),
    (10, "tool-poisoning", 1, 2, "directive text: 'do not tell the user'"),
    (14, "secret-hardcoded", 1, 1, "hardcoded Bearer token: 'aaaa…(redacted)'"),
    (15, "secret-hardcoded", 1, 1, "possible hardcoded API key/secret: '0123…(redacted)'"),
)
_SUFFIX = ".py .py .py .js .ts .js .mjs .cjs .js .py .py .json - .py .js .py".split()
_LEVELS = {
    "secret-hardcoded": ("critical", "secrets"), "tool-poisoning": ("critical", "tool_poisoning"), "unicode-hidden": ("high", "tool_poisoning"),
    "exec-dynamic": ("high", "supply_chain"), "shell-injection": ("high", "permissions"), "runtime-install": ("high", "supply_chain"),
    "cmd-exec": ("note", "permissions"), "fs-delete": ("medium", "permissions"), "fs-write": ("note", "permissions"), "net-egress": ("low", "permissions"),
}


def _quote(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


_TREE = f"""planted(variant, rule, place, hits, detail, severity, category) AS (VALUES {", ".join(
    "(" + ", ".join(map(_quote, (*row, *_LEVELS[row[1]]))) + ")" for row in _PLANTED)}),
suffixes AS (SELECT {list(_SUFFIX)} AS s),
files AS (SELECT doc_id, source || '_' || lang AS repo, doc_id % 16 AS variant, s[doc_id % 16 + 1] AS suffix,
    len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1 AS before, doc_id % 3 * 20 + 11 AS deps FROM documents, suffixes),
af AS (SELECT repo, 'd' || doc_id || suffix AS path, rule, severity, category, before + place AS line, detail, hits AS count FROM files JOIN planted USING (variant)
  UNION ALL SELECT repo, 'd' || doc_id || '/package.json', 'dep-surface', CASE WHEN deps > 50 THEN 'medium' ELSE 'low' END, 'supply_chain', 1,
    deps || ' direct dependencies declared', 1 FROM files WHERE variant = 11 AND deps > 20
  UNION ALL SELECT repo, '.', 'no-license', 'info', 'provenance', 0, 'no LICENSE/COPYING file found', 1 FROM files GROUP BY repo
    HAVING NOT bool_or(variant = 12 AND doc_id % 3 = 0)),
rk AS (SELECT *, list_position(['critical', 'high', 'medium', 'low', 'note', 'info'], severity) AS rank FROM af),
ded AS (SELECT repo, rule, ['critical', 'high', 'medium', 'low', 'note', 'info'][min(rank)] AS severity, [25, 15, 8, 3, 0, 0][min(rank)] AS points,
    sum(count)::BIGINT AS hits FROM rk GROUP BY 1, 2 HAVING [25, 15, 8, 3, 0, 0][min(rank)] > 0),
scd AS (SELECT repo, greatest(0, 100 - coalesce(sum(points), 0))::INTEGER AS score FROM (SELECT DISTINCT repo FROM files) LEFT JOIN ded USING (repo) GROUP BY 1),
grd AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM scd),
prf AS (SELECT repo, CASE WHEN py > 0 AND (js > 0 OR pk > 0) THEN 'mixed' WHEN py > 0 THEN 'python' WHEN js > 0 OR pk > 0 THEN 'node' ELSE 'unknown' END AS runtime,
    py + js + pk AS files_scanned, py AS python_files, js AS script_files, py - broken AS depth_ast, js + broken AS depth_pattern, dependency_count
  FROM (SELECT repo, count(*) FILTER (WHERE suffix = '.py') AS py, count(*) FILTER (WHERE suffix IN ('.js', '.ts', '.mjs', '.cjs')) AS js,
          count(*) FILTER (WHERE suffix = '.json') AS pk, count(*) FILTER (WHERE variant = 2) AS broken,
          coalesce(max_by(deps, 'd' || doc_id) FILTER (WHERE variant = 11), 0) AS dependency_count FROM files GROUP BY 1) WHERE py + js + pk > 0)"""

_COMMAS = "CASE WHEN row_number() OVER (PARTITION BY document, section ORDER BY position) = 1 THEN '' ELSE ',' END"
_SESSION_PARTS = f"""decl AS (SELECT DISTINCT session_id, tool FROM d), calls AS (SELECT session_id, ord, tool FROM e WHERE kind = 'tool_call'),
fab AS (SELECT * FROM calls WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session_id = calls.session_id AND d.tool = calls.tool)),
errs AS (SELECT session_id, ord, CASE WHEN kind = 'state_change' AND has_error THEN 'protocol' ELSE 'tool' END AS what,
    CASE WHEN has_error THEN 'e' || (k % 10) ELSE '{{"content":[],"isError":true}}' END AS message FROM e
  WHERE (kind = 'state_change' AND has_error) OR (kind = 'tool_result' AND (has_error OR (t = 'purchase' AND k < 90 AND k % 7 = 0))))"""
_FOUND_JSON = """'{"severity":' || severity || ',"subcategory":"' || subcategory || '","seq":' || seq || ',"explanation":"' || explanation || '"}'"""


def _session_document(heads: str, *sections: tuple[str, str]) -> str:
    """Lines of a JSON document: each section is its name and a SELECT of session_id, position, text."""
    parts = [f"SELECT session_id AS document, 0 AS section, {heads} || '\"{sections[0][0]}\":[' AS text FROM e GROUP BY session_id"]
    for k, (_, rows) in enumerate(sections):
        after = f"],\"{sections[k + 1][0]}\":[" if k + 1 < len(sections) else "]}"
        parts.append(f"SELECT document, section, {_COMMAS} || text FROM (SELECT session_id AS document, {2 * k + 1} AS section, position, text FROM ({rows}))")
        parts.append(f"SELECT DISTINCT session_id, {2 * k + 2}, '{after}' FROM e")
    return f"{_ALL}, {_SESSION_PARTS} " + " UNION ALL ".join(parts)


_NAMED = "SELECT session_id, {at} AS position, '\"' || tool || '\"' AS text FROM {rows}"
_FAB = "SELECT session_id, ord AS position, '{\"seq\":' || ord || ',\"tool\":\"' || tool || '\"}' AS text FROM fab"
_ERR = "SELECT session_id, ord AS position, '{{\"seq\":' || ord || ',\"message\":\"' || replace(message, '\"', '\\\"') || '\"}}' AS text FROM errs WHERE what = '{what}'"
_ANY = f"SELECT session_id, (seq, subcategory, explanation) AS position, {_FOUND_JSON} AS text FROM f"

DOCUMENT_SQL = {
    "findings_view_top": f"""{_ALL}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY severity DESC, seq, subcategory, explanation) AS rank,
        count(*) OVER (PARTITION BY session_id) AS n FROM f)
      SELECT session_id, rank, seq, severity, subcategory, greatest(0, n - 5) AS more_findings FROM x WHERE rank <= 5""",
    "timeline_view_newest": f"""{_ALL}, {_SEVERE}, x AS (SELECT e.session_id, row_number() OVER (PARTITION BY e.session_id ORDER BY ord) - 1 AS row_index,
          count(*) OVER (PARTITION BY e.session_id) AS n, coalesce(sv.severity, 0) AS severity, coalesce(is_info, false) AS is_info
        FROM e LEFT JOIN sv ON sv.session_id = e.session_id AND sv.seq = e.ord)
      SELECT session_id, row_index, severity, is_info, greatest(0, n - 10) AS collapsed_rows FROM x WHERE row_index >= n - 10""",
    "drift_report": f"""WITH {_DAILY}, {_DRIFT}, parts AS (SELECT server_key AS document, 1 AS section,
        '{{"session_id":"' || session_id || '","kind":"' || kind || '","severity":' || severity || ',"explanation":"' || explanation || '"}}' AS text FROM g)
      SELECT document, section, CASE WHEN row_number() OVER (PARTITION BY document ORDER BY text) = 1 THEN '' ELSE ',' END || text AS text FROM parts
      UNION ALL SELECT DISTINCT document, 0, '{{"findings":[' FROM parts UNION ALL SELECT DISTINCT document, 2, ']}}' FROM parts""",
    "last_recorded_metrics": f"WITH {WIRE} SELECT session_id, max(ord) AS frames_seen, 2 * max(ord) AS log_bytes FROM e WHERE ord % 7 = 0 GROUP BY 1",
    "tree_findings": f"WITH {_TREE} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY rank, rule, path) AS nth, path, rule, severity, category, line, detail, count FROM rk",
    "tree_deductions": f"WITH {_TREE} SELECT repo, rule, severity, points, hits FROM ded",
    "tree_profiles": f"WITH {_TREE} SELECT * FROM prf",
    "survey_servers": f"""WITH {_TREE} SELECT row_number() OVER (ORDER BY score, repo) AS nth, repo, score, grade, coalesce(rules, '') AS rules
        FROM grd LEFT JOIN (SELECT repo, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM af GROUP BY 1) USING (repo)""",
    "audit_report": f"""WITH {_TREE}, parts AS (
        SELECT repo AS document, 1 AS section, (100 - points, rule, '') AS position, '{{"rule":"' || rule || '","severity":"' || severity || '","points":' || points || ',"hits":' || hits || '}}' AS text FROM ded
        UNION ALL SELECT repo, 3, (rank, rule, path), '{{"rule":"' || rule || '","severity":"' || severity || '","path":"' || path || '","line":' || line || ',"detail":"' ||
          replace(replace(detail, '\\', '\\\\'), '"', '\\"') || '","count":' || count || ',"why":"w","fix":"f"}}' FROM rk)
      SELECT document, section, {_COMMAS} || text AS text FROM parts
      UNION ALL SELECT repo, 0, '{{"rubric_version":"0.3",' || '"profile":{{"runtime":"' || coalesce(runtime, 'unknown') || '","files_scanned":' || coalesce(files_scanned, 0) || ',"dependency_count":' || coalesce(dependency_count, 0) || '}},' ||
          '"score":' || score || ',"grade":"' || grade || '","deductions":[' FROM grd LEFT JOIN prf USING (repo)
      UNION ALL SELECT repo, 2, '],"findings":[' FROM grd UNION ALL SELECT repo, 4, ']}}' FROM grd""",
    "fabricated_rows": f"{_ALL}, {_SESSION_PARTS} SELECT session_id, ord AS seq, tool FROM fab",
    "report_surface": f"""{_ALL}, {_SESSION_PARTS} SELECT session_id, 'declared' AS side, tool AS position, tool, false AS fabricated FROM decl
        UNION ALL SELECT calls.session_id, 'called', lpad(CAST(calls.ord AS VARCHAR), 19, '0'), calls.tool, fab.ord IS NOT NULL FROM calls LEFT JOIN fab ON fab.session_id = calls.session_id AND fab.ord = calls.ord""",
    "summary_report": _session_document(
        "'{\"session\":\"' || session_id || '\",\"frames_parsed\":' || count(*) FILTER (WHERE role <> 'raw') || ','",
        ("declared_tools", _NAMED.format(at="tool", rows="decl")), ("called_tools", _NAMED.format(at="ord", rows="calls")),
        ("unused_declared", _NAMED.format(at="tool", rows="decl WHERE NOT EXISTS (SELECT 1 FROM calls WHERE calls.session_id = decl.session_id AND calls.tool = decl.tool)")),
        ("fabricated_calls", _FAB), ("protocol_errors", _ERR.format(what="protocol")), ("tool_errors", _ERR.format(what="tool")), ("context_violations", _ANY),
    ),
    "analysis_report": _session_document(
        "'{\"session\":\"' || session_id || '\",'",
        ("declared_tools", _NAMED.format(at="tool", rows="decl")), ("called_tools", _NAMED.format(at="ord", rows="calls")),
        ("fabricated_calls", _FAB), ("annotations", _ANY),
    ),
    "recorded_records": f"""WITH {WIRE}, every AS (SELECT session_id, CASE ord % 7 WHEN 0 THEN 'self' WHEN 1 THEN 'raw' WHEN 2 THEN 'bad' END AS record_kind,
          NULL::BIGINT AS seq, CASE WHEN ord % 7 = 0 THEN ord END AS frames_seen, CASE ord % 7 WHEN 1 THEN len('{{"seq":' || ord) WHEN 2 THEN 3 END AS raw_chars, NULL AS gate FROM e WHERE ord % 7 < 3
        UNION ALL SELECT session_id, 'wire', ord, NULL, CASE WHEN role = 'raw' THEN len('line ' || k) END, gate FROM e)
      SELECT session_id, record_kind, count(*) AS records, sum(seq)::BIGINT AS seqs, sum(frames_seen)::BIGINT AS frames_seen, sum(raw_chars)::BIGINT AS raw_chars, count(gate) AS gated FROM every GROUP BY 1, 2""",
    "recorded_pairing": f"""WITH {WIRE} SELECT session_id, ord AS seq, responds_to, request AS request_seq, orphaned FROM e WHERE role IN ('response', 'client_reply')""",
}

ORACLES = {**EVENT_SQL, **ROLLUP_SQL, **DAILY_SQL, **TEXT_SQL, **HOST_SQL, **TREE_SQL, **REPORT_SQL, **LIVE_SQL, **GROWING_SQL, **DOCUMENT_SQL}
