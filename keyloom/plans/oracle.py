"""The same queries as DuckDB SQL over the same tables, for side-by-side checks."""

from __future__ import annotations

from ..functions.ids import INTENT_NAMESPACE, TRACE_NAMESPACE
from ..schemas import REASONS

_REASONS = "[" + ", ".join(f"'{r}'" for r in REASONS) + "]"


def uuid5_hex(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    return f"(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 15))"


def dashed(h: str) -> str:
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


STEPPED = """
st AS (
  SELECT *, rn // 5 AS seq, rn % 5 AS step FROM (
    SELECT event_id, user_id, event_type AS etype, value, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
           lower(hex(CAST(user_id AS VARCHAR))) AS entity_key, epoch_us(ts) // 1000 AS t,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events))
"""

_NAME = "entity_key || '|' || CAST(seq AS VARCHAR)"
EVENTS = f"""{STEPPED},
typed AS (
  SELECT *, CASE WHEN etype = 'signup' THEN 'ACTIVATION_START' WHEN etype = 'view' AND k % 9 = 4 THEN 'SUSPENDED' WHEN etype = 'view' THEN 'LLM_CALL'
    WHEN etype = 'click' AND k % 3 = 1 THEN 'INTENT_EMITTED' WHEN etype = 'click' THEN 'TOOL_CALL' WHEN etype = 'purchase' THEN 'ACTIVATION_END' ELSE 'ERROR' END AS event_type,
    {uuid5_hex(TRACE_NAMESPACE, _NAME)} AS trace_id FROM st),
seen AS (
  SELECT *, max(CASE WHEN event_type = 'ACTIVATION_START' THEN step END) OVER w AS ls, max(CASE WHEN event_type = 'ACTIVATION_END' THEN step END) OVER w AS le
  FROM typed WINDOW w AS (PARTITION BY user_id, seq ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
te AS (
  SELECT trace_id, event_id AS arrival, entity_key, seq, step AS step_index, event_type, t AS start_ms, t AS end_ms, 'native' AS provenance,
    substr(trace_id, 1, 12) || CASE WHEN event_type IN ('ACTIVATION_START', 'ACTIVATION_END')
      THEN 'a00' || CAST(CASE WHEN event_type = 'ACTIVATION_END' AND ls IS NOT NULL AND (le IS NULL OR le < ls) THEN ls ELSE step END AS VARCHAR) ELSE 'b00' || CAST(step AS VARCHAR) END AS span_id,
    CASE WHEN event_type IN ('ACTIVATION_START', 'ACTIVATION_END') OR ls IS NULL THEN '' ELSE substr(trace_id, 1, 12) || 'a00' || CAST(ls AS VARCHAR) END AS parent_span_id,
    CASE WHEN event_type IN ('ACTIVATION_START', 'ACTIVATION_END') AND k % 3 <> 2 THEN CASE WHEN k % 3 = 0 THEN 'start' ELSE 'resume' END END AS a_kind,
    CASE WHEN event_type = 'ACTIVATION_END' AND k % 4 <> 3 THEN CASE WHEN k % 4 = 2 THEN 'suspended' ELSE 'completed' END END AS a_status,
    CASE WHEN event_type = 'LLM_CALL' THEN 'm-' || CAST(k % 4 AS VARCHAR) END AS a_model,
    CASE WHEN event_type = 'LLM_CALL' AND k % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS a_in,
    CASE WHEN event_type = 'LLM_CALL' AND k % 5 <> 0 THEN CAST(k % 11 AS BIGINT) END AS a_out,
    CASE WHEN event_type = 'LLM_CALL' AND k % 8 <> 0 THEN CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END END AS a_cache,
    CASE WHEN event_type = 'LLM_CALL' THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END END AS a_billed,
    CASE WHEN event_type = 'LLM_CALL' THEN CAST(1 + k % 3 AS BIGINT) END AS a_attempts,
    CASE WHEN event_type = 'LLM_CALL' AND k % 6 < 3 THEN CASE k % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'half_open' END END AS a_circuit,
    CASE WHEN event_type IN ('INTENT_EMITTED', 'TOOL_CALL') THEN 'tool-' || CAST(k % 7 AS VARCHAR) END AS a_tool,
    CASE WHEN event_type = 'INTENT_EMITTED' THEN {dashed(uuid5_hex(INTENT_NAMESPACE, _NAME + " || '|' || CAST(step AS VARCHAR)"))} END AS a_intent,
    CASE WHEN event_type = 'INTENT_EMITTED' THEN CASE WHEN k % 2 = 0 THEN 'APPROVAL' ELSE 'TOOL' END END AS a_intent_kind,
    CASE WHEN event_type = 'INTENT_EMITTED' THEN t + 3600000 END AS a_expires,
    CASE WHEN event_type = 'SUSPENDED' THEN t + 86400000 END AS a_deadline,
    CASE WHEN event_type = 'ERROR' AND k % 3 <> 1 THEN {_REASONS}[k % 10 + 1] END AS a_reason,
    CASE WHEN (event_type = 'ERROR' AND k % 4 <> 0) OR (event_type = 'LLM_CALL' AND k % 13 = 0) THEN 'E' || CAST(k % 3 AS VARCHAR) END AS a_error_type,
    CASE WHEN event_type = 'ERROR' AND k % 5 = 1 THEN step END AS a_fstep,
    CASE WHEN event_type = 'ERROR' AND k % 5 = 1 THEN CASE WHEN k % 2 = 0 THEN 'LLM_CALL' ELSE 'TOOL_CALL' END END AS a_flast,
    CASE WHEN event_type = 'ERROR' AND k % 5 = 1 THEN CAST(k % 3 AS BIGINT) END AS a_fintents,
    CASE WHEN event_type = 'ERROR' AND k % 5 = 1 THEN CAST(k % 4 AS BIGINT) END AS a_fcalls
  FROM seen),
er AS (
  SELECT *, sha256(entity_key || chr(0) || coalesce(CAST(seq AS VARCHAR), '') || chr(0) || reason || chr(0) || CAST(event_time_ms AS VARCHAR) || chr(0) || detail) AS error_id FROM (
    SELECT entity_key, CASE WHEN k % 4 = 0 THEN seq END AS seq, {_REASONS}[k % 10 + 1] AS reason, 'd-' || CAST(k AS VARCHAR) AS detail, t + k % 3 AS event_time_ms, 'native' AS provenance, event_id AS arrival
    FROM st WHERE etype = 'error' AND k % 2 = 0)),
sn AS (SELECT entity_key, seq, t AS snapshot_at_ms FROM st WHERE step = 4 AND seq % 10 = 0)
"""

ACTS = f"""{EVENTS},
ev AS (
  SELECT entity_key, seq, min(trace_id) AS trace_id,
    list(DISTINCT span_id) FILTER (event_type = 'ACTIVATION_START') AS ss, list(DISTINCT span_id) FILTER (event_type = 'ACTIVATION_END') AS es,
    max(start_ms) FILTER (event_type = 'ERROR') AS error_ms, count(*) FILTER (event_type = 'ERROR') AS error_events,
    max(start_ms) FILTER (event_type = 'ACTIVATION_END') AS end_ms,
    min(start_ms) AS first_ms, min(start_ms) FILTER (event_type = 'ACTIVATION_START') AS first_start_ms,
    count(*) FILTER (event_type = 'LLM_CALL') AS llm_calls, count(*) FILTER (event_type = 'TOOL_CALL') AS tool_calls, count(*) FILTER (event_type = 'INTENT_EMITTED') AS intents,
    sum(a_in) AS p, sum(a_out) AS c, count(*) FILTER (a_cache = 'true') AS cache_hits,
    list(DISTINCT a_tool) FILTER (a_tool IS NOT NULL) AS tools, list(DISTINCT a_reason) FILTER (a_reason IS NOT NULL) AS rs
  FROM te GROUP BY entity_key, seq),
last_end AS (SELECT entity_key, seq, a_status, a_kind FROM te WHERE event_type = 'ACTIVATION_END' QUALIFY row_number() OVER (PARTITION BY entity_key, seq ORDER BY start_ms DESC, span_id DESC) = 1),
last_start AS (SELECT entity_key, seq, a_kind FROM te WHERE event_type = 'ACTIVATION_START' QUALIFY row_number() OVER (PARTITION BY entity_key, seq ORDER BY start_ms DESC, span_id DESC) = 1),
last_model AS (SELECT entity_key, seq, a_model FROM te WHERE a_model IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_key, seq ORDER BY start_ms DESC, span_id DESC) = 1),
ea AS (SELECT entity_key, seq, count(*) AS records, max(event_time_ms) AS record_ms, min(event_time_ms) AS first_record_ms, list(DISTINCT reason) AS rr FROM er WHERE seq IS NOT NULL GROUP BY entity_key, seq),
j AS (
  SELECT entity_key, seq, ev.*  EXCLUDE (entity_key, seq), ea.* EXCLUDE (entity_key, seq), le.a_status AS end_status, le.a_kind AS end_kind, ls.a_kind AS start_kind, lm.a_model AS model,
    coalesce(ss, []) AS s, coalesce(es, []) AS e, greatest(error_ms, record_ms) AS failed_ms
  FROM ev FULL JOIN ea USING (entity_key, seq) LEFT JOIN last_end le USING (entity_key, seq) LEFT JOIN last_start ls USING (entity_key, seq) LEFT JOIN last_model lm USING (entity_key, seq)),
j2 AS (SELECT *, len(e) > 0 AND len([x for x in s if NOT list_contains(e, x)]) = 0 AND coalesce(end_status IN ('completed', 'suspended'), false) AS well, CASE WHEN len(s) > 0 THEN start_kind ELSE end_kind END AS kn FROM j),
acts AS (
  SELECT entity_key, seq, trace_id, CASE WHEN failed_ms IS NOT NULL THEN 'error' WHEN well THEN end_status ELSE 'in_flight' END AS status,
    coalesce(kn, 'unknown') AS kind, greatest(len(list_distinct(list_concat(s, e))), 1) AS attempts, least(first_ms, first_record_ms) AS started_ms,
    CASE WHEN failed_ms IS NOT NULL THEN failed_ms WHEN well THEN end_ms END AS ended_ms,
    CASE WHEN CASE WHEN failed_ms IS NOT NULL THEN failed_ms WHEN well THEN end_ms END > first_start_ms THEN CASE WHEN failed_ms IS NOT NULL THEN failed_ms ELSE end_ms END - first_start_ms END AS wall_ms,
    model, coalesce(llm_calls, 0) AS llm_calls, coalesce(tool_calls, 0) AS tool_calls, coalesce(intents, 0) AS intents, greatest(coalesce(error_events, 0), coalesce(records, 0)) AS errors,
    CAST(p AS BIGINT) AS prompt_tokens, CAST(c AS BIGINT) AS completion_tokens, CAST(CASE WHEN p IS NOT NULL OR c IS NOT NULL THEN coalesce(p, 0) + coalesce(c, 0) END AS BIGINT) AS total_tokens,
    coalesce(cache_hits, 0) AS cache_hits, list_sort(coalesce(tools, [])) AS tools, list_sort(list_distinct(list_concat(coalesce(rs, []), coalesce(rr, [])))) AS reasons
  FROM j2)
"""

ERRORS = """
tr AS (SELECT entity_key, seq, a_reason AS reason, min(start_ms) AS event_time_ms, max(a_error_type) AS error_type,
  max(a_fstep) AS failure_step, max(a_flast) AS failure_last_event, max(a_fintents) AS failure_staged_intents, max(a_fcalls) AS failure_llm_calls FROM te WHERE event_type = 'ERROR' AND a_reason IS NOT NULL GROUP BY ALL),
mt AS (SELECT r.*, (SELECT coalesce(min(t.seq), -1) FROM tr t WHERE t.entity_key = r.entity_key AND t.reason = r.reason AND (r.seq IS NULL OR t.seq = r.seq)) AS m FROM er r),
un AS (
  SELECT r.entity_key, r.seq, r.reason, r.detail, r.event_time_ms, t.error_type, t.failure_step, t.failure_last_event, t.failure_staged_intents, t.failure_llm_calls FROM mt r LEFT JOIN tr t ON t.entity_key = r.entity_key AND t.reason = r.reason AND t.seq = r.m
  UNION ALL
  SELECT t.entity_key, t.seq, t.reason, '', t.event_time_ms, t.error_type, t.failure_step, t.failure_last_event, t.failure_staged_intents, t.failure_llm_calls FROM tr t WHERE NOT EXISTS (SELECT 1 FROM mt r WHERE r.entity_key = t.entity_key AND r.reason = t.reason AND r.m = t.seq)),
ue AS (SELECT *, coalesce(seq, -1) AS seq_key FROM un)
"""

BOTH = f"{ACTS}, {ERRORS}"

ACT_COLUMNS = "entity_key, seq, trace_id, status, kind, attempts, started_ms, ended_ms, wall_ms, model, llm_calls, tool_calls, intents, errors, prompt_tokens, completion_tokens, total_tokens, cache_hits, array_to_string(tools, ',') AS tools, array_to_string(reasons, ',') AS reasons"


def of(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
