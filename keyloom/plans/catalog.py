"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, rollups
from ..sources import testbed
from . import console
from .oracle import ACT_COLUMNS, ACTS, BOTH, EVENTS, of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def acts(spark: SparkSession, d: str) -> DataFrame:
    s = testbed.store(spark, d)
    return rollups.activations(s.events, s.errors)


def flat(a: DataFrame) -> DataFrame:
    """Activations with arrays as text, without provenance."""
    return a.drop("provenance", "complete_provenance").withColumns({c: F.array_join(c, ",") for c in ("tools", "reasons")})


MODELS = """SELECT a_model AS model, count(*) AS calls, CAST(sum(a_in) AS BIGINT) AS prompt_tokens, CAST(sum(a_out) AS BIGINT) AS completion_tokens,
  CAST(CASE WHEN sum(a_in) IS NOT NULL OR sum(a_out) IS NOT NULL THEN coalesce(sum(a_in), 0) + coalesce(sum(a_out), 0) END AS BIGINT) AS total_tokens,
  count(*) FILTER (a_cache = 'true') AS cache_hits, count(*) FILTER (a_error_type IS NOT NULL) AS errors, max(a_attempts) AS max_attempts,
  CASE WHEN count(a_cache) > 0 THEN count(*) FILTER (a_cache = 'true') / count(a_cache) END AS cache_hit_ratio
  FROM te WHERE event_type = 'LLM_CALL' GROUP BY a_model"""
TOOLS = """SELECT a_tool AS tool_name, count(*) FILTER (event_type = 'TOOL_CALL') AS calls, count(*) FILTER (event_type = 'INTENT_EMITTED') AS intents,
  count(*) FILTER (a_error_type IS NOT NULL) AS errors, max(start_ms) AS last_seen_ms,
  CASE WHEN count(*) FILTER (event_type = 'TOOL_CALL') > 0 THEN count(*) FILTER (a_error_type IS NOT NULL) / count(*) FILTER (event_type = 'TOOL_CALL') END AS failure_ratio
  FROM te WHERE a_tool IS NOT NULL GROUP BY a_tool"""


@query(of(EVENTS, MODELS))
def a01_model_usage(spark, d):
    return console.models(testbed.trace_events(spark, d))


@query(of(EVENTS, TOOLS))
def a02_tool_usage(spark, d):
    return console.tools(testbed.trace_events(spark, d))


@query(of(EVENTS, "SELECT a_model AS model, a_circuit AS circuit_state, count(*) AS n FROM te WHERE a_circuit IS NOT NULL GROUP BY ALL"))
def a03_circuit_states(spark, d):
    return console.circuit_states(testbed.trace_events(spark, d))


@query(of(ACTS, f"SELECT {ACT_COLUMNS} FROM acts"))
def a04_activation_rollup(spark, d):
    return flat(acts(spark, d))


@query(of(EVENTS, "SELECT trace_id, max(entity_key) AS entity_key, max(seq) AS seq, min(start_ms) AS started_ms, max(start_ms) AS last_event_ms, count(*) AS events, count(DISTINCT span_id) AS spans FROM te GROUP BY trace_id"))
def a05_trace_rollup(spark, d):
    return rollups.traces(testbed.trace_events(spark, d))


SPANS = """SELECT trace_id, span_id, max(parent_span_id) AS parent_span_id, max(entity_key) AS entity_key, max(seq) AS seq,
  CASE WHEN bool_or(event_type IN ('ACTIVATION_START', 'ACTIVATION_END')) THEN 'activation' ELSE min(event_type) END AS role,
  min(step_index) AS step_index, min(start_ms) AS first_ms, max(end_ms) AS last_ms, count(*) AS events FROM te GROUP BY trace_id, span_id"""


@query(of(EVENTS, SPANS))
def a06_span_rollup(spark, d):
    return rollups.spans(testbed.trace_events(spark, d))


@query(of(ACTS, """, a AS (SELECT entity_key, count(*) AS activations, min(started_ms) AS f, max(coalesce(ended_ms, started_ms)) AS l, sum(errors) AS errs, sum(total_tokens) AS tok, max(seq) AS latest_seq, max_by(status, seq) AS latest_status FROM acts GROUP BY 1),
  e AS (SELECT entity_key, min(event_time_ms) AS f2, max(event_time_ms) AS l2, count(*) FILTER (seq IS NULL) AS u FROM er GROUP BY 1)
  SELECT entity_key, least(f, f2) AS first_seen_ms, greatest(l, l2) AS last_seen_ms, coalesce(activations, 0) AS activations, CAST(coalesce(errs, 0) + coalesce(u, 0) AS BIGINT) AS errors, CAST(tok AS BIGINT) AS total_tokens, latest_seq, latest_status
  FROM a FULL JOIN e USING (entity_key)"""))
def a07_entity_rollup(spark, d):
    return rollups.entities(acts(spark, d), testbed.error_records(spark, d))


RAW = """, raw AS (
  SELECT trace_id, span_id, parent_span_id, entity_key, seq, step_index, event_type, start_ms, end_ms, provenance, arrival FROM te UNION ALL
  SELECT trace_id, span_id, '', '', 0, 0, event_type, 0, 0, 'otlp', arrival + 1000000000 FROM te WHERE arrival % 10 = 0)"""


@query(of(EVENTS, RAW + """ SELECT trace_id, span_id, event_type, coalesce(max_by(parent_span_id, arrival) FILTER (parent_span_id <> ''), '') AS parent_span_id,
  coalesce(max_by(entity_key, arrival) FILTER (entity_key <> ''), '') AS entity_key, coalesce(max_by(seq, arrival) FILTER (provenance <> 'otlp'), max_by(seq, arrival)) AS seq,
  coalesce(max_by(step_index, arrival) FILTER (provenance <> 'otlp'), max_by(step_index, arrival)) AS step_index,
  coalesce(max_by(start_ms, arrival) FILTER (start_ms <> 0), 0) AS start_ms, coalesce(max_by(end_ms, arrival) FILTER (end_ms <> 0), 0) AS end_ms,
  coalesce(max_by(provenance, arrival) FILTER (provenance <> 'otlp'), max_by(provenance, arrival)) AS provenance, count(*) AS copies FROM raw GROUP BY ALL"""))
def a08_event_merge(spark, d):
    return merge.merge_events(testbed.raw_events(spark, d))


_PAIRS = ", ".join(f"('{n}', CAST({c} AS VARCHAR))" for n, c in (("kind", "a_kind"), ("status", "a_status"), ("model", "a_model"), ("input_tokens", "a_in"), ("output_tokens", "a_out"), ("cache_hit", "a_cache"), ("billed", "a_billed"), ("attempts", "a_attempts"), ("circuit_state", "a_circuit"), ("tool_name", "a_tool"), ("intent_id", "a_intent"), ("intent_kind", "a_intent_kind"), ("expires_at_ms", "a_expires"), ("deadline_ms", "a_deadline"), ("reason", "a_reason"), ("error_type", "a_error_type"), ("failure_step", "a_fstep"), ("failure_last_event", "a_flast"), ("failure_staged_intents", "a_fintents"), ("failure_llm_calls", "a_fcalls"), ("exporter", "CASE WHEN arrival % 10 = 0 THEN 'otlp' END")))
ATTRIBUTES = f"SELECT trace_id, span_id, event_type, x.a AS attribute, x.v AS value FROM te, LATERAL (SELECT * FROM (VALUES {_PAIRS}) y(a, v)) x WHERE x.v IS NOT NULL"


@query(of(EVENTS, ATTRIBUTES))
def a09_attribute_merge(spark, d):
    return merge.merge_attributes(testbed.raw_events(spark, d))


@query(of(EVENTS, "SELECT error_id, any_value(entity_key) AS entity_key, any_value(seq) AS seq, any_value(reason) AS reason, any_value(detail) AS detail, any_value(event_time_ms) AS event_time_ms, 'native' AS provenance FROM er GROUP BY error_id"))
def a10_error_merge(spark, d):
    e = testbed.error_records(spark, d)
    late = e.filter(F.col("arrival") % 3 == 0).withColumns({"provenance": F.lit("otlp"), "arrival": F.col("arrival") + 1000000000})
    return merge.merge_errors(e.unionByName(late))


@query(of(BOTH, "SELECT entity_key, seq, reason, detail, event_time_ms, error_type, failure_step, failure_last_event, failure_staged_intents, failure_llm_calls, seq_key FROM ue"))
def a11_error_unified(spark, d):
    return console.unified_errors(testbed.store(spark, d))


@query(of(BOTH, """SELECT reason, error_type, count(*) AS "count", count(DISTINCT entity_key) AS entities, min(event_time_ms) AS first_seen_ms, max(event_time_ms) AS last_seen_ms,
  coalesce(min_by(detail, (event_time_ms, detail)) FILTER (detail <> ''), '') AS sample_detail FROM ue GROUP BY reason, error_type"""))
def a12_error_groups(spark, d):
    return console.error_groups(console.unified_errors(testbed.store(spark, d)))


@query(of(BOTH, """, b AS (SELECT max(event_time_ms) - min(event_time_ms) + 1 AS span FROM ue), z AS (SELECT greatest(1, CAST(ceil(span / 48) AS BIGINT)) AS size FROM b),
  g AS (SELECT reason, min(event_time_ms) // size * size AS f, max(event_time_ms) // size * size AS l, any_value(size) AS size FROM ue, z GROUP BY reason, size),
  fr AS (SELECT reason, unnest(range(f, l + 1, size)) AS bucket_ms FROM g), c AS (SELECT reason, event_time_ms // size * size AS bucket_ms, count(*) AS n FROM ue, z GROUP BY ALL)
  SELECT reason, bucket_ms, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM fr LEFT JOIN c USING (reason, bucket_ms)"""))
def a14_error_series(spark, d):
    u = console.unified_errors(testbed.store(spark, d))
    lo, hi = u.agg(F.min("event_time_ms"), F.max("event_time_ms")).first()
    return console.gap_filled(u, ["reason"], "event_time_ms", F.lit(console.bucket_size((hi or 0) - (lo or 0) + 1, 48)), F.count("*"))


EXTENT = ", ex AS (SELECT min(t) AS oldest, max(t) AS newest FROM (SELECT start_ms AS t FROM te UNION ALL SELECT event_time_ms FROM er UNION ALL SELECT snapshot_at_ms FROM sn UNION ALL SELECT started_ms FROM acts UNION ALL SELECT ended_ms FROM acts))"
WEEK = 7 * 86400000


@query(of(BOTH, EXTENT + f""", h AS (SELECT count(*) AS activations, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'suspended') AS suspended, count(*) FILTER (status = 'in_flight') AS in_flight,
  count(*) FILTER (errors > 0) AS failed, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(llm_calls) AS BIGINT) AS llm_calls, CAST(sum(tool_calls) AS BIGINT) AS tool_calls,
  quantile_disc(wall_ms, 0.5) AS p50_wall_ms, quantile_disc(wall_ms, 0.95) AS p95_wall_ms FROM acts, ex WHERE started_ms >= newest - {WEEK}),
  c AS (SELECT count(*) FILTER (a_cache = 'true') AS hits, count(a_cache) AS measured FROM te, ex WHERE event_type = 'LLM_CALL' AND start_ms >= newest - {WEEK}),
  u AS (SELECT count(*) AS errors FROM ue, ex WHERE event_time_ms >= newest - {WEEK})
  SELECT activations, completed, suspended, in_flight, errors, CASE WHEN activations > 0 THEN failed / activations END AS error_ratio, total_tokens, llm_calls, tool_calls,
  CASE WHEN measured > 0 THEN hits / measured END AS cache_hit_ratio, p50_wall_ms, p95_wall_ms FROM h, c, u"""))
def a15_overview_headline(spark, d):
    s = testbed.store(spark, d)
    return console.overview(s, rollups.activations(s.events, s.errors), WEEK)["headline"]


@query(of(ACTS, "SELECT status, quantile_disc(wall_ms, 0.5) AS p50, quantile_disc(wall_ms, 0.95) AS p95, count(wall_ms) AS n FROM acts GROUP BY status"))
def a16_wall_percentiles(spark, d):
    return acts(spark, d).groupBy("status").agg(*(F.expr(f"percentile_disc({f}) within group (order by wall_ms)").cast("bigint").alias(n) for n, f in (("p50", 0.5), ("p95", 0.95))), F.count("wall_ms").alias("n"))


@query(of(ACTS, f"SELECT {ACT_COLUMNS} FROM acts WHERE status = 'completed' AND kind = 'start' ORDER BY started_ms DESC, entity_key DESC, seq DESC LIMIT 50"))
def a17_activation_list(spark, d):
    return flat(console.activations(acts(spark, d), console.ActivationFilter(status="completed", kind="start"), limit=50))


@query(of(ACTS, f""", p AS (SELECT * FROM acts ORDER BY started_ms DESC, entity_key DESC, seq DESC LIMIT 50), k AS (SELECT started_ms AS a, entity_key AS b, seq AS c FROM p ORDER BY 1, 2, 3 LIMIT 1)
  SELECT {ACT_COLUMNS} FROM acts, k WHERE (started_ms, entity_key, seq) < (a, b, c) ORDER BY started_ms DESC, entity_key DESC, seq DESC LIMIT 50"""))
def a18_activation_page2(spark, d):
    a = acts(spark, d)
    _, cursor, _ = console.fetch_page(a, console.ACTIVATION_ORDER, limit=50)
    return flat(console.activations(a, cursor=cursor, limit=50)) if cursor else flat(a.limit(0))


@query(of(ACTS, f"SELECT {ACT_COLUMNS} FROM acts WHERE list_contains(tools, 'tool-3') AND list_contains(reasons, 'hitl_timeout') AND lower(coalesce(model, '')) LIKE '%m-%' "))
def a19_filter_member(spark, d):
    return flat(console.ActivationFilter(tool="tool-3", reason="hitl_timeout").apply(acts(spark, d)).filter(console.like(F.coalesce("model", F.lit("")), "m-")))


APPROVALS = """, ap AS (SELECT entity_key, seq, step_index, start_ms AS requested_ms, a_intent AS intent_id, a_tool AS tool_name, a_expires AS expires_at_ms FROM te WHERE event_type = 'INTENT_EMITTED' AND a_intent_kind = 'APPROVAL'),
  sd AS (SELECT entity_key, seq, max_by(a_deadline, (start_ms, span_id)) AS deadline_ms FROM te WHERE event_type = 'SUSPENDED' GROUP BY 1, 2),
  full_ap AS (SELECT ap.*, deadline_ms, (SELECT count(*) FROM ap l WHERE l.entity_key = ap.entity_key AND l.seq = ap.seq AND l.requested_ms > ap.requested_ms) AS escalations,
    (SELECT min(event_time_ms) FROM ue e WHERE e.entity_key = ap.entity_key AND (e.seq = ap.seq OR e.seq IS NULL) AND e.reason = 'hitl_timeout') AS decided_ms
    FROM ap LEFT JOIN sd USING (entity_key, seq))"""


@query(of(BOTH, APPROVALS + " SELECT *, CASE WHEN decided_ms IS NULL THEN 'pending' ELSE 'expired' END AS decision FROM full_ap"))
def a20_approvals(spark, d):
    return console.approvals(testbed.store(spark, d))


@query(of(BOTH, APPROVALS + " SELECT escalations, count(*) AS n FROM full_ap WHERE decided_ms IS NULL GROUP BY 1"))
def a21_pending_escalations(spark, d):
    return console.approvals(testbed.store(spark, d), pending_only=True).groupBy("escalations").agg(F.count("*").alias("n"))


@query(of(ACTS, """SELECT entity_key, count(*) AS activations, min(started_ms) AS first_seen_ms, max(started_ms) AS last_seen_ms, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  max_by(seq, (started_ms, seq)) AS latest_seq, max_by(status, (started_ms, seq)) AS latest_status FROM acts GROUP BY entity_key ORDER BY last_seen_ms DESC, entity_key DESC LIMIT 50"""))
def a22_entities_page(spark, d):
    return console.page(console.entities(acts(spark, d)), ["last_seen_ms", "entity_key"], None, 50)


@query(of(BOTH, """, s1 AS (SELECT 'entity' AS kind, entity_key, CAST(NULL AS BIGINT) AS seq, entity_key || ' (' || count(*) || ' activations)' AS label, 'entity_key' AS matched_field, entity_key AS matched_value, max(started_ms) AS at_ms FROM acts WHERE lower(entity_key) LIKE '%m-1%' GROUP BY entity_key ORDER BY at_ms DESC, label, matched_field, entity_key LIMIT 10),
  s2 AS (SELECT 'activation' AS kind, entity_key, seq, entity_key || '#' || seq AS label, CASE WHEN contains(lower(entity_key), 'm-1') THEN 'entity_key' ELSE 'trace_id' END AS matched_field, CASE WHEN contains(lower(entity_key), 'm-1') THEN entity_key ELSE trace_id END AS matched_value, started_ms AS at_ms FROM acts WHERE lower(entity_key) LIKE '%m-1%' OR lower(trace_id) LIKE '%m-1%' ORDER BY at_ms DESC, label, matched_field LIMIT 10),
  att AS (SELECT te.entity_key, te.seq, te.event_type, te.step_index, te.start_ms, x.a, x.v FROM te, LATERAL (SELECT * FROM (VALUES """ + _PAIRS.replace("('exporter', CAST(CASE WHEN arrival % 10 = 0 THEN 'otlp' END AS VARCHAR))", "('none', NULL)") + """) y(a, v)) x WHERE lower(x.v) LIKE '%m-1%'),
  s3 AS (SELECT 'event' AS kind, entity_key, seq, event_type || ' @ step ' || step_index AS label, a AS matched_field, v AS matched_value, start_ms AS at_ms FROM att ORDER BY at_ms DESC, label, matched_field, entity_key, seq LIMIT 10),
  s4 AS (SELECT 'error' AS kind, entity_key, seq, reason AS label, CASE WHEN contains(lower(reason), 'm-1') THEN 'reason' ELSE 'detail' END AS matched_field, CASE WHEN contains(lower(reason), 'm-1') THEN reason ELSE detail END AS matched_value, event_time_ms AS at_ms FROM ue WHERE lower(reason) LIKE '%m-1%' OR lower(detail) LIKE '%m-1%' ORDER BY at_ms DESC, label, matched_field, entity_key, seq LIMIT 10)
  SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4) ORDER BY at_ms DESC, kind, label LIMIT 40"""))
def a23_search(spark, d):
    s = testbed.store(spark, d)
    return console.search(s, rollups.activations(s.events, s.errors), "m-1", limit=40)


@query(of(ACTS, """SELECT 'activations' AS table_name, count(*) AS "rows" FROM acts UNION ALL SELECT 'errors', count(*) FROM er UNION ALL SELECT 'events', count(*) FROM te UNION ALL SELECT 'snapshots', count(*) FROM sn"""))
def a24_store_status(spark, d):
    return console.store_status(testbed.store(spark, d), acts(spark, d))


@query(of(ACTS, EXTENT + " SELECT oldest AS oldest_record_ms, newest AS newest_record_ms FROM ex"))
def a25_extent(spark, d):
    return console.extent(testbed.store(spark, d), acts(spark, d))


@query(of(ACTS, "SELECT entity_key, seq, unnest(tools) AS member FROM acts"))
def a26_tool_facets(spark, d):
    return rollups.facets(acts(spark, d), "tools")


@query(of(ACTS, "SELECT entity_key, seq, unnest(reasons) AS member FROM acts"))
def a27_reason_facets(spark, d):
    return rollups.facets(acts(spark, d), "reasons")


@query(of(EVENTS, f""", sp AS ({SPANS}), ch AS (SELECT trace_id, parent_span_id AS span_id, min(step_index) AS entry_step, bool_or(role = 'ERROR') AS errored FROM sp WHERE role <> 'activation' GROUP BY 1, 2),
  o AS (SELECT trace_id, span_id, min(start_ms) FILTER (event_type = 'ACTIVATION_END') AS end_ms, bool_or(event_type = 'ACTIVATION_END') AS ended, min_by(a_status, start_ms) FILTER (event_type = 'ACTIVATION_END') AS st0,
    max_by(a_kind, (CASE WHEN event_type = 'ACTIVATION_END' THEN 1 ELSE 0 END, start_ms)) FILTER (a_kind IS NOT NULL) AS kd FROM te WHERE event_type IN ('ACTIVATION_START', 'ACTIVATION_END') GROUP BY 1, 2),
  se AS (SELECT trace_id, span_id, a_status FROM te WHERE event_type = 'ACTIVATION_END')
  SELECT sp.trace_id, sp.span_id, sp.entity_key, sp.seq, coalesce(kd, 'unknown') AS kind, coalesce(entry_step, 0) AS entry_step_index, sp.first_ms AS start_ms, end_ms,
    CASE WHEN ended THEN coalesce(se.a_status, 'in_flight') WHEN errored THEN 'error' ELSE 'in_flight' END AS status
  FROM sp LEFT JOIN o USING (trace_id, span_id) LEFT JOIN ch USING (trace_id, span_id) LEFT JOIN se USING (trace_id, span_id) WHERE sp.role = 'activation'"""))
def a28_attempts(spark, d):
    return console.attempts(testbed.trace_events(spark, d))


@query(of(ACTS, EXTENT + f" SELECT (SELECT count(*) FROM te, ex WHERE start_ms >= newest - {WEEK}) AS events, (SELECT count(*) FROM er, ex WHERE event_time_ms >= newest - {WEEK}) AS errors, (SELECT count(*) FROM sn, ex WHERE snapshot_at_ms >= newest - {WEEK}) AS snapshots"))
def a29_retention_prune(spark, d):
    s = testbed.store(spark, d)
    now = console.newest(s, rollups.activations(s.events, s.errors)) or 0
    kept = [merge.retained(df, c, now, WEEK).agg(F.count("*").alias(n)) for n, df, c in (("events", s.events, "start_ms"), ("errors", s.errors, "event_time_ms"), ("snapshots", s.snapshots, "snapshot_at_ms"))]
    return kept[0].crossJoin(kept[1]).crossJoin(kept[2])  # three single rows


@query(of(ACTS, "SELECT a.trace_id, a.entity_key, a.seq, status, started_ms, count(te.trace_id) AS event_count, count(DISTINCT te.span_id) AS span_count FROM acts a LEFT JOIN te USING (trace_id) GROUP BY ALL"))
def a30_traces(spark, d):
    s = testbed.store(spark, d)
    return console.traces(rollups.activations(s.events, s.errors), s.events)


@query(of(ACTS, EXTENT + f""", w AS (SELECT newest - {WEEK} AS f, newest AS l, CAST(ceil({WEEK} / 48) AS BIGINT) AS size FROM ex), fr AS (SELECT unnest(range(f // size * size, l // size * size + 1, size)) AS bucket_ms FROM w),
  c AS (SELECT started_ms // size * size AS bucket_ms, sum(total_tokens) AS v FROM acts, w WHERE started_ms >= f AND total_tokens IS NOT NULL GROUP BY 1)
  SELECT bucket_ms, CAST(coalesce(v, 0) AS DOUBLE) AS value FROM fr LEFT JOIN c USING (bucket_ms)"""))
def a31_token_series(spark, d):
    s = testbed.store(spark, d)
    return console.overview(s, rollups.activations(s.events, s.errors), WEEK)["token_series"]


@query(of(EVENTS, "SELECT entity_key, seq, a_intent AS intent_id, a_tool AS tool_name, a_intent_kind AS intent_kind, step_index, a_expires AS expires_at_ms, start_ms AS emitted_at_ms FROM te WHERE event_type = 'INTENT_EMITTED'"))
def a32_intents(spark, d):
    return console.intents(testbed.trace_events(spark, d))


@query(of(BOTH, "SELECT entity_key, seq, reason, detail, event_time_ms, error_type, failure_step, failure_last_event, failure_staged_intents, failure_llm_calls, seq_key FROM ue WHERE reason = 'hitl_timeout' ORDER BY event_time_ms DESC, entity_key DESC, seq_key DESC, reason DESC LIMIT 25"))
def a33_error_page(spark, d):
    return console.errors(testbed.store(spark, d), reason="hitl_timeout", limit=25)

