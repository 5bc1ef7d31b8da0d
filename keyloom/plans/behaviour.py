"""Queries over keys, state, effects, evaluation and replay; registered in the catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..operators import longterm
from ..operators.rollups import attribute, number
from ..sources import testbed
from ..streaming import agents, fold
from ..streaming.kernel import Batching, Config, Escalate, TimeoutPolicy
from . import console
from .catalog import query
from .oracle import EVENTS, STEPPED, dashed, of, uuid5_hex

_SHARD = "CAST((('0x' || substr(sha256(props), 1, 16))::UBIGINT) % 8 AS INTEGER)"


@query(of(STEPPED, f"SELECT entity_key || '#' || {_SHARD} AS shard_key, count(*) AS n FROM st GROUP BY ALL"))
def b01_shard_keys(spark, d):
    e = testbed.stepped(spark, d)
    return e.groupBy(ids.shard_key(F.col("entity_key"), F.col("props"), 8).alias("shard_key")).agg(F.count("*").alias("n"))


@query(of(STEPPED, "SELECT entity_key, count(*) AS n FROM st GROUP BY ALL"))
def b02_shard_roundtrip(spark, d):
    e = testbed.stepped(spark, d).select(ids.shard_key(F.col("entity_key"), F.col("props"), 8).alias("s"))
    return e.groupBy(ids.unshard_key(F.col("s")).alias("entity_key")).agg(F.count("*").alias("n"))


_N = "entity_key || '|' || CAST(seq AS VARCHAR)"


@query(of(STEPPED, f"SELECT DISTINCT entity_key, seq, {uuid5_hex(ids.TRACE_NAMESPACE, _N)} AS trace_id, substr({uuid5_hex(ids.TRACE_NAMESPACE, _N + chr(32) + '||' + chr(32) + repr('|activation|0'))}, 1, 16) AS span_id, {dashed(uuid5_hex(ids.INTENT_NAMESPACE, _N + ' || ' + repr('|2')))} AS intent_id FROM st"))
def b03_derived_ids(spark, d):
    e = testbed.stepped(spark, d).select("entity_key", "seq").distinct()
    k, s = F.col("entity_key"), F.col("seq")
    return e.select("entity_key", "seq", ids.trace_id(k, s).alias("trace_id"), ids.span_id(k, s, F.lit("activation"), F.lit(0)).alias("span_id"), ids.intent_id(k, s, F.lit(2)).alias("intent_id"))


_ORD = "(SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY t, event_id) AS r FROM st)"


@query(of(STEPPED, f"SELECT entity_key, (r - 1) // 10 AS batch, count(*) AS size, max(t) AS now_ms, count(*) >= 10 AS flushed FROM {_ORD} GROUP BY ALL"))
def b04_batch_flush(spark, d):
    return longterm.size_batches(testbed.envelopes(spark, d), 10)


@query(of(STEPPED, "SELECT entity_key, event_id AS arrival, count(*) OVER w AS n, CAST(sum(k) OVER w AS BIGINT) AS sum FROM st WINDOW w AS (PARTITION BY entity_key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def b05_running_memory(spark, d):
    return longterm.running(testbed.envelopes(spark, d), F.col("k")).select("entity_key", "arrival", "n", "sum")


@query(of(STEPPED, "SELECT entity_key, 'name-' || (k % 3) AS name, arg_max(props, (seq, event_id)) AS value, max(seq) AS seq, arg_max(t, (seq, event_id)) AS updated_at_ms FROM st GROUP BY entity_key, k % 3"))
def b06_longterm_upsert(spark, d):
    e = testbed.stepped(spark, d)
    return longterm.upsert(e.select("entity_key", F.concat(F.lit("name-"), F.col("k") % 3).alias("name"), F.col("props").alias("value"), "seq", F.col("t").alias("updated_at_ms"), F.col("event_id").alias("arrival")))


@query(of(EVENTS, """, l AS (SELECT entity_key, seq, row_number() OVER (PARTITION BY entity_key, seq ORDER BY arrival) - 1 AS position, event_type, a_model AS model, arrival FROM te),
  r AS (SELECT entity_key, seq, position, event_type, CASE WHEN arrival % 17 = 0 THEN 'other' ELSE model END AS model FROM l WHERE NOT (arrival % 23 = 0 AND position = 4)),
  j AS (SELECT coalesce(l.entity_key, r.entity_key) AS entity_key, coalesce(l.seq, r.seq) AS seq, coalesce(l.position, r.position) AS position,
    CASE WHEN l.entity_key IS NULL OR r.entity_key IS NULL THEN 'missing' WHEN l.event_type IS DISTINCT FROM r.event_type THEN 'event_type' WHEN l.model IS DISTINCT FROM r.model THEN 'model' END AS what
    FROM l FULL JOIN r ON l.entity_key = r.entity_key AND l.seq = r.seq AND l.position = r.position)
  SELECT entity_key, seq, min(position) AS position, arg_min(what, position) AS what FROM j WHERE what IS NOT NULL GROUP BY 1, 2"""))
def b07_replay_diff(spark, d):
    w = Window.partitionBy("entity_key", "seq").orderBy("arrival")
    e = testbed.trace_events(spark, d).select("entity_key", "seq", "arrival", "event_type", attribute("model").alias("model"), (F.row_number().over(w) - 1).cast("bigint").alias("position"))
    other = e.filter(~((F.col("arrival") % 23 == 0) & (F.col("position") == 4))).withColumn("model", F.when(F.col("arrival") % 17 == 0, "other").otherwise(F.col("model")))
    return longterm.first_divergence(e, other, ("entity_key", "seq"), ("event_type", "model"))


@query(of(STEPPED, "SELECT entity_key, event_id AS arrival, row_number() OVER (PARTITION BY entity_key ORDER BY t DESC, event_id DESC) AS back FROM st QUALIFY back <= 64"))
def b08_ring_last_n(spark, d):
    return longterm.last_n(testbed.envelopes(spark, d), 64).select("entity_key", "arrival", "back")


@query(of(STEPPED, "SELECT entity_key, CAST(1 AS BIGINT) AS entries, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM (SELECT entity_key, props FROM st QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY t DESC, event_id DESC) <= 64) GROUP BY 1"))
def b09_ring_fold(spark: SparkSession, d: str) -> DataFrame:
    """The same ring by the kernel: sizes of each key's memory, read by a state export at the end."""
    e = testbed.envelopes(spark, d).select("entity_key", "event_time_ms", "arrival", "kind", "external_event", F.lit(None).cast("string").alias("export_request"))
    ends = e.groupBy("entity_key").agg((F.max("event_time_ms") + 1).alias("event_time_ms"))
    ask = ends.select("entity_key", "event_time_ms", F.lit(1 << 40).alias("arrival"), F.lit("export_request").alias("kind"), F.lit(None).cast("string").alias("external_event"), F.lit('{"request_id":"end"}').alias("export_request"))
    rows = fold.run_agent(e.unionByName(ask), Config(agent=agents.last_items, ttl_ms=10**13), streams=("snapshots",))
    return fold.stream_of(rows, "snapshots").select("entity_key", F.get_json_object("body", "$.memory_entries").cast("bigint").alias("entries"), F.get_json_object("body", "$.memory_bytes").cast("bigint").alias("bytes"))


@query(of(EVENTS, """, c AS (SELECT entity_key, seq, arrival, coalesce(a_in, 0) + coalesce(a_out, 0) AS tokens FROM te WHERE event_type = 'LLM_CALL')
  SELECT entity_key, seq, arrival, CAST(coalesce(sum(tokens) OVER (PARTITION BY entity_key, seq ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    coalesce(sum(tokens) OVER (PARTITION BY entity_key, seq ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 100 AS refused FROM c"""))
def b10_budget_trip(spark, d):
    e = testbed.trace_events(spark, d).filter("event_type = 'LLM_CALL'")
    tokens = F.coalesce(number("input_tokens"), F.lit(0)) + F.coalesce(number("output_tokens"), F.lit(0))
    return longterm.budget_trips(e.withColumn("tokens", tokens), F.col("tokens"), 100, ("entity_key", "seq"), ("arrival",)).select("entity_key", "seq", "arrival", "before", "refused")


@query(of(STEPPED, """, q AS (SELECT entity_key, seq, min(event_id) AS asked, min(t) + 86400000 AS deadline_ms, min(t) + 43200000 AS expires_at_ms FROM st WHERE etype = 'view' GROUP BY 1, 2),
  a AS (SELECT entity_key, seq, event_id AS arrival, t, CASE WHEN k % 5 = 0 THEN -1 END AS wrong FROM st WHERE etype = 'purchase')
  SELECT a.entity_key, a.seq, arrival, CASE WHEN asked IS NULL THEN 'no_continuation' WHEN wrong IS NOT NULL THEN 'unknown_intent' WHEN t >= deadline_ms THEN 'deadline_passed' WHEN t >= expires_at_ms THEN 'intent_expired' END AS refusal
  FROM a LEFT JOIN q USING (entity_key, seq)"""))
def a13_admission(spark, d):
    """Purchases answer the first view of their activation; every fifth names a wrong question."""
    e = testbed.stepped(spark, d)
    q = e.filter("etype = 'view'").groupBy("entity_key", "seq").agg(F.min("event_id").alias("intent_id"), (F.min("t") + 86400000).alias("deadline_ms"), (F.min("t") + 43200000).alias("expires_at_ms"))
    asked = q.select("entity_key", "seq", F.col("intent_id").alias("own"))
    a = e.filter("etype = 'purchase'").join(asked, ["entity_key", "seq"], "left").select("entity_key", "seq", F.col("event_id").alias("arrival"), F.col("t").alias("event_time_ms"), F.when(F.col("k") % 5 == 0, F.lit(-1)).otherwise(F.coalesce("own", F.lit(-1))).alias("intent_id"))
    return longterm.admission(a, q).select("entity_key", "seq", "arrival", "refusal")


@query(of(EVENTS, """, i AS (SELECT a_intent AS intent_id, a_intent_kind AS kind, a_tool AS tool_name, a_expires AS expires_at_ms FROM te WHERE event_type = 'INTENT_EMITTED'), n AS (SELECT max(start_ms) - 86400000 AS now FROM te)
  SELECT intent_id, CASE WHEN expires_at_ms <= now THEN 'EXPIRED' WHEN kind = 'APPROVAL' THEN 'ROUTED' WHEN tool_name NOT IN ('tool-1', 'tool-2', 'tool-3') THEN 'REJECTED' ELSE 'OK' END AS status FROM i, n"""))
def b11_effect_status(spark, d):
    e = testbed.trace_events(spark, d)
    now = (e.agg(F.max("start_ms")).first()[0] or 0) - 86400000
    i = console.intents(e).select("intent_id", "tool_name", F.col("intent_kind").alias("kind"), "expires_at_ms", F.col("emitted_at_ms").alias("created_at_ms"))
    return longterm.effect_status(i.unionByName(i.filter(F.col("tool_name") == "tool-1")), now, ["tool-1", "tool-2", "tool-3"]).select("intent_id", "status")


@query(of(EVENTS, """, s AS (SELECT *, sum(CASE WHEN event_type = 'ACTIVATION_START' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_key, seq ORDER BY arrival) AS attempt FROM te),
  g AS (SELECT entity_key, seq, coalesce(max(attempt) FILTER (event_type = 'ACTIVATION_START' AND a_kind = 'resume'), max(attempt)) AS chosen FROM s GROUP BY 1, 2)
  SELECT s.entity_key, s.seq, arrival, event_type, CAST(attempt AS BIGINT) AS attempt FROM s JOIN g USING (entity_key, seq) WHERE attempt = chosen"""))
def b12_select_attempt(spark, d):
    return longterm.select_attempt(testbed.trace_events(spark, d), "resume").select("entity_key", "seq", "arrival", "event_type", "attempt")


WAIT = 3 * 86400000
OUTCOMES = """, oc AS (SELECT lower(hex(CAST(o_custkey AS VARCHAR))) AS entity_key, o_orderkey % 7 AS seq, o_orderpriority AS scenario, o_orderstatus AS label, epoch_us(o_orderdate) // 1000 AS t0, o_orderkey AS arrival FROM orders),
  lo AS (SELECT (SELECT min(start_ms) FROM te) - (SELECT min(t0) FROM oc) AS shift), ou AS (SELECT oc.* EXCLUDE (t0), (t0 - (SELECT min(t0) FROM oc)) // 80 + (SELECT min(start_ms) FROM te) AS event_time_ms FROM oc),
  tt AS (SELECT entity_key, seq, min(start_ms) AS end_ms FROM te GROUP BY 1, 2)"""
JOINED = f"""{OUTCOMES}, jj AS (SELECT ou.*, end_ms, end_ms IS NULL OR event_time_ms > end_ms + {WAIT} OR event_time_ms < end_ms AS late FROM ou LEFT JOIN tt USING (entity_key, seq)),
  vv AS (SELECT *, CASE WHEN late OR row_number() OVER (PARTITION BY entity_key, seq, late ORDER BY event_time_ms, arrival) > 1 THEN 'orphaned' ELSE 'joined' END AS verdict FROM jj)"""


def shifted_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes brought into the time of the events: orders span years, events a month."""
    o, e = testbed.outcomes(spark, d), testbed.stepped(spark, d)
    lo = o.agg(F.min("event_time_ms")).first()[0] or 0
    to = e.agg(F.min("t")).first()[0] or 0
    return o.withColumn("event_time_ms", F.floor((F.col("event_time_ms") - lo) / 80).cast("bigint") + to)


def judged(spark: SparkSession, d: str) -> DataFrame:
    return longterm.judge_join(testbed.trace_events(spark, d), shifted_outcomes(spark, d), WAIT)


@query(of(EVENTS, JOINED + " SELECT entity_key, seq, scenario, label, event_time_ms, arrival FROM vv WHERE verdict = 'joined'"))
def c01_eval_join(spark, d):
    return judged(spark, d).filter("verdict = 'joined'").select("entity_key", "seq", "scenario", "label", "event_time_ms", "arrival")


@query(of(EVENTS, JOINED + " SELECT entity_key, seq, end_ms FROM tt WHERE NOT EXISTS (SELECT 1 FROM vv WHERE verdict = 'joined' AND vv.entity_key = tt.entity_key AND vv.seq = tt.seq)"))
def c02_no_outcome(spark, d):
    return judged(spark, d).filter("verdict = 'no_outcome'").select("entity_key", "seq", "end_ms")


@query(of(EVENTS, JOINED + " SELECT scenario, count(*) AS n FROM vv WHERE verdict = 'orphaned' GROUP BY 1"))
def c03_orphaned_outcomes(spark, d):
    return judged(spark, d).filter("verdict = 'orphaned'").groupBy("scenario").agg(F.count("*").alias("n"))


@query(of(STEPPED, """, j AS (SELECT t, 's-' || (k % 3) AS scenario, CASE WHEN k % 4 <> 0 THEN etype END AS label, CASE WHEN k % 4 <> 0 AND k % 5 <> 0 THEN 1 + k % 5 END AS score FROM st)
  SELECT t // 3600000 * 3600000 AS window_ms, scenario, count(score) AS judged, count(*) FILTER (label IS NULL) AS no_outcome, count(*) FILTER (label IS NOT NULL AND score IS NULL) AS judge_errors,
    CASE WHEN count(score) > 0 THEN sum(score) / count(score) END AS mean_score FROM j GROUP BY ALL"""))
def c04_hourly_quality(spark, d):
    k = F.col("k")
    e = testbed.stepped(spark, d).select(F.col("t").alias("event_time_ms"), F.concat(F.lit("s-"), k % 3).alias("scenario"), F.when(k % 4 != 0, F.col("etype")).alias("label"), F.when((k % 4 != 0) & (k % 5 != 0), 1 + k % 5).alias("score"))
    return longterm.hourly_quality(e)


@query(of(STEPPED, "SELECT entity_key, seq, event_id AS arrival, k FROM st QUALIFY row_number() OVER (PARTITION BY entity_key, seq ORDER BY t DESC, event_id DESC) = 1"))
def c05_verdict_dedup(spark, d):
    return longterm.latest(testbed.stepped(spark, d), ("entity_key", "seq"), ("t", "event_id")).select("entity_key", "seq", F.col("event_id").alias("arrival"), "k")


@query(of(EVENTS, "SELECT CAST(start_ms // 86400000 AS BIGINT) AS day, a_billed AS billed, count(*) AS calls, CAST(sum(a_in) AS BIGINT) AS input_tokens, CAST(sum(a_out) AS BIGINT) AS output_tokens FROM te WHERE event_type = 'LLM_CALL' GROUP BY ALL"))
def c06_spend_by_day(spark, d):
    e = testbed.trace_events(spark, d).filter("event_type = 'LLM_CALL'")
    return e.groupBy(F.floor(F.col("start_ms") / 86400000).cast("bigint").alias("day"), attribute("billed").alias("billed")).agg(F.count("*").alias("calls"), F.sum(number("input_tokens")).alias("input_tokens"), F.sum(number("output_tokens")).alias("output_tokens"))


@query(of(EVENTS, "SELECT DISTINCT trace_id, ((('0x' || substr(trace_id, 1, 16))::UBIGINT % 100) * 16 + ('0x' || substr(trace_id, 17, 16))::UBIGINT % 100) % 100 < 10 AS sampled FROM te"))
def c07_deterministic_sample(spark, d):
    e = testbed.trace_events(spark, d).select("trace_id").distinct()
    return e.select("trace_id", ids.sampled(F.col("trace_id"), 10).alias("sampled"))


@query(of(STEPPED, """SELECT entity_key, count(*) AS outputs, max(n) AS n, CAST(max(s) AS BIGINT) AS sum FROM (SELECT entity_key, count(*) OVER w AS n, sum(k) OVER w AS s FROM st WINDOW w AS (PARTITION BY entity_key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1"""))
def d01_counter_fold(spark, d):
    """The stateful operator over the whole table, checked by a window frame."""
    rows = fold.stream_of(fold.run_agent(testbed.envelopes(spark, d), Config(agent=agents.counter, ttl_ms=10**13), streams=("output",)), "output")
    return rows.groupBy("entity_key").agg(F.count("*").alias("outputs"), F.max(F.get_json_object("payload", "$.n").cast("bigint")).alias("n"), F.max(F.get_json_object("payload", "$.sum").cast("bigint")).alias("sum"))


@query(of(STEPPED, f", b AS (SELECT entity_key, (r - 1) // 10 AS batch, count(*) AS size FROM {_ORD} GROUP BY ALL) SELECT entity_key, count(*) FILTER (size = 10) AS flushes, CAST(sum(size) FILTER (size = 10) AS BIGINT) AS events FROM b GROUP BY 1 HAVING count(*) FILTER (size = 10) > 0"))
def d02_batched_fold(spark, d):
    """Adaptive batching by the kernel, with a wait so long that size alone flushes."""
    c = Config(agent=agents.counter, ttl_ms=10**13, batching=Batching(10, 10**12))
    rows = fold.stream_of(fold.run_agent(testbed.envelopes(spark, d), c, streams=("output",)), "output")
    return rows.groupBy("entity_key").agg(F.count("*").alias("flushes"), F.max(F.get_json_object("payload", "$.n").cast("bigint")).alias("events"))


@query(of(STEPPED, """, q AS (SELECT entity_key, event_id, t, t + 3600000 AS deadline FROM st), nx AS (SELECT *, lead(t) OVER (PARTITION BY entity_key ORDER BY t, event_id) AS nt FROM q)
  SELECT entity_key, count(*) AS intents, count(*) FILTER (nt >= deadline OR nt IS NULL) AS timeouts FROM nx GROUP BY 1"""))
def d03_suspend_timeouts(spark, d):
    """Each event asks for approval; a wait ends by its deadline unless a new event takes its place."""
    last = testbed.stepped(spark, d).agg(F.max("t")).first()[0] or 0
    rows = fold.run_agent(testbed.envelopes(spark, d), Config(agent=agents.buyer, ttl_ms=10**13), end_ms=last + 10**8, streams=("intents", "output"))
    return rows.groupBy("entity_key").agg(F.count_if(F.col("stream") == "intents").alias("intents"), F.count_if((F.col("stream") == "output") & (F.col("payload") == "__hitl_timeout__")).alias("timeouts"))


@query(of(STEPPED, "SELECT entity_key, count(*) AS errors FROM st GROUP BY 1"))
def d04_failures_isolated(spark, d):
    """A failing agent: one error for each event, no output, no state, no failed task."""
    rows = fold.run_agent(testbed.envelopes(spark, d), Config(agent=agents.failing), streams=("errors", "output"))
    return rows.filter("stream in ('errors', 'output')").groupBy("entity_key").agg(F.count("*").alias("errors"))


@query(of(STEPPED, """SELECT entity_key, count(*) AS outputs, max(n) AS n, CAST(max(s) AS BIGINT) AS sum FROM (SELECT entity_key, count(*) OVER w AS n, sum(k) OVER w AS s FROM st WINDOW w AS (PARTITION BY entity_key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1"""))
def d09_yielded_fold(spark, d):
    """The counter as an agent that yields its effects: what it had in memory at its last event of each key."""
    rows = fold.stream_of(fold.run_agent(testbed.envelopes(spark, d), Config(agent=agents.Counting(), ttl_ms=10**13), streams=("output",)), "output")
    return rows.groupBy("entity_key").agg(F.count("*").alias("outputs"), F.max(F.get_json_object("payload", "$.n").cast("bigint")).alias("n"), F.max(F.get_json_object("payload", "$.sum").cast("bigint")).alias("sum"))


_WAIT = 6 * 3600_000


@query(of(STEPPED, f""", f AS (SELECT entity_key, t, k, row_number() OVER (PARTITION BY entity_key ORDER BY t, event_id) AS r FROM st)
  SELECT entity_key, seq, CAST(count(*) AS BIGINT) AS size, max(t) AS last_ms FROM (
    WITH RECURSIVE g AS (SELECT entity_key, r, t, t AS begins, CAST(0 AS BIGINT) AS seq FROM f WHERE r = 1
      UNION ALL SELECT f.entity_key, f.r, f.t, CASE WHEN f.t >= g.begins + {_WAIT} THEN f.t ELSE g.begins END, CASE WHEN f.t >= g.begins + {_WAIT} THEN g.seq + 1 ELSE g.seq END FROM g JOIN f ON f.entity_key = g.entity_key AND f.r = g.r + 1)
    SELECT * FROM g) GROUP BY entity_key, seq"""))
def d10_timer_flushes(spark, d):
    """Batches that a timer flushes: the first event arms it, and all that come before it fires are one activation, at the time of the
    latest."""
    last = testbed.stepped(spark, d).agg(F.max("t")).first()[0] or 0
    c = Config(agent=agents.counter, ttl_ms=10**13, batching=Batching(10**6, _WAIT))
    rows = fold.run_agent(testbed.envelopes(spark, d), c, end_ms=last + 2 * _WAIT, streams=("traces",))
    starts = rows.filter("stream = 'traces' and event_type = 'ACTIVATION_START' and attributes['batch_trigger'] = 'timer'")
    return starts.select("entity_key", "seq", F.col("attributes")["batch_size"].cast("bigint").alias("size"), F.col("event_time_ms").alias("last_ms"))


_TTL = 8 * 3600_000


@query(of(STEPPED, f""", f AS (SELECT entity_key, t, event_id, CASE WHEN t >= lag(t) OVER w + {_TTL} THEN 1 ELSE 0 END AS fresh FROM st WINDOW w AS (PARTITION BY entity_key ORDER BY t, event_id)),
  g AS (SELECT entity_key, t, sum(fresh) OVER (PARTITION BY entity_key ORDER BY t, event_id) AS session FROM f)
  SELECT entity_key, max(t) + {_TTL} AS wiped_ms, count(*) AS events FROM g GROUP BY entity_key, session"""))
def d11_expired_batches(spark, d):
    """Events that wait for a batch until the key expires: each is reported when it is wiped, a time to live after the last of them."""
    last = testbed.stepped(spark, d).agg(F.max("t")).first()[0] or 0
    c = Config(agent=agents.counter, ttl_ms=_TTL, batching=Batching(10**6, 10**13))
    rows = fold.run_agent(testbed.envelopes(spark, d), c, end_ms=last + 2 * _TTL, streams=("errors",))
    wiped = rows.filter("stream = 'errors' and reason = 'ttl_wiped_batch'")
    return wiped.groupBy("entity_key", F.col("event_time_ms").alias("wiped_ms")).agg(F.count("*").alias("events"))


@query(of(STEPPED, """, nx AS (SELECT entity_key, t, lead(t) OVER (PARTITION BY entity_key ORDER BY t, event_id) AS nt FROM st)
  SELECT entity_key, count(*) AS asked, count(*) FILTER (nt >= t + 3600000 OR nt IS NULL) AS escalated, count(*) FILTER (nt >= t + 5400000 OR nt IS NULL) AS denied FROM nx GROUP BY 1"""))
def d12_escalations(spark, d):
    """Each event asks for approval; after an hour somebody else is asked, once, and half an hour later the answer is no."""
    last = testbed.stepped(spark, d).agg(F.max("t")).first()[0] or 0
    policy = TimeoutPolicy(max_escalations=1, on_timeout=lambda waiting: Escalate("oncall", timeout_ms=1800_000))
    rows = fold.run_agent(testbed.envelopes(spark, d), Config(agent=agents.buyer, ttl_ms=10**13, policy=policy), end_ms=last + 10**8, streams=("intents", "output"))
    intents = F.col("stream") == "intents"
    return rows.groupBy("entity_key").agg(
        F.count_if(intents & (F.col("tool_name") == "approval")).alias("asked"), F.count_if(intents & (F.col("tool_name") == "oncall")).alias("escalated"), F.count_if((F.col("stream") == "output") & (F.col("payload") == "__hitl_timeout__")).alias("denied")
    )


@query(of(EVENTS, f""", sp AS (SELECT trace_id, span_id, max(parent_span_id) AS parent, min(start_ms) AS first_ms FROM te GROUP BY 1, 2),
  rt AS (SELECT s.*, p.span_id IS NULL OR s.parent = s.span_id AS root FROM sp s LEFT JOIN sp p ON s.trace_id = p.trace_id AND s.parent = p.span_id),
  tr AS (SELECT trace_id, span_id, 0 AS depth, lpad(CAST(first_ms AS VARCHAR), 16, '0') || span_id AS path FROM rt WHERE root
    UNION ALL SELECT r.trace_id, r.span_id, 1, lpad(CAST(p.first_ms AS VARCHAR), 16, '0') || p.span_id || lpad(CAST(r.first_ms AS VARCHAR), 16, '0') || r.span_id FROM rt r JOIN rt p ON r.trace_id = p.trace_id AND r.parent = p.span_id WHERE NOT r.root)
  SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position FROM tr"""))
def e01_span_tree(spark, d):
    return console.span_tree(testbed.trace_events(spark, d))


@query(of(STEPPED, """, r AS (SELECT entity_key, t, event_id, count(*) OVER (PARTITION BY entity_key) AS n FROM st QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY t DESC, event_id DESC) = 1)
  SELECT entity_key, n AS seq, t + 1 AS event_time_ms, CAST(1 AS BIGINT) AS pending, t + 3600000 AS deadline_ms, CAST(0 AS BIGINT) AS entries FROM r"""))
def d05_state_export(spark, d):
    """Exports of the waiting agent: sequence, what it waits for and until when."""
    e = testbed.envelopes(spark, d).select("entity_key", "event_time_ms", "arrival", "kind", "external_event", F.lit(None).cast("string").alias("export_request"))
    ask = e.groupBy("entity_key").agg((F.max("event_time_ms") + 1).alias("event_time_ms"), F.lit(1 << 40).alias("arrival"), F.lit("export_request").alias("kind"), F.lit(None).cast("string").alias("external_event"), F.lit(json.dumps({"request_id": "end"})).alias("export_request"))
    rows = fold.stream_of(fold.run_agent(e.unionByName(ask), Config(agent=agents.buyer, ttl_ms=10**13), streams=("snapshots",)), "snapshots")
    said = lambda n: F.get_json_object("body", f"$.{n}").cast("bigint")
    pending = F.size(F.from_json(F.get_json_object("body", "$.pending_intent_ids"), "array<string>")).cast("bigint")
    return rows.select("entity_key", "seq", "event_time_ms", pending.alias("pending"), said("continuation_deadline_ms").alias("deadline_ms"), said("memory_entries").alias("entries"))
