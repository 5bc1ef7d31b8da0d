"""Queries over the runtime's own records: store, replay, judge, effects, metrics and details; registered in the catalog."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import effects, merge, rollups, staging
from ..operators.rollups import attribute
from ..operators.store import RecordStore
from ..sources import testbed
from ..streaming import agents, evaluation, fold, metrics, tools
from ..streaming.kernel import Complete, Config, Context
from ..streaming.model import ProviderError, Response
from . import console
from .behaviour import JOINED, judged
from .catalog import EXTENT, WEEK, query
from .oracle import ACTS, BOTH, EVENTS, STEPPED, of

DAY = 86400000


def fresh_store(spark: SparkSession) -> RecordStore:
    return RecordStore(spark, f"{staging.shared_dir(spark)}/keyloom/store-{uuid.uuid4().hex}", buckets=8)


_HALF = "te WHERE arrival % 2 = 0"


@query(of(EVENTS, f"""SELECT (SELECT count(*) FROM {_HALF}) AS added, 0 AS repeated, (SELECT count(*) FROM te WHERE arrival % 2 = 1) + (SELECT count(*) FROM te WHERE arrival % 10 = 0) AS more, (SELECT count(*) FROM te) AS kept"""))
def a34_store_changes(spark, d):
    """What three batches change: half of the events, the same again, and all with late lossy copies."""
    store, raw = fresh_store(spark), testbed.raw_events(spark, d)
    half = testbed.trace_events(spark, d).filter("arrival % 2 = 0")
    changes = [store.write(events=half), store.write(events=half), store.write(events=raw)]
    return spark.createDataFrame([(*changes, store.events.count())], "added bigint, repeated bigint, more bigint, kept bigint")


@query(of(ACTS, f"""{', '} cut AS (SELECT max(start_ms) - {WEEK} AS c FROM te)
  SELECT trace_id, max(entity_key) AS entity_key, max(seq) AS seq, min(start_ms) AS started_ms, max(start_ms) AS last_event_ms, count(*) AS events, count(DISTINCT span_id) AS spans FROM te, cut WHERE start_ms >= c GROUP BY trace_id"""))
def a35_pruned_traces(spark, d):
    """Trace rollups of the store after a retention run."""
    store, e = fresh_store(spark), testbed.trace_events(spark, d)
    store.write(events=e, errors=testbed.error_records(spark, d))
    store.prune(e.agg(F.max("start_ms")).first()[0] or 0, WEEK)
    return store.table("traces")


@query(of(ACTS, "SELECT entity_key, seq, trace_id, status, kind, attempts, errors, llm_calls, total_tokens, wall_ms FROM acts"))
def a36_store_activations(spark, d):
    """Activation rollups that the store keeps from two batches, against one computed at once."""
    store, e, r = fresh_store(spark), testbed.trace_events(spark, d), testbed.error_records(spark, d)
    store.write(events=e.filter("arrival % 3 <> 0"), errors=r.filter("arrival % 4 = 0"))
    store.write(events=e.filter("arrival % 3 = 0"), errors=r.filter("arrival % 4 <> 0"))
    return store.table("activations").select("entity_key", "seq", "trace_id", "status", "kind", "attempts", "errors", "llm_calls", "total_tokens", "wall_ms")


def _streamed(spark: SparkSession, store: RecordStore, kind: str, table: DataFrame, folder: str, checkpoint: str, parts: int, told: list) -> None:
    """A table as a stream into the store: each part is what has come when the query is started again."""
    name = checkpoint.rsplit("/", 1)[-1].split("-")[0]
    for part in range(parts):
        table.filter(F.pmod("arrival", F.lit(parts)) == part).write.mode("overwrite").parquet(f"{folder}/part={part}")
        stream = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(folder)
        sink = store.sink(query=f"{name}/{kind}", kind=kind, done=lambda batch, changed: told.append((batch, changed)))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(of(ACTS, "SELECT entity_key, seq, trace_id, status, kind, attempts, errors, llm_calls, total_tokens, wall_ms FROM acts"))
def a42_streamed_activations(spark, d):
    """Activation rollups of a store that three streams fill, in two batches each."""
    store = fresh_store(spark)
    for kind, table in (("events", testbed.raw_events(spark, d)), ("errors", testbed.error_records(spark, d)), ("snapshots", testbed.snapshots(spark, d))):
        _streamed(spark, store, kind, table, f"{store.path}/_in/{kind}", f"{store.path}/_in/console-{kind}", 2, [])
    return store.table("activations").select("entity_key", "seq", "trace_id", "status", "kind", "attempts", "errors", "llm_calls", "total_tokens", "wall_ms")


@query(of(EVENTS, """SELECT 'first' AS run, CAST(0 AS BIGINT) AS batch, count(*) AS changed FROM te WHERE arrival % 2 = 0 UNION ALL SELECT 'first', 1, count(*) FROM te WHERE arrival % 2 = 1
  UNION ALL SELECT 'again', 0, 0 UNION ALL SELECT 'stored', 1, count(*) FROM te"""))
def a43_replayed_batches(spark, d):
    """A stream into the store, and the same query again after its checkpoint was lost: what each batch changed."""
    store, told, again = fresh_store(spark), [], []
    table, folder = testbed.trace_events(spark, d), f"{store.path}/_in/events"
    _streamed(spark, store, "events", table, folder, f"{store.path}/_in/console-1", 2, told)
    stream = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(folder)
    sink = store.sink(query="console/events", kind="events", done=lambda batch, changed: again.append((batch, changed)))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{store.path}/_in/console-2").trigger(availableNow=True).start().awaitTermination()
    rows = [("first", *x) for x in told] + [("again", *x) for x in again] + [("stored", store.tokens()["console/events"], store.events.count())]
    return spark.createDataFrame(rows, "run string, batch bigint, changed bigint")


@query(of(EVENTS, "SELECT count(*) AS changed, count(*) AS written, true AS kept FROM te WHERE arrival % 1000 = 7"))
def a44_small_batch(spark, d):
    """A small batch after a large one: the rows that its segments hold, and whether those of the large one still stand."""
    store, e = fresh_store(spark), testbed.trace_events(spark, d)
    store.write(events=e)
    before = store.segments.current().of("events")
    changed = store.write(events=e.filter("arrival % 1000 = 7").withColumn("attributes", F.create_map(F.lit("late"), F.lit("yes"))))
    after = store.segments.current().of("events")
    kept = all(after[b][: len(held)] == held for b, held in before.items())
    new = {s[0] for held in after.values() for s in held} - {s[0] for held in before.values() for s in held}
    written = spark.read.parquet(*(f"{store.path}/events/{n}" for n in new)).count() if new else 0
    return spark.createDataFrame([(changed, written, kept)], "changed bigint, written bigint, kept boolean")


@query(of(STEPPED, """, sn AS (SELECT entity_key, seq, t AS snapshot_at_ms, 'r-' || event_id AS request_id, CAST(k AS BIGINT) AS memory_entries, event_id FROM st WHERE step = 4 AND seq % 10 = 0)
  SELECT entity_key, seq, snapshot_at_ms, request_id, CASE WHEN event_id % 2 = 0 THEN memory_entries + 1 ELSE memory_entries END AS memory_entries, 'raw' AS raw FROM sn"""))
def a37_snapshot_merge(spark, d):
    """Snapshots with later copies that say more entries and carry no image: values change, the image stays."""
    s = testbed.snapshots(spark, d).withColumn("raw", F.lit("raw"))
    late = s.filter("arrival % 2 = 0").withColumns({"memory_entries": F.col("memory_entries") + 1, "raw": F.lit(""), "arrival": F.col("arrival") + 1000000000})
    return merge.merge_snapshots(s.unionByName(late)).select("entity_key", "seq", "snapshot_at_ms", "request_id", "memory_entries", "raw")


_ONE = "(SELECT entity_key, seq FROM te WHERE event_type = 'ERROR' ORDER BY start_ms DESC, entity_key, seq LIMIT 1)"


def _detailed(spark: SparkSession, d: str) -> tuple:
    s = testbed.store(spark, d)
    r = s.events.filter("event_type = 'ERROR'").orderBy(F.col("start_ms").desc(), "entity_key", "seq").select("entity_key", "seq", "trace_id").first()
    return s, rollups.activations(s.events, s.errors), r


@query(of(BOTH, f""", o AS {_ONE}
  SELECT 'event' AS part, te.event_type AS name, te.start_ms AS at_ms FROM te JOIN o USING (entity_key, seq) UNION ALL SELECT 'error', reason, event_time_ms FROM ue JOIN o USING (entity_key, seq)
  UNION ALL SELECT 'intent', coalesce(a_tool, ''), start_ms FROM te JOIN o USING (entity_key, seq) WHERE event_type = 'INTENT_EMITTED' UNION ALL SELECT 'summary', status, started_ms FROM acts JOIN o USING (entity_key, seq)
  UNION ALL SELECT 'snapshot', CAST(seq AS VARCHAR), snapshot_at_ms FROM sn JOIN o USING (entity_key, seq)"""))
def a38_activation_detail(spark, d):
    """The parts of one activation's page: the one that failed last."""
    s, acts, r = _detailed(spark, d)
    if r is None:
        return spark.createDataFrame([], "part string, name string, at_ms bigint")
    p = console.activation_detail(s, acts, r["entity_key"], r["seq"])
    pick = lambda part, name, at: p[part].select(F.lit(part.removesuffix("s") if part in ("events", "errors", "intents") else part).alias("part"), F.col(name).cast("string").alias("name"), F.col(at).alias("at_ms"))
    out = pick("events", "event_type", "start_ms").unionByName(pick("errors", "reason", "event_time_ms")).unionByName(pick("intents", "tool_name", "emitted_at_ms"))
    return out.unionByName(pick("summary", "status", "started_ms")).unionByName(pick("snapshot", "seq", "snapshot_at_ms"))


@query(of(ACTS, f""", o AS {_ONE}, t AS (SELECT DISTINCT te.trace_id FROM te JOIN o USING (entity_key, seq))
  SELECT 'summary' AS part, trace_id AS name, count(*) AS n FROM acts JOIN t USING (trace_id) GROUP BY 2 UNION ALL SELECT 'span', span_id, 1 FROM te JOIN t USING (trace_id) GROUP BY span_id
  UNION ALL SELECT 'attempt', span_id, 1 FROM te JOIN t USING (trace_id) WHERE event_type IN ('ACTIVATION_START', 'ACTIVATION_END') GROUP BY span_id"""))
def a39_trace_detail(spark, d):
    s, acts, r = _detailed(spark, d)
    if r is None:
        return spark.createDataFrame([], "part string, name string, n bigint")
    p = console.trace_detail(s, acts, r["trace_id"])
    one = lambda df, part, name: df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return one(p["summary"], "summary", "trace_id").unionByName(one(p["spans"], "span", "span_id")).unionByName(one(p["attempts"], "attempt", "span_id"))


_SERIES = f""", w AS (SELECT newest - {WEEK} AS f, newest AS l, CAST(ceil({WEEK} / 48) AS BIGINT) AS size FROM ex), fr AS (SELECT unnest(range(f // size * size, l // size * size + 1, size)) AS bucket_ms FROM w)"""


def _overview(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s = testbed.store(spark, d)
    return console.overview(s, rollups.activations(s.events, s.errors), WEEK)


@query(of(BOTH, EXTENT + _SERIES + """,
  a AS (SELECT started_ms // size * size AS bucket_ms, count(*) AS v FROM acts, w WHERE started_ms >= f GROUP BY 1), e AS (SELECT event_time_ms // size * size AS bucket_ms, count(*) AS v FROM ue, w WHERE event_time_ms >= f GROUP BY 1)
  SELECT 'activations' AS series, bucket_ms, CAST(coalesce(v, 0) AS DOUBLE) AS value FROM fr LEFT JOIN a USING (bucket_ms) UNION ALL SELECT 'errors', bucket_ms, CAST(coalesce(v, 0) AS DOUBLE) FROM fr LEFT JOIN e USING (bucket_ms)"""))
def a40_overview_series(spark, d):
    o = _overview(spark, d)
    part = lambda name: o[f"{name}_series"].select(F.lit(f"{name}s").alias("series"), "bucket_ms", "value")
    return part("activation").unionByName(part("error"))


@query(of(BOTH, EXTENT + f""", w AS (SELECT newest - {WEEK} AS f FROM ex),
  m AS (SELECT a_model AS name, count(*) AS n FROM te, w WHERE event_type = 'LLM_CALL' AND start_ms >= f GROUP BY 1 ORDER BY n DESC, name LIMIT 5),
  t AS (SELECT a_tool AS name, count(*) FILTER (event_type = 'TOOL_CALL') AS n, count(*) FILTER (event_type = 'INTENT_EMITTED') AS i FROM te, w WHERE a_tool IS NOT NULL AND start_ms >= f GROUP BY 1 ORDER BY n DESC, i DESC, name LIMIT 5),
  r AS (SELECT reason AS name, event_time_ms AS n FROM ue, w WHERE event_time_ms >= f ORDER BY event_time_ms DESC, entity_key DESC, seq_key DESC, reason DESC LIMIT 5)
  SELECT 'model' AS part, name, n FROM m UNION ALL SELECT 'tool', name, n FROM t UNION ALL SELECT 'error', name, n FROM r"""))
def a41_overview_lists(spark, d):
    o = _overview(spark, d)
    part = lambda key, kind, name, n: o[key].select(F.lit(kind).alias("part"), F.col(name).alias("name"), F.col(n).alias("n"))
    recent = part("recent_errors", "error", "reason", "event_time_ms").limit(5)
    return part("top_models", "model", "model", "calls").unionByName(part("top_tools", "tool", "tool_name", "calls")).unionByName(recent)


@query(of(STEPPED, """, r AS (SELECT entity_key, row_number() OVER (PARTITION BY entity_key ORDER BY t, event_id) - 1 AS seq FROM st)
  SELECT entity_key, seq, CASE WHEN seq % 17 = 3 THEN 'diverged' ELSE 'reproduced' END AS verdict, CASE WHEN seq % 17 = 3 THEN 'trace_event' END AS kind FROM r"""))
def b13_replay_run(spark, d):
    """Every activation of the waiting agent replayed from an export before it, against a trace that is wrong in places."""
    from ..streaming import replay

    e = testbed.envelopes(spark, d).select("entity_key", "event_time_ms", "arrival", "kind", "external_event")

    def again(batches):
        import pyarrow as pa

        from ..streaming import kernel

        config, key, state = Config(agent=agents.buyer, ttl_ms=10**13), None, kernel.KeyState()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["entity_key"] != key:
                    key, state = r["entity_key"], kernel.KeyState()
                before = kernel.snapshot(state, r["event_time_ms"], "replay") | {"entity_key": key}
                seq = state.seq
                traced = [t for t in kernel.on_envelope(config, key, state, r, 0) if t["stream"] == "traces"]
                if seq % 17 == 3:
                    traced[1] = traced[1] | {"attributes": traced[1]["attributes"] | {"tool_name": "other"}}
                    traced[2] = traced[2] | {"step_index": 99}
                bundle = replay.build(before, traced, r, seq)
                found = [x for x in replay.compare(bundle, replay.run(bundle, config)) if x[0] != "intent"]
                rows.append((key, seq, "diverged" if found else "reproduced", found[0][0] if found else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["entity_key", "seq", "verdict", "kind"])

    return fold.in_order(e).mapInArrow(again, "entity_key string, seq bigint, verdict string, kind string")


_INTENTS = "SELECT entity_key, seq, row_number() OVER (PARTITION BY entity_key, seq ORDER BY arrival) - 1 AS position, a_intent AS intent_id, a_tool AS tool_name, a_intent_kind AS kind, a_expires AS expires_at_ms, arrival FROM te WHERE event_type = 'INTENT_EMITTED'"


@query(of(EVENTS, f""", l AS ({_INTENTS}), r AS (SELECT * REPLACE (CASE WHEN arrival % 5 = 0 THEN 'other' ELSE tool_name END AS tool_name, CASE WHEN arrival % 7 = 0 THEN expires_at_ms + 1 ELSE expires_at_ms END AS expires_at_ms) FROM l WHERE NOT (arrival % 11 = 0 AND position > 0)),
  n AS (SELECT entity_key, seq, (SELECT count(*) FROM l x WHERE x.entity_key = k.entity_key AND x.seq = k.seq) AS a, (SELECT count(*) FROM r x WHERE x.entity_key = k.entity_key AND x.seq = k.seq) AS b FROM (SELECT DISTINCT entity_key, seq FROM l) k)
  SELECT entity_key, seq, CAST(-1 AS BIGINT) AS position, 'count' AS what FROM n WHERE a <> b
  UNION ALL SELECT entity_key, seq, position, CASE WHEN l.intent_id <> r.intent_id THEN 'intent_id' WHEN l.tool_name <> r.tool_name THEN 'tool_name' WHEN l.kind <> r.kind THEN 'kind' ELSE 'expires_at_ms' END
  FROM l JOIN r USING (entity_key, seq, position) JOIN n USING (entity_key, seq) WHERE a = b AND (l.intent_id <> r.intent_id OR l.tool_name <> r.tool_name OR l.kind <> r.kind OR l.expires_at_ms <> r.expires_at_ms)"""))
def b14_intent_diff(spark, d):
    """Traced intents against replayed ones, by place: another count, else the fields that differ."""
    from pyspark.sql.window import Window

    from ..operators import longterm

    w = Window.partitionBy("entity_key", "seq").orderBy("arrival")
    i = testbed.trace_events(spark, d).filter("event_type = 'INTENT_EMITTED'").select(
        "entity_key", "seq", (F.row_number().over(w) - 1).cast("bigint").alias("position"), attribute("intent_id").alias("intent_id"), attribute("tool_name").alias("tool_name"),
        attribute("intent_kind").alias("kind"), attribute("expires_at_ms").cast("bigint").alias("expires_at_ms"), "arrival",
    )
    again = i.filter(~((F.col("arrival") % 11 == 0) & (F.col("position") > 0)))
    again = again.withColumns({"tool_name": F.when(F.col("arrival") % 5 == 0, "other").otherwise(F.col("tool_name")), "expires_at_ms": F.when(F.col("arrival") % 7 == 0, F.col("expires_at_ms") + 1).otherwise(F.col("expires_at_ms"))})
    return longterm.intent_diff(i, again)


@query(of(EVENTS, """, i AS (SELECT a_intent AS intent_id, a_intent_kind AS kind, a_tool AS tool_name, a_expires AS expires_at_ms FROM te WHERE event_type = 'INTENT_EMITTED'), n AS (SELECT max(start_ms) - 86400000 AS now FROM te)
  SELECT intent_id, CASE WHEN now >= expires_at_ms THEN 'EXPIRED' WHEN tool_name = 'tool-1' THEN 'OK' WHEN tool_name IN ('tool-2', 'tool-3') THEN 'ERROR' ELSE 'REJECTED' END AS status,
    CASE WHEN now < expires_at_ms AND tool_name = 'tool-1' THEN '"done"' END AS payload FROM i, n WHERE kind <> 'APPROVAL'"""))
def b15_effect_results(spark, d):
    """Tool intents executed: one tool works, one fails, one gives what cannot be encoded, the rest are unknown."""
    intents, now = _intents(spark, d)
    executor = effects.Executor(scripted_tools(), _leases(spark), clock=lambda: now)
    return effects.execute(intents.unionByName(intents.filter("tool_name = 'tool-1'")), executor).select("intent_id", "status", "payload")


def _leases(spark: SparkSession) -> str:
    return f"{staging.shared_dir(spark)}/keyloom/leases-{uuid.uuid4().hex}"


def _intents(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Intents of the traces, and a time a day before the last event."""
    e = testbed.trace_events(spark, d)
    now = (e.agg(F.max("start_ms")).first()[0] or 0) - DAY
    return console.intents(e).select("intent_id", "entity_key", "seq", "step_index", "tool_name", F.col("intent_kind").alias("kind"), F.lit("{}").alias("args_json"), "expires_at_ms"), now


def scripted_tools() -> dict:
    def fails():
        raise ValueError("no")

    registry = tools.Registry()
    registry.tool(lambda: "done", name="tool-1", side_effect=True)
    registry.tool(fails, name="tool-2", side_effect=True)
    registry.tool(lambda: float("nan"), name="tool-3", side_effect=True)
    return dict(registry)


@query(of(EVENTS, """, i AS (SELECT a_intent AS intent_id, a_expires AS expires_at_ms FROM te WHERE event_type = 'INTENT_EMITTED' AND a_intent_kind <> 'APPROVAL'), n AS (SELECT max(start_ms) - 86400000 AS now FROM te)
  SELECT intent_id, CAST(CASE WHEN now >= expires_at_ms THEN 0 ELSE 1 END AS BIGINT) AS grants, CAST(2 AS BIGINT) AS results, true AS alike FROM i, n"""))
def b16_effects_run_once(spark, d):
    """Executed twice, each result read twice: how often each intent's lease was granted, and whether the results are alike. An
    expired intent asks for no lease."""
    intents, now = _intents(spark, d)
    leases = _leases(spark)
    runs = [effects.execute(intents, effects.Executor(scripted_tools(), leases, clock=lambda: now)) for _ in range(2)]
    for r in runs:
        r.count()
    both = runs[0].unionByName(runs[1]).groupBy("intent_id").agg(F.count("*").alias("results"), (F.countDistinct("status", F.coalesce("payload", F.lit("")), F.coalesce("error_message", F.lit(""))) == 1).alias("alike"))
    return both.join(effects.grants(intents, leases), "intent_id").select("intent_id", "grants", "results", "alike")


@query(of(EVENTS, """, i AS (SELECT a_intent AS intent_id, a_intent_kind AS kind, a_tool AS tool_name, a_expires AS expires_at_ms FROM te WHERE event_type = 'INTENT_EMITTED'), n AS (SELECT max(start_ms) - 86400000 AS now FROM te)
  SELECT intent_id, CASE WHEN now >= expires_at_ms THEN 'result' WHEN kind = 'APPROVAL' THEN 'approval' ELSE 'result' END AS kind,
    CASE WHEN now >= expires_at_ms THEN 'EXPIRED' WHEN kind = 'APPROVAL' THEN NULL WHEN tool_name = 'tool-1' THEN 'OK' WHEN tool_name IN ('tool-2', 'tool-3') THEN 'ERROR' ELSE 'REJECTED' END AS status FROM i, n"""))
def b17_streamed_effects(spark, d):
    """The intents as a stream through the stateful worker: tools and approvals in the order of each key."""
    from ..streaming import effector

    intents, now = _intents(spark, d)
    top = f"{staging.shared_dir(spark)}/keyloom/effects-{uuid.uuid4().hex}"
    intents.write.parquet(f"{top}/in")
    stream = spark.readStream.schema(intents.schema).parquet(f"{top}/in")
    executor = effects.Executor(scripted_tools(), f"{top}/leases", clock=lambda: now)
    out = effector.run_effects_stream(stream, executor)
    with rocksdb(spark):
        out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(once=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out").select("intent_id", "kind", "status")


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keyed operators need, for the queries that run inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query(of(EVENTS, """SELECT a_intent AS intent_id, CASE WHEN a_tool = 'tool-3' THEN 'dead_letter' ELSE 'sent' END AS kind, CASE WHEN a_tool = 'tool-3' THEN 'not for this channel' END AS error_message FROM te WHERE event_type = 'INTENT_EMITTED'"""))
def b18_ordered_outbox(spark, d):
    """The intents published from a queue for each key; the channel refuses one tool for good."""
    from ..streaming import outbox

    def connect():
        def send(key: bytes, value: bytes) -> None:
            if json.loads(value)["tool_name"] == "tool-3":
                raise outbox.Unsendable("not for this channel")

        return send

    intents, _ = _intents(spark, d)
    top = f"{staging.shared_dir(spark)}/keyloom/outbox-{uuid.uuid4().hex}"
    intents.withColumn("created_at_ms", F.col("expires_at_ms") - 3600000).write.parquet(f"{top}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{top}/in").schema).parquet(f"{top}/in")
    out = outbox.publish_stream(stream, outbox.Publisher(connect))
    with rocksdb(spark):
        out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(once=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out").select("intent_id", "kind", "error_message")


_DELAY = 24 * 3600_000


@query(of(EVENTS, f""", m AS (SELECT max(start_ms) - {_DELAY} AS mark FROM te WHERE arrival % 2 = 0)
  SELECT CASE WHEN arrival % 2 = 1 AND start_ms < mark THEN 'late' WHEN event_type = 'ERROR' THEN 'errors' ELSE 'events' END AS tag, count(*) AS n, count(DISTINCT trace_id || span_id || event_type) AS distinct_rows FROM te, m GROUP BY 1"""))
def e05_tagged_outputs(spark, d):
    """Trace events as a stream of two batches, dealt by kind, with those behind the watermark in an output of their own."""
    from ..streaming import partition

    e = testbed.trace_events(spark, d)
    top = f"{staging.shared_dir(spark)}/keyloom/tagged-{uuid.uuid4().hex}"
    policy = F.when(F.col("event_type") == "ERROR", "errors").otherwise("events")
    with rocksdb(spark):
        for part in range(2):
            e.filter(F.col("arrival") % 2 == part).write.parquet(f"{top}/in/part={part}")
            stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{top}/in")
            out = partition.tagged(stream, policy, key="entity_key", time_ms="start_ms", delay=f"{_DELAY} milliseconds")
            store = partition.deal({t: (lambda df, n, t=t: df.write.mode("overwrite").parquet(f"{top}/out/tag={t}/batch={n}")) for t in ("late", "errors", "events")})
            out.writeStream.foreachBatch(store).option("checkpointLocation", f"{top}/checkpoint").trigger(once=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in e.schema.fields)}, tag string, batch bigint").parquet(f"{top}/out")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("trace_id", "span_id", "event_type").alias("distinct_rows"))


@query(of(STEPPED, """SELECT entity_key, count(*) AS outputs, max(n) AS n, CAST(max(s) AS BIGINT) AS sum, CAST(1 AS BIGINT) AS lost FROM (SELECT entity_key, count(*) OVER w AS n, sum(k) OVER w AS s FROM st WINDOW w AS (PARTITION BY entity_key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1"""))
def d13_restarted_stream(spark, d):
    """The streaming operator over the whole table, lost once with its state written, and started again from its checkpoint."""
    from pyspark.errors import StreamingQueryException

    from ..streaming import chaos, processor

    top = f"{staging.shared_dir(spark)}/keyloom/restarted-{uuid.uuid4().hex}"
    e = testbed.envelopes(spark, d).select("entity_key", "event_time_ms", "arrival", "kind", "external_event")
    e.write.parquet(f"{top}/in")
    config = Config(agent=agents.counter, ttl_ms=10**13)
    operator = chaos.FaultyProcessor(config, staging.mounted(top), lambda rows: len(rows) > 0, streams=("output",))
    out = processor.run_agent_stream(spark.readStream.schema(e.schema).parquet(f"{top}/in"), config, operator=operator)
    with rocksdb(spark):
        for _ in range(3):
            try:
                out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(once=True).start().awaitTermination()
                break
            except StreamingQueryException:  # on a cluster only the task fails, and is tried again
                continue
    lost = int(os.path.exists(f"{staging.mounted(top)}/lost"))
    rows = spark.read.schema(out.schema).parquet(f"{top}/out").filter("stream = 'output'")
    return rows.groupBy("entity_key").agg(F.count("*").alias("outputs"), F.max(F.get_json_object("payload", "$.n").cast("bigint")).alias("n"), F.max(F.get_json_object("payload", "$.sum").cast("bigint")).alias("sum"), F.lit(lost).cast("bigint").alias("lost"))


@query(of(EVENTS, """
  SELECT trace_id, span_id, event_type, start_ms, 'bundle' AS provenance FROM te"""))
def e02_frames_in_splits(spark, d):
    """Trace events written as captured files of frames and read back in splits of a few kilobytes."""
    from ..sources import frames, ingest

    top = f"{staging.shared_dir(spark)}/keyloom/capture-{uuid.uuid4().hex}"
    e = testbed.trace_events(spark, d)
    frames.write_frames(e.select(F.to_json(F.struct(*e.columns)).cast("binary").alias("body")), top)
    good, _ = ingest.read_capture(spark, top, "traces", split_bytes=1 << 16)
    return good.select("trace_id", "span_id", "event_type", "start_ms", "provenance")


@query(of(EVENTS, """, m AS (SELECT max(start_ms) + 1 AS stop, min(start_ms) AS start FROM te), h AS (SELECT (start + stop) // 2 AS half, stop FROM m)
  SELECT CAST(0 AS BIGINT) AS batch, count(*) AS read, count(*) AS changed, CAST(0 AS BIGINT) AS problems FROM te, h WHERE start_ms < half
  UNION ALL SELECT 1, count(*), count(*) FILTER (start_ms >= half), 0 FROM te, h WHERE start_ms >= half - 86400000"""))
def e03_windowed_pull(spark, d):
    """Warehouse rows pulled window by window into the store: what each pull read, and what of it was new."""
    from ..sources import ingest, warehouse

    top = f"{staging.shared_dir(spark)}/keyloom/warehouse-{uuid.uuid4().hex}"
    e = testbed.trace_events(spark, d)
    ingest.warehouse_rows(e).write.partitionBy("event_date").parquet(f"{top}/table")
    low, high = e.agg(F.min("start_ms"), F.max("start_ms")).first()
    store, told, sizes = fresh_store(spark), [], []
    sink = store.sink(query="pull", kind="events", done=lambda batch, changed: told.append(changed))

    def into(batch: DataFrame, number: int) -> None:
        good, bad = warehouse.split(batch.persist())
        sizes.append((good.count(), bad.count()))
        sink(good, number)
        batch.unpersist()

    spark.dataSource.register(warehouse.WindowedTraces)
    for until in ((low + high + 1) // 2, high + 1) if low is not None else ():
        source = spark.readStream.format("trace-windows").options(path=f"{top}/table", until=str(until), lookbackMs=str(until), overlapMs=str(DAY)).load()
        source.writeStream.foreachBatch(into).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = [(k, good, changed, bad) for k, ((good, bad), changed) in enumerate(zip(sizes, told, strict=True))]
    return spark.createDataFrame(rows, "batch bigint, read bigint, changed bigint, problems bigint")


@query(of(EVENTS, "SELECT count(*) AS exported, CAST(0 AS BIGINT) AS dropped, count(*) AS received FROM te WHERE event_type <> 'ACTIVATION_START'"))
def e04_exported_spans(spark, d):
    """Spans through the exporter to a collector of this process, and what its tasks count."""
    import http.server
    import threading

    from ..streaming import exporter

    received = Counter()

    class Collector(http.server.BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            found = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            received["spans"] += sum(len(x["spans"]) for r in found["resourceSpans"] for x in r["scopeSpans"])
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_) -> None:
            pass

    server = http.server.ThreadingHTTPServer((spark.conf.get("spark.driver.host"), 0), Collector)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    report = staging.mounted(f"{staging.shared_dir(spark)}/keyloom/report-{uuid.uuid4().hex}")
    try:
        spark.dataSource.register(exporter.SpanExport)
        url = f"http://{server.server_address[0]}:{server.server_port}/v1/traces"
        exporter.spans(testbed.trace_events(spark, d)).write.format("otlp").mode("append").options(url=url, report=report, queue="100000", deadline="60").save()
    finally:
        server.shutdown()
    got = exporter.counts(report)["batch"]
    return spark.createDataFrame([(got.exported, got.dropped, received["spans"])], "exported bigint, dropped bigint, received bigint")


def scripted_judge():
    """A judge whose answers follow from the outcome: F is good, P cannot be reached, O answers out of range."""

    def call(request: dict) -> Response:
        label = request["messages"][-1]["content"].split("outcome: ")[1].split("\n")[0]
        if label == "P":
            raise ProviderError("busy")
        return Response(json.dumps({"score": 5 if label == "F" else 9, "rationale": label}))

    return call


_SCORED = JOINED + ", sc AS (SELECT entity_key, seq, scenario, label, event_time_ms, CASE WHEN label = 'F' THEN 5 END AS score, CASE label WHEN 'F' THEN NULL WHEN 'P' THEN 'ProviderError' ELSE 'invalid_verdict' END AS judge_error FROM vv WHERE verdict = 'joined')"


def scored(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d).filter("verdict = 'joined'").select("entity_key", "seq", "scenario", "label", "event_time_ms")
    none = F.lit(None).cast("bigint")
    return evaluation.judged(j.withColumns({"activation_status": F.lit("completed"), "input_tokens": none, "output_tokens": none}), scripted_judge, "judge-1")


@query(of(EVENTS, _SCORED + " SELECT entity_key, seq, label, CAST(score AS BIGINT) AS score, judge_error, CASE WHEN score IS NULL THEN 'judge_error' ELSE 'verdict' END AS kind FROM sc"))
def c08_judge(spark, d):
    return scored(spark, d).select("entity_key", "seq", "label", "score", "judge_error", "kind")


@query(of(EVENTS, _SCORED + """, no AS (SELECT end_ms AS event_time_ms FROM tt WHERE NOT EXISTS (SELECT 1 FROM vv WHERE verdict = 'joined' AND vv.entity_key = tt.entity_key AND vv.seq = tt.seq)),
  al AS (SELECT event_time_ms, scenario, score, judge_error, false AS none FROM sc UNION ALL SELECT event_time_ms, '', NULL, NULL, true FROM no)
  SELECT event_time_ms // 3600000 * 3600000 AS window_ms, scenario, 'v1' AS judge_prompt_version, count(score) AS judged, CASE WHEN count(score) > 0 THEN sum(score) / count(score) END AS mean_score, count(*) FILTER (none) AS no_outcome, count(judge_error) AS judge_errors FROM al GROUP BY 1, 2"""))
def c09_quality_windows(spark, d):
    """Hourly quality by scenario and prompt version, with activations that nobody judged."""
    none = judged(spark, d).filter("verdict = 'no_outcome'").select(F.col("end_ms").alias("event_time_ms"), F.lit("no_outcome").alias("kind"), F.lit("v1").alias("judge_prompt_version"))
    return evaluation.quality(scored(spark, d).unionByName(none, allowMissingColumns=True))


@query(of(STEPPED, """, n AS (SELECT entity_key, count(*) AS n FROM st GROUP BY 1), m AS (SELECT unnest(['activations', 'suspensions', 'intents_emitted']) AS name)
  SELECT entity_key, name, n AS value FROM n, m"""))
def d06_metric_counters(spark, d):
    """Counters of the waiting agent by key: each event is one activation, one suspension and one intent."""
    rows = fold.run_agent(testbed.envelopes(spark, d), Config(agent=agents.buyer, ttl_ms=10**13, metrics=True), streams=("metrics",))
    return metrics.counters(rows, "entity_key")


def mixed(ctx: Context) -> Complete:
    """Fails on some numbers, calls the model and a tool on the others."""
    k = int(json.loads(ctx.event)["k"])
    if k % 3 == 0:
        raise ValueError(k)
    if k % 3 == 1:
        ctx.call_model("m", [{"role": "user", "content": str(k)}])
    ctx.run_tool("look", n=k)
    return Complete(str(k))


@query(of(STEPPED, """, x AS (SELECT count(*) FILTER (k % 3 <> 0) AS ok, count(*) FILTER (k % 3 = 0) AS bad, count(*) FILTER (k % 3 = 1) AS called FROM st)
  SELECT 'activations' AS name, ok AS metric, ok AS records FROM x UNION ALL SELECT 'agent_errors', bad, bad FROM x UNION ALL SELECT 'llm_calls', called, called FROM x UNION ALL SELECT 'tool_calls', ok, ok FROM x"""))
def d07_metric_identities(spark, d):
    """Counters beside the numbers of records they stand for: both columns say the same."""
    c = Config(agent=mixed, ttl_ms=10**13, metrics=True, provider=lambda r: Response("x", 1, 1), tools={"look": lambda n: n})
    rows = fold.run_agent(testbed.envelopes(spark, d), c, streams=("errors", "traces", "metrics"))
    t = F.col("event_type")
    kind = F.when(F.col("stream") == "errors", "agent_errors").when(t == "ACTIVATION_END", "activations").when(t == "LLM_CALL", "llm_calls").when(t == "TOOL_CALL", "tool_calls")
    # one pass over the fold: a record counts under its kind, a metrics record under the counters in it
    one = F.array(F.struct(kind.alias("name"), F.lit(None).cast("bigint").alias("metric"), F.lit(1).cast("bigint").alias("records")))
    said = F.transform(F.map_entries(metrics.moved(F.col("body"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("metric"), F.lit(None).cast("bigint").alias("records")))
    each = rows.select(F.explode(F.when(F.col("stream") == "metrics", said).otherwise(one)).alias("r")).select("r.*")
    return each.groupBy("name").agg(F.sum("metric").alias("metric"), F.sum("records").alias("records")).filter("name is not null and records > 0")


def hangs(ctx: Context) -> Complete:
    """Never ends on the first event of a key, but stops when asked to."""
    if ctx.seq == 0 and not ctx.memory.items and json.loads(ctx.event)["k"] % 10 == 0:
        ctx.cancelled.wait(60)
    ctx.memory.set("seen", b"1")
    return Complete("ok")


@query(of(STEPPED, """, f AS (SELECT entity_key, k, row_number() OVER (PARTITION BY entity_key ORDER BY t, event_id) AS r FROM st), g AS (SELECT entity_key, k % 10 = 0 AS hung, r, min(r) FILTER (k % 10 <> 0) OVER (PARTITION BY entity_key) AS first_ok FROM f)
  SELECT entity_key, count(*) FILTER (hung AND (first_ok IS NULL OR r < first_ok)) AS timeouts, count(*) FILTER (NOT (hung AND (first_ok IS NULL OR r < first_ok))) AS outputs FROM g GROUP BY 1"""))
def d08_activation_timeouts(spark, d):
    """Agents that hang are stopped at their time limit: one error each, and the key goes on."""
    rows = fold.run_agent(testbed.envelopes(spark, d), Config(agent=hangs, ttl_ms=10**13, timeout_ms=400, cancel_grace_ms=2000), streams=("errors", "output"), overlap=32)
    return rows.groupBy("entity_key").agg(F.count_if(F.col("reason") == "activation_timeout").alias("timeouts"), F.count_if(F.col("stream") == "output").alias("outputs"))
