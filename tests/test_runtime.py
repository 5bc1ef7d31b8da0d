"""Store, replay, evaluation, effects, sinks and decoders beside the queries of the catalog."""

import dataclasses
import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from keyloom import schemas
from keyloom.functions import ids
from keyloom.operators import effects
from keyloom.operators.store import RecordStore
from keyloom.sources import ingest
from keyloom.streaming import agents, chaos, evaluation, fold, kernel, metrics, replay, sinks, tools
from keyloom.streaming.kernel import Complete, Config, KeyState, Suspend
from keyloom.streaming.model import ProviderError, Response

T0 = 1_700_000_000_000


def ev(t, payload="x", key="6b"):
    return {"entity_key": key, "event_time_ms": T0 + t, "arrival": t, "kind": "external_event", "external_event": payload}


def trace(i, **kw):
    return {"trace_id": "t", "span_id": f"s{i}", "parent_span_id": "", "entity_key": "6b", "seq": 1, "step_index": 0, "event_type": "LLM_CALL", "start_ms": T0 + i, "end_ms": T0 + i, "attributes": {"model": "m"}, "provenance": "native", "arrival": i} | kw


def frame_of(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schemas.TRACE_EVENT.replace("map<string, string>", "map").split(", ")) for r in rows], schemas.TRACE_EVENT)


def test_store_counts_changes_and_keeps_versions(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/store", buckets=4)
    tid = spark.range(1).select(ids.trace_id(F.lit("6b"), F.lit(1))).first()[0]
    one = frame_of(spark, [trace(1, trace_id=tid, event_type="ACTIVATION_START"), trace(2, trace_id=tid)])
    assert store.write(events=one) == 2 and store.write(events=one) == 0
    old = store.events  # a reader of the version before
    assert store.write(events=frame_of(spark, [trace(2, trace_id=tid, attributes={"model": "n"})])) == 1
    assert {r["attributes"].get("model") for r in old.collect()} == {"m"} and {r["attributes"].get("model") for r in store.events.collect()} == {"m", "n"}
    error = spark.createDataFrame([("e1", "6b", 1, "activation_error", "d", T0 + 9, "native", 1)], schemas.ERROR_RECORD)
    assert store.write(errors=error) == 1
    act = store.table("activations").collect()
    assert [(a["entity_key"], a["seq"], a["status"], a["errors"], a["model"]) for a in act] == [("6b", 1, "error", 1, "n")]
    assert [(e["entity_key"], e["activations"], e["errors"]) for e in store.table("entities").collect()] == [("6b", 1, 1)]
    assert store.prune(T0 + 100, 95) == 2 and store.events.count() == 0 and store.errors.count() == 1
    assert store.table("traces").count() == 0 and store.table("activations").first()["llm_calls"] == 0
    assert store.prune(T0 + 100, 95) == 0
    store.vacuum()
    assert store.errors.count() == 1 and RecordStore(spark, f"file://{tmp_path}/store", buckets=4).errors.count() == 1


def asks(ctx):
    if ctx.is_resume:
        return Complete(ctx.call_model("m", [{"role": "user", "content": "again"}]))
    said = ctx.call_model("m", [{"role": "user", "content": ctx.event}])
    ctx.memory.set("said", said.encode())
    ctx.act("pay", {"n": 1})
    return Suspend("snap") if ctx.event == "wait" else Complete(said)


CONFIG = Config(agent=asks, provider=lambda r: Response("yes", 1, 2))


def recorded(payload="go"):
    """An export taken after the activation (with its cache), its trace and its envelope."""
    state, e = KeyState(), ev(0, payload)
    rows = kernel.on_envelope(CONFIG, "6b", state, e, 0)
    traced = [r | {"entity_key": "6b"} for r in rows if r["stream"] == "traces"]
    return kernel.snapshot(state, T0, "r") | {"entity_key": "6b"}, traced, e, state


def test_replay_reproduces_diverges_and_refuses(tmp_path, capsys):
    snap, traced, e, _ = recorded()
    bundle = replay.build(snap, traced, e, 0)
    outcome = replay.run(bundle, CONFIG)
    assert outcome["status"] == "completed" and replay.compare(bundle, outcome) == []
    assert [t["attributes"]["cache_hit"] for t in outcome["traces"] if t["event_type"] == "LLM_CALL"] == ["true"]

    def other(ctx):
        ctx.call_model("m", [{"role": "user", "content": ctx.event}])
        ctx.act("refund", {"n": 1})
        return Complete("x")

    found = replay.compare(bundle, replay.run(bundle, dataclasses.replace(CONFIG, agent=other)))
    assert [k for k, _ in found] == ["trace_event", "intent"] and "tool_name: traced 'pay', replayed 'refund'" in found[1][1]
    with pytest.raises(replay.Irreproducible):
        replay.run(bundle, dataclasses.replace(CONFIG, agent=lambda ctx: Complete(ctx.call_model("m", [{"role": "user", "content": "new"}]))))
    failed = replay.run(bundle, Config(agent=agents.failing))
    assert failed["status"] == "failed" and "status" in [k for k, _ in replay.compare(bundle, failed)]
    for bad in (dict(envelope=e | {"entity_key": "00"}), dict(traces=[]), dict(seq=7), dict(envelope={"entity_key": "6b", "kind": "approval", "approval": {"intent_id": "?"}})):
        with pytest.raises(replay.ReplayUsage):
            replay.build(**({"snapshot": snap, "traces": traced, "envelope": e, "seq": 0} | bad))
    paths = {n: tmp_path / n for n in ("snapshot", "traces", "envelope")}
    paths["snapshot"].write_text(json.dumps(snap))
    paths["traces"].write_text("\n".join(json.dumps(t) for t in traced))
    paths["envelope"].write_text(json.dumps(e))
    args = [x for n, p in paths.items() for x in (f"--{n}", str(p))]
    assert replay.main([*args, "--agent", f"{__name__}:CONFIG"]) == replay.REPRODUCED and "reproduced" in capsys.readouterr().out
    assert replay.main([*args, "--agent", "keyloom.streaming.agents:failing"]) == replay.DIVERGED
    assert replay.main([*args, "--agent", f"{__name__}:never_cached"]) == replay.IRREPRODUCIBLE
    assert replay.main([*args, "--agent", "no.such:thing"]) == replay.USAGE == replay.main(["--seq", "x"])


def never_cached(ctx):
    return Complete(ctx.call_model("m", [{"role": "user", "content": "new"}]))


def test_replay_of_a_resume():
    snap, traced, _, state = recorded("wait")
    intent = next(t["attributes"]["intent_id"] for t in traced if t["event_type"] == "INTENT_EMITTED")
    answer = {"entity_key": "6b", "event_time_ms": T0 + 5, "arrival": 1, "kind": "approval", "approval": {"intent_id": intent}}
    rows = kernel.on_envelope(CONFIG, "6b", state, answer, 0)
    traced += [r | {"entity_key": "6b"} for r in rows if r["stream"] == "traces"]
    raw = json.loads(snap["raw"]) | {"cache": state.cache}  # before the resume, with what it cached
    bundle = replay.build(snap | {"raw": json.dumps(raw)}, traced, answer)
    assert bundle.is_resume and replay.compare(bundle, replay.run(bundle, CONFIG)) == []


def test_a_lost_commit_is_retried_alike():
    plain, _ = fold.run_key(CONFIG, "6b", [ev(0, "a"), ev(1, "b")])
    with chaos.fail_first("on_envelope", lambda rows: any(r["stream"] == "intents" for r in rows)) as lost:
        state = KeyState()
        with pytest.raises(chaos.ChaosFailure):
            fold.run_key(CONFIG, "6b", [ev(0, "a"), ev(1, "b")], state=state)
        assert state == KeyState() and lost
        again, _ = fold.run_key(CONFIG, "6b", [ev(0, "a"), ev(1, "b")], state=state)
    assert again == plain


def test_results_of_intents(spark, tmp_path):
    order = []
    registry = tools.Registry()
    registry.tool(lambda n: {"n": n}, name="ok", side_effect=True)

    @registry.tool(side_effect=True)
    def slow() -> str:
        raise TimeoutError

    registry.tool(lambda: 1, name="reads")
    base = {"intent_id": "i", "entity_key": "6b", "seq": 0, "step_index": 1, "tool_name": "ok", "kind": "TOOL", "args_json": '{"n":1}', "expires_at_ms": 10}
    for change, status in (({}, "OK"), ({"expires_at_ms": 5}, "EXPIRED"), ({"expires_at_ms": 0}, "EXPIRED"), ({"tool_name": "none"}, "REJECTED"), ({"tool_name": "reads"}, "REJECTED"), ({"args_json": "["}, "REJECTED"), ({"args_json": "{}"}, "REJECTED"), ({"tool_name": "slow", "args_json": "{}"}, "ERROR")):
        assert effects.result_of(base | change, registry, 5)["status"] == status, change
    assert "unknown" in effects.result_of(base | {"tool_name": "slow", "args_json": None}, registry, 5)["error_message"]
    rows = [dict(base, intent_id=f"i{k % 3}", step_index=k % 3) for k in range(6)] + [dict(base, intent_id="a", kind="APPROVAL")]
    df = spark.createDataFrame(rows)
    got = effects.execute(df, effects.Executor(dict(registry), f"{tmp_path}/leases", clock=lambda: 5)).collect()
    assert sorted((r["intent_id"], r["payload"]) for r in got) == [(f"i{k}", '{"n":1}') for k in range(3)]
    assert [r["intent_id"] for r in effects.approvals(df).collect()] == ["a"]

    def flaky():
        order.append(1)
        if len(order) < 3:
            raise OSError("down")
        return "up"

    waits = []
    assert effects.with_retry(flaky, sleep=waits.append) == "up" and waits == [0.1, 0.2]
    with pytest.raises(effects.PublishFailed):
        effects.with_retry(lambda: 1 / 0, attempts=2, sleep=waits.append)


def test_error_and_snapshot_payloads(spark):
    e = {"entity_key": "6b", "reason": "hitl_timeout", "detail": "seq=3", "event_time_ms": 5}
    one, other = json.dumps(e).encode(), json.dumps(e | {"detail": "other"}).encode()
    wrapped = json.dumps({"entity_key": "6b", "external_event": json.dumps(e | {"detail": "in"})}).encode()
    framed = ingest.frame(one) + ingest.frame(other)
    rows = [(one,), (wrapped,), (framed,), (framed[:-3],), (b'{"entity_key": "6b"}',), (b"",), (None,), (b"\xff\xff",)]
    good, bad = ingest.decode_errors(spark.createDataFrame(rows, "value binary"))
    assert sorted((r["detail"], r["truncated"]) for r in good.collect()) == [("in", False), ("other", False), ("seq=3", False), ("seq=3", False), ("seq=3", True)]
    assert len({r["error_id"] for r in good.collect()}) == 3 and bad.count() == 4
    s = ingest.canonical_json({"entity_key": "6b", "seq": 1, "snapshot_at_ms": 5, "memory_entries": 2}).encode()
    good, bad = ingest.decode_snapshots(spark.createDataFrame([(s,), (s.replace(b":5", b": 5"),), (ingest.frame(s),), (b"{}",)], "value binary"))
    assert [(r["seq"], r["memory_entries"], r["provenance"]) for r in good.collect()] == [(1, 2, "kafka")] * 2 and bad.count() == 2


def test_messages_of_a_topic_and_captures(spark, tmp_path):
    t = {"trace_id": "t", "span_id": "s", "event_type": "LLM_CALL", "start_ms": 3, "attributes": {"model": "m"}}
    df = spark.createDataFrame([(json.dumps(t).encode(), 7), (b"junk", 8), (json.dumps(t | {"event_type": "ODD"}).encode(), 9)], "value binary, offset bigint")
    good, bad = ingest.decode_traces(df)
    assert [(r["trace_id"], r["arrival"], r["provenance"], r["entity_key"], r["attributes"]) for r in good.collect()] == [("t", 7, "kafka", "", {"model": "m"})] and bad.count() == 2
    (tmp_path / "e").write_bytes(ingest.frame(json.dumps({"reason": "r", "entity_key": "6b"}).encode()) + b"\x05ab")
    got = ingest.read_capture(spark, str(tmp_path / "e"), "errors")[0].collect()
    assert [(r["reason"], r["truncated"], r["provenance"]) for r in got] == [("r", True, "bundle")]
    with pytest.raises(ValueError):
        ingest.read_capture(spark, str(tmp_path), "other")
    same = [ingest.rows_to_envelopes(spark.createDataFrame([("k", "p"), ("k", "q")], "key string, payload string").repartition(n))[0].orderBy("external_event").collect() for n in (1, 2)]
    assert same[0] == same[1]


def test_sinks_of_all_schemes(spark):
    rows = fold.run_agent(spark.createDataFrame([ev(0), ev(1)]), Config(agent=agents.buyer))
    traces, intents = fold.stream_of(rows, "traces"), fold.stream_of(rows, "intents")
    got = []

    class Collector(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Collector)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sinks.resolve(f"otlp://127.0.0.1:{server.server_port}", "traces")(traces, 0)
    server.shutdown()
    spans = [s for g in got for r in g["resourceSpans"] for x in r["scopeSpans"] for s in x["spans"]]
    assert len(spans) == traces.filter("event_type <> 'ACTIVATION_START'").count() and {s["name"] for s in spans} == {"intent_emitted", "suspended", "activation_end"}
    for bad, stream in (("otlp://host", "intents"), ("pubsub://p", "traces"), ("pubsub://p/t", "traces"), ("bigquery://p.d.t", "snapshots"), ("bigquery://p.d", "traces")):
        with pytest.raises(ValueError):
            sinks.resolve(bad, stream)
    sent = []
    sinks.register("pubsub", lambda uri, stream: lambda df, batch: sent.append((uri, stream, df.count())))
    sinks.resolve("pubsub://p/t", "intents")(intents, 0)
    assert sent == [("pubsub://p/t", "intents", 2)]
    sinks.WRITERS.clear()


def test_outbox_signs_and_sets_aside(spark):
    rows = fold.run_agent(spark.createDataFrame([ev(0), ev(1), ev(2, key="6c")]), Config(agent=agents.buyer))
    intents = fold.stream_of(rows, "intents")
    odd = intents.limit(1).withColumns({"args_json": F.lit("{"), "intent_id": F.lit("odd")}).unionByName(intents.limit(1).withColumns({"entity_key": F.lit("k" * 2000), "intent_id": F.lit("long")}))
    sent, dead = sinks.outbox(intents.unionByName(odd), "k1", "secret")
    values = [json.loads(r["value"]) for r in sent.collect()]
    assert len(values) == 3 and all(v["key_id"] == "k1" and len(v["signature"]) == 64 for v in values)
    assert sorted((r["intent_id"], r["why"]) for r in dead.collect()) == [("long", "the key is too long"), ("odd", "arguments are no JSON")]


def test_round_robin_is_even(spark):
    rows = spark.createDataFrame([ev(i, "same") for i in range(40)]).coalesce(1)
    n = fold.sharded(rows, 4, "round_robin").groupBy("entity_key").count().collect()
    assert [r["count"] for r in n] == [10] * 4
    with pytest.raises(ValueError):
        fold.sharded(rows, 4, "other")


def test_judge_answers_are_never_made_up(spark):
    answers = {"a": '{"score": 4, "rationale": "r"}', "b": '{"score": 6, "rationale": "r"}', "c": '{"score": true, "rationale": "r"}', "d": "no", "e": '{"score": 3}', "f": "[1]", "g": None}

    def provider():
        def call(request):
            label = request["messages"][0]["content"].split("outcome: ")[1].split("\n")[0]
            if answers[label] is None:
                raise ProviderError("down")
            return Response(answers[label])

        return call

    df = spark.createDataFrame([("6b", i, "s", k, T0, "completed", None, None) for i, k in enumerate(answers)], "entity_key string, seq bigint, scenario string, label string, event_time_ms bigint, activation_status string, input_tokens bigint, output_tokens bigint")
    got = {r["label"]: (r["kind"], r["score"], r["judge_error"]) for r in evaluation.judged(df, provider, "m").collect()}
    bad = ("judge_error", None, "invalid_verdict")
    assert got == {"a": ("verdict", 4, None), "b": bad, "c": bad, "d": bad, "e": bad, "f": bad, "g": ("judge_error", None, "ProviderError")}


def test_outcomes_join_a_stream(spark, tmp_path):
    """Outcomes on time, repeated, without a trace and missing, by a scripted clock."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hour = 3600_000
    schema = "tag string, entity_key string, seq bigint, event_type string, start_ms bigint, attributes map<string, string>, scenario string, label string, event_time_ms bigint"
    t = lambda seq, at: ("trace", "6b", seq, "ACTIVATION_END", T0 + at, {"status": "completed"}, None, None, T0 + at)
    o = lambda seq, at: ("outcome", "6b", seq, None, None, None, "s", "good", T0 + at)
    steps = [[t(1, 0), t(2, 0)], [o(1, hour), o(9, hour)], [o(1, 2 * hour)], [t(3, 30 * hour)], [t(4, 31 * hour)], [t(5, 32 * hour)]]
    source = ingest.scripted(spark, str(tmp_path / "in"), steps, schema)
    joined = evaluation.outcome_join(source.filter("tag = 'trace'"), source.filter("tag = 'outcome'"), 24 * hour, "1 second")
    q = joined.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + 120
        while time.time() < end and spark.table("verdicts").filter("verdict = 'no_outcome'").count() < 1:
            if q.exception():
                raise q.exception()
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r["seq"], r["verdict"], r["label"], r["activation_status"]) for r in spark.table("verdicts").collect())
    assert got == [(1, "joined", "good", "completed"), (1, "orphaned", "good", None), (2, "no_outcome", None, "completed"), (9, "orphaned", "good", None)]


def test_quality_windows_of_a_stream(spark, tmp_path):
    hour = 3600_000
    schema = "kind string, score bigint, scenario string, judge_prompt_version string, event_time_ms bigint"
    base = T0 - T0 % hour
    row = lambda kind, score, at: (kind, score, "s", "v1", base + at)
    source = ingest.scripted(spark, str(tmp_path / "in"), [[row("verdict", 4, 0), row("verdict", 1, 5)], [row("judge_error", None, 9), row("no_outcome", None, hour)], [row("verdict", 5, 9 * hour)], [row("verdict", 5, 9 * hour)]], schema)
    q = evaluation.quality(source, delay="10 minutes").writeStream.format("memory").queryName("quality").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted((r["window_ms"] - base, r["judged"], r["mean_score"], r["no_outcome"], r["judge_errors"]) for r in spark.table("quality").collect())
    finally:
        q.stop()
    assert got == [(0, 2, 2.5, 0, 1), (hour, 0, None, 1, 0)]


def test_metric_summary(spark):
    rows = fold.run_agent(spark.createDataFrame([ev(i) for i in range(5)]), Config(agent=agents.buyer, metrics=True))
    s = metrics.summary(rows)
    assert s["counters"]["activations"] == s["counters"]["suspensions"] == s["counters"]["intents_emitted"] == 5 and s["counters"]["llm_calls"] == 0
    assert s["distributions"]["activation_ms"]["count"] == 5 and s["distributions"]["batch_size"]["count"] == 0
