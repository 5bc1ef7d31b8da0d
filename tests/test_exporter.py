"""The span exporter: full and late batches, receivers that are absent, slow or unwilling, counts by batch."""

import http.server
import json
import threading
import time

import pytest

from keyloom.sources import ingest, testbed
from keyloom.streaming import exporter, sinks
from keyloom.streaming.exporter import Counts, Outbound, Refused


class Receiver:
    def __init__(self, fails=None):
        self.got, self.threads, self.fails = [], set(), fails
        self.began, self.go_on = threading.Event(), threading.Event()
        self.go_on.set()

    def __call__(self, spans):
        self.threads.add(threading.get_ident())
        self.began.set()
        self.go_on.wait(20)
        if self.fails:
            raise self.fails
        self.got.append(list(spans))


def test_batches_are_sent_by_another_thread():
    r = Receiver()
    out = Outbound(r, batch=2)
    for k in range(5):
        out.put(str(k))
    assert out.finish() == Counts(exported=5, requests=3)
    assert r.got == [["0", "1"], ["2", "3"], ["4"]] and threading.get_ident() not in r.threads


def test_a_full_queue_drops_and_does_not_block():
    r = Receiver()
    r.go_on.clear()
    out = Outbound(r, batch=2, queued=1)
    for k in range(2):
        out.put(str(k))
    assert r.began.wait(5)
    began = time.monotonic()
    for k in range(4):
        out.put(str(k))
    assert time.monotonic() - began < 1
    r.go_on.set()
    got = out.finish()
    assert (got.exported, got.dropped) == (4, 2)


def test_an_absent_receiver_is_tried_again_until_the_deadline():
    r = Receiver(ConnectionRefusedError())
    out = Outbound(r, batch=2, deadline_s=0.4)
    for k in range(4):
        out.put(str(k))
    began = time.monotonic()
    got = out.finish()
    assert time.monotonic() - began < 3
    assert (got.exported, got.dropped) == (0, 4) and got.failures > 1 and got.requests > 1


def test_a_refusal_is_not_tried_again():
    out = Outbound(Receiver(Refused(400)), batch=2)
    out.put("a"), out.put("b")
    assert out.finish() == Counts(dropped=2, requests=1, failures=1)


def test_a_receiver_that_hangs_holds_up_nobody():
    r = Receiver()
    r.go_on.clear()
    out = Outbound(r, batch=1, queued=4, deadline_s=0.2)
    out.put("a")
    assert r.began.wait(5)
    out.put("b")
    began = time.monotonic()
    got = out.finish()
    assert time.monotonic() - began < 3 and (got.exported, got.dropped) == (0, 2)
    r.go_on.set()
    time.sleep(0.1)
    assert (got.exported, got.dropped) == (0, 2)  # what comes later changes no count


@pytest.fixture
def collector():
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append(body)
            self.send_response(400 if self.path == "/no" else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port, got
    server.shutdown()


def test_tables_and_streams(spark, sf_dir, tmp_path, collector):
    port, got = collector
    traces = testbed.trace_events(spark, sf_dir).filter("arrival < 300")
    n = traces.filter("event_type <> 'ACTIVATION_START'").count()
    sinks.resolve(f"otlp://127.0.0.1:{port}?batch=50&report={tmp_path}/r&service=mine", "traces")(traces, 4)
    spans = [s for g in got for r in g["resourceSpans"] for x in r["scopeSpans"] for s in x["spans"]]
    assert exporter.counts(f"{tmp_path}/r/4")["batch"].exported == n == len(spans)
    assert {a["value"]["stringValue"] for g in got for r in g["resourceSpans"] for a in r["resource"]["attributes"]} == {"mine"}
    assert all(("status" in s) == (s["name"] == "error") for s in spans) and all(len(g["resourceSpans"][0]["scopeSpans"][0]["spans"]) <= 50 for g in got)
    back = ingest.otlp_events(spark.createDataFrame([(json.dumps(s),) for s in spans], "span string"))
    want = traces.filter("event_type <> 'ACTIVATION_START'").select("trace_id", "span_id", "event_type", "start_ms")
    assert back.select(*want.columns).exceptAll(want).isEmpty() and back.count() == n
    got.clear()
    exporter.spans(traces).write.parquet(f"{tmp_path}/in")
    spark.dataSource.register(exporter.SpanExport)
    stream = spark.readStream.schema("span string").parquet(f"{tmp_path}/in")
    for path, kind in (("/v1/traces", "exported"), ("/no", "dropped")):
        q = stream.writeStream.format("otlp").option("url", f"http://127.0.0.1:{port}{path}").option("report", f"{tmp_path}/{kind}").option("checkpointLocation", f"{tmp_path}/cp-{kind}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert getattr(exporter.counts(f"{tmp_path}/{kind}")["batch-0"], kind) == n


def test_a_dead_collector_fails_no_job(spark, sf_dir, tmp_path):
    traces = testbed.trace_events(spark, sf_dir).filter("arrival < 100")
    sinks.resolve(f"otlp://127.0.0.1:9?deadline=0.3&report={tmp_path}/r", "traces")(traces, 0)
    got = exporter.counts(f"{tmp_path}/r/0")["batch"]
    assert got.exported == 0 and got.failures > 0 and got.dropped == traces.filter("event_type <> 'ACTIVATION_START'").count()
