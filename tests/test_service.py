"""The HTTP routes over a small store, and the feed of changes."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from keyloom.operators.store import RecordStore
from keyloom.plans.service import LiveFeed, Service, serve
from keyloom.sources import ingest, testbed


@pytest.fixture(scope="module")
def service(spark, sf_dir, tmp_path_factory):
    store = RecordStore(spark, f"file://{tmp_path_factory.mktemp('service')}/store", buckets=2)
    e = testbed.trace_events(spark, sf_dir)
    some = e.select("entity_key").distinct().orderBy("entity_key").limit(3)
    pick = lambda df: df.join(some, "entity_key", "left_semi")
    store.write(events=pick(e), errors=pick(testbed.error_records(spark, sf_dir)), snapshots=pick(testbed.snapshots(spark, sf_dir)))
    return Service(store)


def test_read_routes(service):
    status, page = service.respond("GET", "/api/activations?limit=2")
    assert status == 200 and len(page["items"]) == 2 and page["total"] > 2
    status, more = service.respond("GET", f"/api/activations?limit=2&cursor={page['next_cursor']}")
    order = [(a["started_ms"], a["entity_key"], a["seq"]) for a in page["items"] + more["items"]]
    assert order == sorted(order, reverse=True) and len(set(order)) == 4
    one = page["items"][0]
    status, detail = service.respond("GET", f"/api/activations/{one['entity_key']}/{one['seq']}")
    assert status == 200 and detail["summary"]["trace_id"] == one["trace_id"] and detail["events"] and detail["replay"]
    status, trace = service.respond("GET", f"/api/traces/{one['trace_id']}")
    assert status == 200 and trace["spans"]
    for path in ("overview?buckets=4", "traces?limit=9999", "errors?limit=0", "errors/groups", "models", "tools", "approvals?pending_only=true", "entities", "search?q=m-1", "store"):
        status, found = service.respond("GET", f"/api/{path}")
        assert status == 200 and found, path
    assert len(service.respond("GET", "/api/errors?limit=0")[1]["items"]) == 1
    assert service.respond("GET", "/api/activations?status=none")[1] == {"items": [], "next_cursor": None, "total": 0}
    for path in ("/api/none", "/api/activations/none/1", "/api/traces/none", "/else"):
        assert service.respond("GET", path)[0] == 404
    for path in ("/api/activations?limit=x", "/api/activations?cursor=W10="):
        assert service.respond("GET", path)[0] == 400
    assert service.respond("GET", "/healthz") == (200, {"status": "ok"})


def test_ingest_over_a_server(spark, tmp_path):
    service = Service(RecordStore(spark, f"file://{tmp_path}/store", buckets=2))
    reader = service.feed.subscribe()
    server = serve(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path, body, kind="application/octet-stream"):
        ask = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", body, {"Content-Type": kind})
        try:
            with urllib.request.urlopen(ask) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    t = {"trace_id": "t", "span_id": "s", "event_type": "LLM_CALL", "entity_key": "6b", "seq": 1, "start_ms": 5, "attributes": {"model": "m"}}
    body = b"".join(ingest.frame(json.dumps(t | {"span_id": f"s{i}"}).encode()) for i in range(3))
    assert post("/ingest/traces", body) == (200, {"accepted": 3, "written": 3}) and post("/ingest/traces", body) == (200, {"accepted": 3, "written": 0})
    assert reader.take(1) == {"kind": "trace", "entity_key": "6b", "seq": 1, "trace_id": "t", "count": 3}
    assert post("/ingest/errors", json.dumps({"entity_key": "6b", "seq": 1, "reason": "activation_error", "detail": "d", "event_time_ms": 9}).encode()) == (200, {"accepted": 1, "written": 1})
    span = {"traceId": "aa", "spanId": "bb", "name": "LLM_CALL", "startTimeUnixNano": "1000000", "endTimeUnixNano": "2000000"}
    spans = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}).encode()
    assert post("/ingest/otlp", spans, "application/json") == (200, {"accepted": 1, "written": 1})
    assert post("/ingest/otlp", spans, "text/plain")[0] == 400 and post("/ingest/traces", b"junk")[0] == 400 and post("/ingest/errors", b'{"x": 1}')[0] == 400 and post("/ingest/none", b"{}")[0] == 404
    assert service.respond("GET", "/api/activations")[1]["items"][0]["status"] == "error"
    server.shutdown()


def test_feed_drops_the_newest_and_says_so():
    feed = LiveFeed(depth=2)
    a, b = feed.subscribe(), feed.subscribe()
    feed.publish([{"kind": "trace", "count": i} for i in range(5)])
    assert a.take(0) == {"kind": "lagged", "entity_key": "", "seq": None, "trace_id": "", "count": 3}
    assert [a.take(0)["count"], a.take(0)["count"], a.take(0)] == [0, 1, None]
    b.close()
    feed.publish([{"kind": "trace", "count": 9}])
    assert len(feed.readers) == 1 and next(a.frames()) == 'data: {"kind":"trace","count":9}\n\n'
    with pytest.raises(ValueError):
        LiveFeed(0)
