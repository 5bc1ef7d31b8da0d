import hashlib
import hmac
import json

import pytest

from keyloom import schemas
from keyloom.operators import longterm
from keyloom.sources import ingest
from keyloom.streaming import agents, fold, sinks
from keyloom.streaming.kernel import Config


def test_frames_keep_the_complete_prefix(spark, tmp_path):
    bodies = [json.dumps({"trace_id": "t", "span_id": str(i), "event_type": "LLM_CALL", "start_ms": i, "attributes": {"model": "m"}}).encode() for i in range(3)]
    data = b"".join(map(ingest.frame, bodies))
    assert ingest.frames(data) == (bodies, False) and ingest.frames(data[:-1]) == (bodies[:2], True)
    assert ingest.frames(ingest.frame(b"x" * 300)) == ([b"x" * 300], False)
    (tmp_path / "a.bin").write_bytes(data[:-1])
    got = ingest.read_bundle(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["span_id"], r["truncated"], r["provenance"], r["attributes"]) for r in got] == [("0", True, "bundle", {"model": "m"}), ("1", True, "bundle", {"model": "m"})]


def test_exported_spans(spark):
    span = {"traceId": "AB", "spanId": "CD", "name": "LLM_CALL", "startTimeUnixNano": "1700000000123999999", "endTimeUnixNano": "1700000000124000000", "attributes": [{"key": "a", "value": {"intValue": "5"}}, {"key": "b", "value": {"boolValue": True}}]}
    r = ingest.otlp_events(spark.createDataFrame([(json.dumps(span),), (json.dumps(span | {"name": "odd"}),)], "span string")).orderBy("event_type").collect()
    assert (r[1]["event_type"], r[1]["start_ms"], r[1]["trace_id"], r[1]["attributes"], r[1]["provenance"]) == ("LLM_CALL", 1700000000123, "ab", {"a": "5", "b": "true"}, "otlp")
    assert r[0]["event_type"] == "EVENT_TYPE_UNSPECIFIED"


def test_warehouse_round_trip_and_window(spark):
    e = spark.createDataFrame([("t", "s", "", "6b", 1, 2, "LLM_CALL", 86400000, 5, {"b": "1", "a": "2"}, "bigquery", 3)], schemas.TRACE_EVENT)
    rows = ingest.warehouse_rows(e)
    assert [tuple(p) for p in rows.first()["attributes"]] == [("a", "2"), ("b", "1")] and str(rows.first()["event_date"]) == "1970-01-02"
    assert [tuple(r) for r in ingest.warehouse_events(rows.drop("event_date")).collect()] == [tuple(r) for r in e.collect()]
    with pytest.raises(Exception, match="unknown event type"):
        ingest.warehouse_events(rows.withColumn("event_type", rows["trace_id"])).collect()
    times = spark.range(0, 200_000, 10_000).withColumnRenamed("id", "t")
    assert ingest.pull_window(times, "t", 150_000, 100_000, overlap_ms=20_000).count() == 7
    assert ingest.pull_window(times, "t", 150_000, None, lookback_ms=30_000).count() == 3


def test_generic_rows(spark):
    df = spark.createDataFrame([("k", "p", "5"), (None, "p", "5"), ("", "p", None), ("k", None, "1"), ("k", "p", "x"), ("k", "q", None)], "key string, payload string, at string")
    good, errors = ingest.rows_to_envelopes(df, "at")
    assert sorted((r["entity_key"], r["event_time_ms"], r["external_event"]) for r in good.collect()) == [("6b", 0, "q"), ("6b", 5, "p")]
    assert sorted(r["detail"] for r in errors.collect()) == ["event time is no number", "key is empty", "key is missing", "payload is missing"]


def test_sinks(spark, tmp_path):
    rows = fold.run_agent(spark.createDataFrame([("6b", 1, 1, "external_event", "x")], "entity_key string, event_time_ms bigint, arrival bigint, kind string, external_event string"), Config(agent=agents.buyer))
    intents = fold.stream_of(rows, "intents")
    sink = sinks.resolve(f"parquet://{tmp_path}", "intents")
    sink(intents.unionByName(intents), 0)
    sink(intents, 0)
    assert spark.read.parquet(f"{tmp_path}/intents").count() == 1
    sinks.resolve("memory://m", "intents")(intents, 4)
    assert sinks.MEMORY["m"][0][0] == 4
    for bad in ("parquet://", "memory://", "kafka://host", "kafka://host/a/b", "ftp://x"):
        with pytest.raises(ValueError):
            sinks.resolve(bad, "intents")
    with pytest.raises(ValueError):
        sinks.resolve("console://", "nothing")
    assert json.loads(bytes(sinks.keyed(intents).first()["value"]))["tool_name"] == "approval"


def test_signatures(spark):
    df = spark.createDataFrame([("i1", "pay", 5), ("i2", "look", 6)], "intent_id string, tool_name string, expires_at_ms bigint")
    s = sinks.signed(df, "k1", "secret")
    body = '{"expires_at_ms":5,"intent_id":"i1","tool_name":"pay"}'
    assert s.filter("intent_id = 'i1'").first()["signature"] == hmac.new(b"secret", body.encode(), hashlib.sha256).hexdigest()
    assert {r["verdict"] for r in sinks.verified(s, {"k1": "secret"}).collect()} == {"ok"}
    assert {r["verdict"] for r in sinks.verified(s, {"k1": "other"}).collect()} == {"bad_signature"}
    assert {r["verdict"] for r in sinks.verified(s, {"k2": "secret"}).collect()} == {"unknown_signing_key"}
    plain = df.selectExpr("*", "cast(null as string) key_id", "cast(null as string) signature")
    assert [sinks.verified(plain, {"k1": "secret"}, m).filter("accepted").count() for m in ("off", "permissive", "require")] == [2, 2, 0]


def test_long_term_memory(spark):
    rows = spark.createDataFrame([("e", "a/x", "1", 5, 0, 1), ("e", "a/x", "2", 4, 0, 2), ("e", "a/x", "3", 5, 0, 3), ("e", "a_y", "4", 1, 0, 4)], "entity_key string, name string, value string, seq bigint, updated_at_ms bigint, arrival bigint")
    up = longterm.upsert(rows)
    assert {(r["name"], r["value"]) for r in up.collect()} == {("a/x", "3"), ("a_y", "4")}
    assert [r["name"] for r in longterm.load(up, "e", "a_").collect()] == ["a_y"]
    staged = spark.createDataFrame([("e", "a_y", "new", 0, 0)], "entity_key string, name string, value string, seq bigint, updated_at_ms bigint")
    assert {(r["name"], r["value"]) for r in longterm.overlay(up, staged).collect()} == {("a/x", "3"), ("a_y", "new")}
