"""The record store as a stream's target: tokens, segments, writers that meet, retention."""

import itertools

import pytest
from pyspark.sql import functions as F

from keyloom import schemas
from keyloom.operators import segments
from keyloom.operators.store import RecordStore
from keyloom.sources import testbed
from keyloom.streaming import agents, fold, sinks
from keyloom.streaming.kernel import Config

T0 = 1_700_000_000_000
FIELDS = [c.split()[0] for c in schemas.TRACE_EVENT.replace("map<string, string>", "map").split(", ")]


def events(spark, rows):
    base = {"parent_span_id": "", "entity_key": "6b", "seq": 1, "step_index": 0, "event_type": "LLM_CALL", "end_ms": 0, "attributes": {"model": "m"}, "provenance": "native", "arrival": 1}
    return spark.createDataFrame([tuple((base | r)[f] for f in FIELDS) for r in rows], schemas.TRACE_EVENT)


def one(trace, span, at, **kw):
    return {"trace_id": trace, "span_id": span, "start_ms": T0 + at} | kw


def content(store):
    return {t: sorted(map(repr, store.table(t).drop("arrival").collect())) for t in ("events", "errors", "snapshots", "activations", "traces", "entities")}


def test_a_small_batch_rewrites_no_bucket(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/s", buckets=2)
    store.write(events=events(spark, [one(f"t{i}", "a", i) for i in range(300)]))
    before = store.segments.current()
    assert store.write(events=events(spark, [one("t7", "b", 500)])) == 1
    after = store.segments.current()
    for b, held in before.of("events").items():
        assert after.of("events")[b][: len(held)] == held
    added = [s for b, held in after.of("events").items() for s in held if s not in before.of("events").get(b, [])]
    rows = spark.read.parquet(*(f"{tmp_path}/s/events/{s[0]}" for s in added))
    assert [(r.trace_id, r.span_id) for r in rows.collect()] == [("t7", "b")] and store.events.count() == 301
    assert store.table("traces").filter("trace_id = 't7'").first()["events"] == 2
    assert store.compact() > 0
    merged = store.segments.current()
    assert all(len(held) == 1 for t in merged.tables.values() for held in t.values()) and store.events.count() == 301
    store.vacuum()
    assert store.table("traces").filter("trace_id = 't7'").first()["events"] == 2 and store.segments.versions() == [merged.number]


def test_runs_that_are_merged():
    assert segments.due([100, 1, 1, 1]) is None and segments.due([1, 1, 1, 1]) == 0
    assert segments.due([1000, 1, 1, 1, 1]) == 1 and segments.due([12, 1, 1, 1]) == 0
    held, written = [], 0
    for _ in range(1000):
        held.append(1)
        if (at := segments.due(held)) is not None:
            written += sum(held[at:])
            held[at:] = [sum(held[at:])]
    assert len(held) < 12 and written < 1000 * 10


def test_merged_segments_give_the_same_records(spark, tmp_path):
    batches = [[one(f"t{i % 3}", "a", i, attributes={f"k{i}": "v"}, arrival=i)] for i in range(3)] + [[one("t0", "a", 0, start_ms=0, entity_key="", provenance="otlp", seq=0, attributes={"x": "y"})]]
    small, never = RecordStore(spark, f"file://{tmp_path}/a", 1, fanout=2), RecordStore(spark, f"file://{tmp_path}/b", 1, fanout=99)
    for b in batches:
        assert small.write(events=events(spark, b)) == never.write(events=events(spark, b)) == 1
    assert content(small) == content(never)
    assert len(small.segments.current().of("events")["0"]) < len(never.segments.current().of("events")["0"]) == 4


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    first, second = (RecordStore(spark, f"file://{tmp_path}/s", buckets=2) for _ in range(2))
    commit, met = first.segments.commit, []

    def late(state):
        if not met:
            met.append(second.write(events=events(spark, [one("t1", "b", 2, attributes={"n": "2"})])))
        return commit(state)

    first.segments.commit = late
    assert first.write(events=events(spark, [one("t1", "a", 1)])) == 1 and met == [1]
    assert {r.span_id for r in first.events.collect()} == {"a", "b"} and first.table("traces").first()["events"] == 2


@pytest.mark.parametrize("how", ["_link", "_rename"])
def test_a_version_is_created_once(spark, tmp_path, how, monkeypatch):
    folder = segments.Folder(spark, f"file://{tmp_path}/f")
    monkeypatch.setattr(segments.Folder, "_link", getattr(segments.Folder, how))
    assert folder.create("v/1", "a") and not folder.create("v/1", "b") and folder.read("v/1") == "a" and folder.names("v") == ["1"]


def test_retention_drops_whole_segments(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/s", buckets=1, fanout=99)
    store.write(events=events(spark, [one("t1", "a", 1), one("t2", "a", 2)]))
    store.write(events=events(spark, [one("t1", "b", 3), one("t3", "a", 500)]))
    store.write(events=events(spark, [one("t4", "a", 4), one("t4", "b", 600)]))
    names = [s[0] for s in store.segments.current().of("events")["0"]]
    assert store.prune(T0 + 1000, 900) == 4
    left = [s[0] for s in store.segments.current().of("events")["0"]]
    assert names[0] not in left and left[:2] == names[1:] and len(left) == 3  # the third marks what went from the others
    assert {(r.trace_id, r.span_id) for r in store.events.collect()} == {("t3", "a"), ("t4", "b")}
    assert {(r.trace_id, r.events) for r in store.table("traces").collect()} == {("t3", 1), ("t4", 1)}
    assert store.write(events=events(spark, [one("t1", "a", 700)])) == 1 and store.events.count() == 3  # a removed key may come again
    store.compact()
    assert store.events.count() == 3 and store.prune(T0 + 1000, 900) == 0


class Killed(RuntimeError):
    pass


def test_three_streams_and_a_killed_batch(spark, sf_dir, tmp_path):
    tables = {"events": testbed.raw_events(spark, sf_dir), "errors": testbed.error_records(spark, sf_dir), "snapshots": testbed.snapshots(spark, sf_dir)}
    store, seen = RecordStore(spark, f"file://{tmp_path}/store", buckets=2), {}

    def stream(kind, die_at):
        def done(batch, changed):
            seen.setdefault(kind, []).append((batch, changed))
            if batch == die_at:
                raise Killed  # after the rows are in, before the checkpoint knows

        source = spark.readStream.schema(tables[kind].schema).parquet(f"{tmp_path}/in/{kind}")
        query = source.writeStream.foreachBatch(store.sink(kind=kind, done=done)).option("checkpointLocation", f"{tmp_path}/cp/{kind}").trigger(availableNow=True).start()
        try:
            query.awaitTermination(300)
        except Exception as e:
            assert "Killed" in str(e)

    for part, kind in itertools.product(range(2), tables):
        tables[kind].filter(F.col("arrival") % 2 == part).write.mode("append").parquet(f"{tmp_path}/in/{kind}")
        stream(kind, die_at=1)
        if part == 1:
            stream(kind, die_at=None)
    for kind, runs in seen.items():
        assert [b for b, _ in runs] == [0, 1, 1] and runs[1][1] > 0 and runs[2][1] == 0, kind
    once = RecordStore(spark, f"file://{tmp_path}/once", buckets=2)
    once.write(**tables)
    assert content(store) == content(once)
    assert len(store.tokens()) == 3 and set(store.tokens().values()) == {1}


def test_the_kernels_output_in_one_version(spark, sf_dir, tmp_path):
    some = testbed.envelopes(spark, sf_dir).filter("arrival < 400").select("entity_key", "event_time_ms", "arrival", "kind", "external_event")
    rows = fold.run_agent(some, Config(agent=agents.buyer, ttl_ms=10**13)).persist()
    store = RecordStore(spark, f"file://{tmp_path}/store", buckets=2)
    sink = store.sink(query="q")
    sink(rows, 3)
    sink(rows, 3)
    n = rows.filter("stream = 'traces'").count()
    assert store.events.count() == n > 0 and store.segments.current().number == 1 and store.tokens() == {"q": 3}
    by_uri = sinks.resolve(f"console://{tmp_path}/other?buckets=2&query=q", "traces")
    by_uri(rows.filter("stream = 'traces'").select(*fold.STREAMS["traces"]), 0)
    assert content(RecordStore(spark, f"file://{tmp_path}/other"))["events"] == content(store)["events"]
    for bad, stream in (("console://", "traces"), ("console:///x", "output")):
        with pytest.raises(ValueError):
            sinks.resolve(bad, stream)


def test_an_empty_store(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/s")
    assert all(not v for v in content(store).values()) and store.prune(T0, 1) == 0 and store.compact() == 0
    assert store.write(events=events(spark, [])) == 0 and store.write(errors=spark.createDataFrame([], schemas.ERROR_RECORD), token=("q", 0)) == 0 and store.tokens() == {"q": 0}
    store.vacuum()
