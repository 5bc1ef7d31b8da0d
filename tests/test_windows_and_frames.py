"""The windowed warehouse source, and captured files read in splits."""

import json
import random

import pytest

from keyloom import schemas
from keyloom.operators.store import RecordStore
from keyloom.sources import frames, ingest, testbed, warehouse

HOUR = 3600_000
FIELDS = [c.split()[0] for c in schemas.TRACE_EVENT.replace("map<string, string>", "map").split(", ")]


def reader(tmp_path, **options):
    return warehouse.WindowReader({"path": str(tmp_path / "table"), "clockFile": str(tmp_path / "now")} | options)


def test_windows_follow_the_watermark(tmp_path):
    r = reader(tmp_path, lookbackMs=str(2 * HOUR), overlapMs="100")
    assert r.window(r.initialOffset(), {"until": 10 * HOUR}) == (8 * HOUR, 10 * HOUR)
    assert r.window({"until": 10 * HOUR}, {"until": 11 * HOUR}) == (10 * HOUR - 100, 11 * HOUR)
    for same in (10 * HOUR, 9 * HOUR):
        a, b = r.window({"until": 10 * HOUR}, {"until": same})
        assert a == b
    (tmp_path / "now").write_text("500")
    assert r.latestOffset() == {"until": 500}
    (tmp_path / "now").write_text("400")
    assert r.latestOffset() == {"until": 500}  # it never goes back
    for bad in ({"path": ""}, {"lookbackMs": "0"}, {"everyMs": "-1"}, {"provenance": "none"}):
        with pytest.raises(ValueError):
            reader(tmp_path, **bad)


def test_rows_that_are_no_events():
    good = {"trace_id": "t", "span_id": "s", "event_type": "LLM_CALL", "start_ms": None, "attributes": [{"key": "a", "value": "b"}]}
    assert warehouse.event_of(good, "bigquery") == {"trace_id": "t", "span_id": "s", "parent_span_id": "", "entity_key": "", "seq": 0, "step_index": 0, "start_ms": 0, "end_ms": 0, "event_type": "LLM_CALL", "attributes": {"a": "b"}, "provenance": "bigquery", "arrival": 0}
    for change in ({"event_type": "ODD"}, {"event_type": None}, {"trace_id": None}, {"seq": "x"}, {"attributes": [{"k": 1}]}, {"attributes": 5}):
        with pytest.raises(ValueError):
            warehouse.event_of(good | change, "bigquery")


def test_a_stream_of_windows_into_the_store(spark, sf_dir, tmp_path):
    events = testbed.trace_events(spark, sf_dir).filter("arrival < 400")
    times = [r.start_ms for r in events.select("start_ms").orderBy("start_ms").collect()]
    ingest.warehouse_rows(events).repartition(3).write.partitionBy("event_date").parquet(str(tmp_path / "table"))
    odd = [("t", "s", "ODD", times[0] + 1)]
    spark.createDataFrame(odd, "trace_id string, span_id string, event_type string, start_ms bigint").write.parquet(str(tmp_path / "table" / "more"))
    middle, end = times[len(times) // 2], times[-1] + 1
    store, told, bad, read = RecordStore(spark, f"file://{tmp_path}/store", buckets=2), [], [], []

    def into(batch, number):
        good, wrong = warehouse.split(batch)
        bad.append(wrong.count())
        read.append(good.count())
        store.sink(query="pull", kind="events", done=lambda b, n: told.append(n))(good, number)

    spark.dataSource.register(warehouse.WindowedTraces)
    for now in (middle, end, end):
        (tmp_path / "now").write_text(str(now))
        stream = spark.readStream.format("trace-windows").option("path", str(tmp_path / "table")).option("clockFile", str(tmp_path / "now")).option("lookbackMs", str(times[-1])).option("overlapMs", str(HOUR * 24 * 40)).load()
        q = stream.writeStream.foreachBatch(into).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert bad == [1, 1] or bad[0] == 1
    assert told[0] == sum(t < middle for t in times) == read[0]
    assert sum(told) == len(times) and read[1] > told[1]  # what the overlap read again changed nothing
    assert {r.provenance for r in store.events.select("provenance").distinct().collect()} == {"bigquery"}
    r = reader(tmp_path, lookbackMs="1000")
    r.clock_file = None
    some = r.partitions({"until": 0}, {"until": middle})
    whole = r.partitions({"until": 0}, {"until": end + 10**13}) or reader(tmp_path, lookbackMs=str(10**14)).partitions({"until": 0}, {"until": end})
    assert 0 < len(some) < len(whole)  # folders and row groups outside the window are not read


def serial(data):
    return ingest.frames(data)


@pytest.mark.parametrize("cut", [False, True])
def test_splits_equal_a_serial_read(spark, tmp_path, cut):
    rng = random.Random(3)
    bodies = []
    for i in range(400):
        body = json.dumps({"i": i, "text": "x" * rng.choice([0, 5, 90, 200, 3000])}).encode()
        if i % 7 == 0:  # records that quote frames
            inner = b"".join(ingest.frame(b'{"q": 1}' + b" " * rng.randrange(30)) for _ in range(6))
            body = json.dumps({"i": i, "quoted": inner.decode("latin-1")}, ensure_ascii=False).encode("latin-1")
        if i % 31 == 0:
            body = rng.randbytes(rng.randrange(300))  # no record at all
        bodies.append(body)
    data = b"".join(map(ingest.frame, bodies))
    data = data[:-10] if cut else data
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(data)
    (tmp_path / "in" / "none").write_bytes(b"")
    (tmp_path / "in" / "torn").write_bytes(b"\x85")
    want, torn = serial(data)
    for size in (1 << 20, 5000, 701):
        rows = frames.read_frames(spark, str(tmp_path / "in"), size).collect()
        own = sorted((r for r in rows if r.file.endswith("/a")), key=lambda r: r.position)
        assert [bytes(r.body) for r in own] == want and [r.position for r in own] == list(range(len(want)))
        assert {r.truncated for r in own} == {cut} == {torn}
        assert {(r.file[-4:], r.position, r.truncated) for r in rows if not r.file.endswith("/a")} == {("torn", -1, True)}  # Spark lists no file without bytes


def test_a_split_finds_its_place(tmp_path):
    bodies = [json.dumps({"i": i, "pad": "y" * (i % 50)}).encode() for i in range(300)]
    starts, at = [], 0
    for b in bodies:
        starts.append(at)
        at += len(ingest.frame(b))
    (tmp_path / "f").write_bytes(b"".join(map(ingest.frame, bodies)))
    f = frames.FrameFile(str(tmp_path / "f"))
    for place in range(1, at, 97):
        assert f.first(place, at) == next((s for s in starts if s >= place), at)


def test_captures_give_back_what_they_cannot_read(spark, tmp_path):
    trace = {"trace_id": "t", "span_id": "s", "event_type": "LLM_CALL", "start_ms": 5}
    (tmp_path / "t").write_bytes(b"".join(map(ingest.frame, (json.dumps(trace).encode(), b"junk", json.dumps(trace | {"event_type": "ODD"}).encode(), json.dumps(trace | {"span_id": "u"}).encode()))))
    good, bad = ingest.read_capture(spark, str(tmp_path / "t"), "traces")
    assert sorted((r.span_id, r.arrival, r.provenance, r.truncated) for r in good.collect()) == [("s", 0, "bundle", False), ("u", 3, "bundle", False)] and bad.count() == 2
    error = {"entity_key": "6b", "reason": "r"}
    (tmp_path / "e").write_bytes(ingest.frame(json.dumps(error).encode()) + ingest.frame(b"{}") + ingest.frame(json.dumps(error | {"detail": "d"}).encode()))
    for _ in range(2):  # the same order again
        good, bad = ingest.read_capture(spark, str(tmp_path / "e"), "errors")
        assert sorted((r.arrival >> 20, r.detail) for r in good.collect()) == [(0, None), (2, "d")] and bad.count() == 1
    snap = ingest.canonical_json({"entity_key": "6b", "seq": 1, "snapshot_at_ms": 3}).encode()
    (tmp_path / "s").write_bytes(ingest.frame(snap) + ingest.frame(snap + b" "))
    good, bad = ingest.read_capture(spark, str(tmp_path / "s"), "snapshots")
    assert good.count() == 1 and bad.count() == 1


def test_small_splits_share_tasks(spark, tmp_path):
    data = b"".join(ingest.frame(json.dumps({"i": i}).encode()) for i in range(500))
    (tmp_path / "a").write_bytes(data)
    got = frames.read_frames(spark, str(tmp_path), 64)
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < len(data) // 64
    assert [r.position for r in got.orderBy("position").collect()] == list(range(500))
