"""The streaming operator lost in the middle of a batch and started again from its checkpoint: each record once, as undisturbed."""

import time

import pytest

from keyloom.streaming import agents, chaos, fold, processor
from keyloom.streaming.kernel import Batching, Complete, Config, Suspend

SCHEMA = "entity_key string, event_time_ms bigint, arrival bigint, kind string, external_event string"


def hurried(ctx):
    if ctx.is_resume:
        return Complete("resumed")
    ctx.request_approval({"event": ctx.event})
    return Suspend(snapshot=ctx.event, timeout_ms=1500)


CASES = {
    "commit": (Config(agent=agents.counter, ttl_ms=10**13), lambda rows: any(r["stream"] == "output" for r in rows)),
    "timeout": (Config(agent=hurried, ttl_ms=10**13), lambda rows: any(r.get("event_type") == "ERROR" for r in rows)),
    "flush": (Config(agent=agents.counter, ttl_ms=10**13, batching=Batching(max_batch_size=50, max_wait_ms=400)), lambda rows: any(r["stream"] == "output" for r in rows)),
}


def comparable(rows):
    return sorted((r["entity_key"], r["stream"], r["ordinal"], r["seq"], r["payload"], r["reason"], r["intent_id"], r["trace_id"], r["span_id"], r["event_type"]) for r in rows)


@pytest.mark.parametrize("case", CASES)
def test_a_lost_batch_is_done_again(spark, tmp_path, case):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    config, matches = CASES[case]
    now = int(time.time() * 1000)
    rows = [(f"k{i % 3}", now + i, i, "external_event", f'{{"k": {i}}}') for i in range(3 if case == "timeout" else 9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = []
    for key in ("k0", "k1", "k2"):
        own = [e for e in map(lambda r: r.asDict(), frame.collect()) if e["entity_key"] == key]
        want += [fold.as_row(key, i, r) for i, r in enumerate(fold.run_key(config, key, own, end_ms=now + 60_000)[0])]
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = processor.run_agent_stream(source, config, operator=chaos.FaultyProcessor(config, str(tmp_path), matches))
    started = 0
    end = time.time() + 120
    while time.time() < end:
        started += 1
        q = out.writeStream.foreachBatch(processor.parquet_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            while time.time() < end and q.isActive:
                if (tmp_path / "out").exists() and spark.read.schema(out.schema).parquet(str(tmp_path / "out")).count() >= len(want):
                    break
                time.sleep(0.3)
        finally:
            died = q.exception()
            q.stop()
        if died is None:
            break
        assert "lost after the state" in str(died)
    assert started == 2 and (tmp_path / "lost").exists()
    got = [r.asDict() for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()]
    assert comparable(got) == comparable(want)


def test_wanted_streams_and_few_messages():
    """Only rows of the wanted streams leave the operator, and a new key costs one question to the state store."""
    from types import SimpleNamespace

    import pandas as pd

    asked, held = [], {}

    class Cell:
        def __init__(self, name):
            self.name = name

        def exists(self):
            asked.append(self.name)
            return self.name in held

        def get(self):
            asked.append(self.name)
            return held.get(self.name)

        def update(self, value):
            held[self.name] = value

        def clear(self):
            held.pop(self.name, None)

    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 10, getCurrentWatermarkInMs=lambda: 0)
    handle = SimpleNamespace(getValueState=lambda name, schema: Cell(name), registerTimer=lambda at: None, deleteTimer=lambda at: None)
    one = processor.AgentProcessor(Config(agent=agents.counter, ttl_ms=10**13), streams=("output",))
    one.init(handle)
    rows = pd.DataFrame({"entity_key": ["6b"] * 3, "event_time_ms": [1, 2, 3], "arrival": [0, 1, 2], "kind": ["external_event"] * 3, "external_event": ['{"k": 2}'] * 3})
    first = pd.concat(one.handleInputRows(("6b",), iter([rows]), clock))
    assert asked == ["place"] and list(first["stream"]) == ["output"] * 3
    again = pd.concat(one.handleInputRows(("6b",), iter([rows]), clock))
    assert again["payload"].iloc[-1] == '{"n": 6, "sum": 12}' and again["ordinal"].iloc[0] - first["ordinal"].iloc[-1] > 1  # ordinals count all records
