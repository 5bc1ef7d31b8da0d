"""Both clocks scripted: timers fire in the batch of their step, in order, and nothing waits."""

import pytest

from keyloom.streaming import agents, kernel, scripted
from keyloom.streaming.kernel import Batching, Complete, Config, KeyState, Suspend
from keyloom.streaming.scripted import FOREVER, Script


def event(key, t, payload="x"):
    return {"entity_key": key, "event_time_ms": t, "external_event": payload}


def triage(ctx):
    if ctx.is_resume:
        return Complete(f"freeze:{ctx.key}")
    ctx.request_approval({"action": "freeze"})
    return Suspend("awaiting", timeout_ms=30_000)


def batches(spark, script, config, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    out = scripted.run(spark, script, config, str(tmp_path / "script"))
    out.writeStream.foreachBatch(lambda df, n: got.append((n, sorted((r.entity_key, r.ordinal, r.stream, r.payload or r.reason or r.event_type) for r in df.collect())))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    return dict(got)


def said(rows):
    return [(key, what) for key, _, stream, what in rows if stream in ("output", "errors")]


def test_one_approval_in_time_and_one_deadline_that_passes(spark, tmp_path):
    config = Config(agent=triage)
    asked = next(r["intent_id"] for r in kernel.on_envelope(config, "a", KeyState(), {"kind": "external_event", "arrival": 1} | event("a", 1000), 0) if r["stream"] == "intents")
    approval = {"entity_key": "a", "event_time_ms": 5000, "kind": "approval", "approval": {"intent_id": asked, "approved": True, "approver": "x", "decided_at_ms": 5000}}
    script = Script().add(event("a", 1000)).add(event("b", 2000)).add(approval).clock(20_000).clock(40_000).watermark(FOREVER)
    got = batches(spark, script, config, tmp_path)
    assert [said(got[n]) for n in sorted(got)] == [[], [], [("a", "freeze:a")], [], [("b", "__hitl_timeout__")], []]


def test_flushes_and_expiry_follow_their_own_clocks(spark, tmp_path):
    config = Config(agent=agents.counter, ttl_ms=10_000, batching=Batching(max_batch_size=10, max_wait_ms=500))
    number = lambda key, t: event(key, t, '{"k": 1}')
    script = Script().add(number("a", 100), number("a", 200)).clock(499).watermark(9_000).clock(1).add(number("b", 300)).watermark(10_300).clock(10_000)
    got = batches(spark, script, config, tmp_path)
    assert [said(got[n]) for n in sorted(got)] == [[], [], [], [("a", '{"n": 2, "sum": 2}')], [], [("b", "ttl_wiped_batch")], []]


def test_clocks_do_not_go_back():
    with pytest.raises(ValueError):
        Script().watermark(5).watermark(4)
    with pytest.raises(ValueError):
        Script().clock(-1)
    assert Script().clock(5).steps == [[]]
