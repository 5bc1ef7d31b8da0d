"""The state machine of one key, driven by scripted envelopes with explicit times."""

import asyncio
import collections
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.streaming import agents, fold, kernel, tools
from keyloom.streaming.kernel import Batching, Complete, Config, Deny, Drop, Escalate, KeyState, Suspend, TimeoutPolicy
from keyloom.streaming.memory import FutureVersion, Memory, MemoryOverflow, ReplayCache, migrate
from keyloom.streaming.model import CircuitBreaker, CircuitOpen, ProviderError, Response, RetryPolicy, ScriptedModel, TokenBudget, WorkerBreaker

T0 = 1_700_000_000_000


def ev(t, payload='{"k": 1}', arrival=0, **kw):
    return {"event_time_ms": T0 + t, "arrival": arrival, "kind": "external_event", "external_event": payload} | kw


def answer(t, intent, kind="approval"):
    return {"event_time_ms": T0 + t, "arrival": 0, "kind": kind, kind: {"intent_id": intent}}


def of(rows, stream):
    return [r for r in rows if r["stream"] == stream]


def test_counter_keeps_state():
    rows, state = fold.run_key(Config(agent=agents.counter), "6b", [ev(1), ev(2, '{"k": 5}'), ev(3)])
    assert [json.loads(r["payload"]) for r in of(rows, "output")] == [{"n": 1, "sum": 1}, {"n": 2, "sum": 6}, {"n": 3, "sum": 7}]
    assert state.seq == 3 and [t["event_type"] for t in of(rows, "traces")][:2] == ["ACTIVATION_START", "ACTIVATION_END"]


def test_suspend_resume_and_admission():
    c, s = Config(agent=agents.buyer), KeyState()
    rows = kernel.on_envelope(c, "6b", s, ev(0, "x"), 0)
    (intent,) = of(rows, "intents")
    assert intent["intent_id"] == kernel.intent_id("6b", 0, 1) and s.continuation["deadline_ms"] == T0 + 3600_000
    assert of(kernel.on_envelope(c, "6b", s, answer(1, "other"), 0), "errors")[0]["detail"] == "unknown_intent:other"
    assert of(kernel.on_envelope(c, "6b", s, answer(3600_000, intent["intent_id"]), 0), "errors")[0]["detail"].startswith("deadline_passed")
    rows = kernel.on_envelope(c, "6b", s, answer(10, intent["intent_id"]), 0)
    assert of(rows, "output")[0]["payload"] == f"resumed:x:{intent['intent_id']}" and s.continuation is None
    assert {t["seq"] for t in of(rows, "traces")} == {0} and s.seq == 2
    assert of(kernel.on_envelope(c, "6b", s, answer(11, intent["intent_id"]), 0), "errors")[0]["detail"].startswith("no_continuation")


@pytest.mark.parametrize(("route", "stream"), [(Deny("no"), "output"), (Drop(), "errors")])
def test_timeout_routes(route, stream):
    c = Config(agent=agents.buyer, policy=TimeoutPolicy(on_timeout=lambda f: route))
    rows, state = fold.run_key(c, "6b", [ev(0)], end_ms=T0 + 3600_000)
    assert of(rows, stream) and state.continuation is None and of(rows, "traces")[-1]["attributes"]["reason"] == "hitl_timeout"


def test_escalation_is_bounded_and_fails_closed():
    c = Config(agent=agents.buyer, ttl_ms=10**12, policy=TimeoutPolicy(max_escalations=2, on_timeout=lambda f: Escalate("pager", timeout_ms=1000)))
    rows, state = fold.run_key(c, "6b", [ev(0)], end_ms=T0 + 10**9)
    assert len(of(rows, "intents")) == 3 and of(rows, "output")[-1]["payload"] == kernel.TIMEOUT_OUTPUT and state.continuation is None
    bad = Config(agent=agents.buyer, policy=TimeoutPolicy(on_timeout=lambda f: 1 / 0))
    rows, _ = fold.run_key(bad, "6b", [ev(0)], end_ms=T0 + 3600_000)
    assert "policy_error" in of(rows, "errors")[0]["detail"]


def test_expiry_reports_what_is_lost():
    rows, state = fold.run_key(Config(agent=agents.buyer, ttl_ms=5, policy=TimeoutPolicy(on_timeout=lambda f: Deny())), "6b", [ev(0)], end_ms=T0 + 3600_005)
    assert state == KeyState()
    s = KeyState()
    kernel.on_envelope(Config(agent=agents.buyer), "6b", s, ev(0), 0)
    lost = kernel.on_ttl(Config(agent=agents.buyer, on_expire=lambda k, m: {"size": str(m.size)}), "6b", s, T0 + 9)
    assert of(lost, "errors")[0]["reason"] == "ttl_wiped_suspension" and of(lost, "saves") and s == KeyState()


def test_failure_leaves_state_and_retry_is_equal():
    s = KeyState()
    rows = kernel.on_envelope(Config(agent=agents.failing), "6b", s, ev(0), 0)
    assert s == KeyState() and of(rows, "errors")[0]["reason"] == "activation_error"
    again = kernel.on_envelope(Config(agent=agents.failing), "6b", KeyState(), ev(0), 99)
    assert rows == again

    def slow(ctx):
        raise TimeoutError

    # an agent's own TimeoutError is its failure; the time limit is tested below
    assert of(kernel.on_envelope(Config(agent=slow), "6b", s, ev(0), 0), "errors")[0]["reason"] == "activation_error"


def test_batching():
    c = Config(agent=agents.counter, batching=Batching(3, 500, 4))
    rows, state = fold.run_key(c, "6b", [ev(i, arrival=i) for i in range(4)])
    assert len(of(rows, "output")) == 1 and len(state.batch) == 1
    rows, state = fold.run_key(c, "6b", [ev(0)], end_ms=T0 + 500)
    assert len(of(rows, "output")) == 1 and not state.batch
    bad = Config(agent=agents.failing, batching=Batching(2, 500))
    rows, state = fold.run_key(bad, "6b", [ev(0), ev(1)])
    assert len(of(rows, "errors")) == 2 and not state.batch and state.seq == 0 and "trigger=size" in rows[0]["detail"]
    full = KeyState(continuation={"v": 1, "seq": 0, "step_index": 1, "snapshot": "", "deadline_ms": T0 + 9, "escalations": 0, "pending_intent_ids": []})
    got = [kernel.on_envelope(c, "6b", full, ev(i), 0) for i in range(5)]
    assert len(full.batch) == 4 and got[-1][0]["reason"] == "batch_buffer_overflow"
    for kw in ({"max_batch_size": 0}, {"max_wait_ms": 0}, {"max_batch_size": 5, "max_buffered_events": 4}):
        with pytest.raises(ValueError):
            Batching(**kw)


def test_state_export_changes_nothing():
    s = KeyState()
    kernel.on_envelope(Config(agent=agents.buyer), "6b", s, ev(0), 0)
    before = s.dump()
    (row,) = kernel.on_envelope(Config(agent=agents.buyer), "6b", s, {"event_time_ms": T0, "arrival": 0, "kind": "export_request", "export_request": {"request_id": "r"}}, 0)
    assert s.dump() == before == row["raw"] and row["continuation_step_index"] == 2 and KeyState.load(before) == s
    with pytest.raises(FutureVersion):
        migrate({"v": 99})
    assert migrate({"v": 0})["v"] == 1 and migrate(None) is None


def test_model_calls_are_cached_retried_charged():
    calls = []

    def flaky(request):
        calls.append(request)
        if len(calls) == 1:
            raise ProviderError("busy")
        return ScriptedModel([("", "two words")])(request)

    def agent(ctx):
        return Complete(ctx.call_model("m", [{"role": "user", "content": "a b c"}]))

    c, s = Config(agent=agent, provider=flaky), KeyState()
    rows = kernel.on_envelope(c, "6b", s, ev(0), 0)
    a = of(rows, "traces")[1]["attributes"]
    assert (a["attempts"], a["cache_hit"], a["input_tokens"], a["output_tokens"]) == ("2", "false", "3", "2") and len(calls) == 2
    tight = Config(agent=lambda ctx: Complete(ctx.call_model("m", [{"content": "x y z"}]) + ctx.call_model("m", [{"content": "again"}])), provider=ScriptedModel([("", "w")]), token_budget=3)
    assert of(kernel.on_envelope(tight, "6b", KeyState(), ev(0), 0), "errors")[0]["reason"] == "budget_exceeded"
    b = TokenBudget(3)
    b.charge(3)
    b.check()


def test_breaker_and_provider():
    b = CircuitBreaker(2, 100)
    b.record(False, 0)
    b.record(False, 0)
    with pytest.raises(CircuitOpen):
        b.check(50)
    assert b.state(100) == "half_open"
    b.record(True, 100)
    assert b.state(100) == "closed"
    with pytest.raises(LookupError):
        ScriptedModel([("q", "a")])({"messages": [{"content": "z"}]})


def test_half_open_lets_one_call_through():
    b = CircuitBreaker(1, 100)
    b.record(False, 0)
    b.check(100)
    with pytest.raises(CircuitOpen):
        b.check(100)
    b.abandon()  # the trial said nothing: another may try
    b.check(100)
    b.record(False, 100)
    assert b.state(150) == "open" and b.state(200) == "half_open"


def test_a_worker_keeps_its_breakers():
    now, calls = [0], []

    def down(request):
        calls.append(request["model"])
        raise ProviderError("down")

    def asks(ctx):
        return Complete(ctx.call_model(ctx.event, [{"role": "user", "content": "x"}]))

    def config():  # as each task unpickles one anew
        return Config(agent=asks, provider=down, retry=RetryPolicy(attempts=1), breaker=WorkerBreaker(2, 100, scope="test", clock=lambda: now[0]))

    def run(n, model):
        rows = kernel.on_envelope(config(), "6b", KeyState(), {"event_time_ms": n, "kind": "external_event", "external_event": model}, 0)
        return [r["detail"] for r in rows if r["stream"] == "errors"]

    run(1, "m"), run(2, "m")
    assert calls == ["m", "m"]
    assert "circuit" in run(3, "m")[0] and calls == ["m", "m"]  # open, for every later task and batch
    run(4, "other")
    assert calls == ["m", "m", "other"]  # a breaker for each model
    now[0] = 100
    run(5, "m"), run(6, "m")
    assert calls == ["m", "m", "other", "m"]  # one trial, which failed


def test_tools_with_effects_are_not_called():
    def pay():
        return 1

    pay.side_effect = True
    rows = kernel.on_envelope(Config(agent=lambda ctx: Complete(str(ctx.run_tool("pay"))), tools={"pay": pay}), "6b", KeyState(), ev(0), 0)
    assert "side effects" in of(rows, "errors")[0]["detail"]
    rows = kernel.on_envelope(Config(agent=lambda ctx: Complete(str(ctx.run_tool("add", a=1, b=2))), tools={"add": lambda a, b: a + b}), "6b", KeyState(), ev(0), 0)
    assert of(rows, "output")[0]["payload"] == "3"
    rows = kernel.on_envelope(Config(agent=lambda ctx: 5), "6b", KeyState(), ev(0), 0)
    assert "Complete or Suspend" in of(rows, "errors")[0]["detail"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sgda"), st.sampled_from(["a", "b", "c"]), st.binary(max_size=30)), max_size=40))
def test_memory_accounting_is_exact(ops):
    m = Memory(cap=10_000)
    for op, key, value in ops:
        try:
            if op == "s":
                m.set(key, value)
            elif op == "g":
                m.get(key)
            elif op == "d":
                m.delete(key)
            else:
                m.append(key, value, 3)
        except TypeError:
            pass
    assert m.size == sum(Memory._cost(k, v) for k, v in m.items.items())
    assert Memory.load(m.dump(), 10_000).dump() == m.dump()


def test_memory_limits_and_compaction():
    m = Memory(cap=100, protected=("keep/",))
    m.set("keep/x", b"1" * 20)
    m.set("a", b"2" * 30)
    m.set("b", b"3" * 30)  # crosses the soft cap of 75: the oldest goes
    assert m.crossed_soft_cap and list(m.items) == ["keep/x", "b"] and m.size == 50
    m.set("c", b"4" * 30)  # once only
    assert m.size == 80
    m.set("d", b"5" * 25)  # beyond the cap: compaction, then the write
    assert list(m.items) == ["keep/x", "c", "d"] and m.size == 75
    with pytest.raises(MemoryOverflow):
        m.set("e", b"6" * 90)  # protected keys stay, so it does not fit
    assert list(m.items) == ["keep/x", "d"]
    r = Memory()
    for i in range(70):
        r.append("r", bytes([i]))
    assert len(r.ring("r")) == 64
    r.append("r", b"x", max_items=0)
    assert r.ring("r") == [] and r.size == 0
    with pytest.raises(TypeError):
        r.get("r")
    r.set("r", b"scalar")
    with pytest.raises(TypeError):
        r.append("r", b"x")
    near = Memory(cap=10)
    near.crossed_soft_cap = True
    near.append("r", b"12345", 2)
    near.append("r", b"123", 2)
    near.append("r", b"1234567", 2)  # trimmed before it is measured
    assert near.ring("r") == [b"123", b"1234567"]


def test_a_hung_agent_times_out():
    """A function that stops when asked, one that does not, and a coroutine: the state stays, and later calls work."""
    seen = []

    def polite(ctx):
        ctx.memory.set("x", b"1")
        ctx.cancelled.wait(5)
        seen.append("stopped")

    async def endless(ctx):
        try:
            await asyncio.sleep(5)
        except asyncio.CancelledError:
            seen.append("cancelled")
            raise

    async def fine(ctx):
        await asyncio.sleep(0)
        return Complete("async")

    for agent in (polite, lambda ctx: time.sleep(1), endless):
        state = KeyState()
        rows = kernel.on_envelope(Config(agent=agent, timeout_ms=50, cancel_grace_ms=200), "6b", state, ev(0), 0)
        assert [r["reason"] for r in of(rows, "errors")] == ["activation_timeout"] and state == KeyState()
    assert seen == ["stopped", "cancelled"]
    for limit in (50, None):
        assert of(kernel.on_envelope(Config(agent=fine, timeout_ms=limit), "6b", KeyState(), ev(0), 0), "output")[0]["payload"] == "async"


def test_retries_wait_before_the_next_call():
    waits = []

    def provider(request):
        if len(waits) < 2:
            raise ProviderError("busy", retry_after_ms=700 if waits else 0)
        return Response("ok", 1, 2)

    c = Config(agent=lambda ctx: Complete(ctx.call_model("m", [])), provider=provider, sleep=waits.append, retry=RetryPolicy(attempts=3, base_ms=100, max_ms=150))
    rows = kernel.on_envelope(c, "6b", KeyState(), ev(0), 0)
    assert of(rows, "output")[0]["payload"] == "ok"
    assert 0 <= waits[0] <= 0.1 and waits[1] == 0.7
    waits.clear()
    rows = kernel.on_envelope(Config(agent=c.agent, provider=provider, sleep=lambda s: None, retry=RetryPolicy(attempts=2)), "6b", KeyState(), ev(0), 0)
    assert of(rows, "errors")[0]["reason"] == "activation_error"


def test_a_failure_says_where_it_was():
    def agent(ctx):
        ctx.act("pay", {})
        ctx.call_model("m", [])
        raise ValueError("no")

    rows = kernel.on_envelope(Config(agent=agent, provider=lambda r: Response("x")), "6b", KeyState(), ev(0), 0)
    assert of(rows, "errors")[0]["detail"] == "ValueError('no') failed_at_step=2 after=LLM_CALL"
    assert of(rows, "traces")[0]["attributes"] == {"reason": "activation_error", "error_type": "ValueError", "failure_step": "2", "failure_last_event": "LLM_CALL", "failure_staged_intents": "1", "failure_llm_calls": "1"}


def test_answers_and_arguments_are_checked():
    registry = tools.Registry()

    @registry.tool
    def look(name: str, n: int = 1) -> str:
        return name * n

    @registry.tool(side_effect=True)
    def pay(amount: float) -> str:
        return f"paid {amount}"

    assert look.schema == {"type": "object", "properties": {"name": {"type": "string"}, "n": {"type": "integer"}}, "required": ["name"], "additionalProperties": False}
    with pytest.raises(ValueError):
        registry.tool(lambda: None, name="look")
    with pytest.raises(TypeError):
        pay(amount=1.0)
    assert pay.execute({"amount": 2.5}) == "paid 2.5"
    for bad in ({}, {"name": 1}, {"name": "a", "n": True}, {"name": "a", "x": 1}):
        with pytest.raises(ValueError):
            look(**bad)

    def agent(ctx):
        return Complete(ctx.run_tool("look", name="a", n=3) + ctx.call_model("m", [], schema={"type": "object", "properties": {"score": {"type": "integer", "enum": [1, 2]}}, "required": ["score"]}))

    for answer, ok in (('{"score": 2}', True), ('{"score": 3}', False), ("not json", False)):
        rows = kernel.on_envelope(Config(agent=agent, provider=lambda r, a=answer: Response(a), tools=registry), "6b", KeyState(), ev(0), 0)
        assert bool(of(rows, "output")) == ok and bool(of(rows, "errors")) != ok


def test_old_items_become_a_summary():
    def agent(ctx):
        for i in range(20):
            ctx.memory.append("log", b"item %02d" % i)
        return Complete()

    asked = []
    summarise = kernel.Summarise(("log", "none"), lambda items, prior: (asked.append((len(items), prior)) or "m", []), keep_recent=4, trigger_bytes=100)
    c = Config(agent=agent, provider=lambda r: Response("short"), summarise=summarise)
    state = KeyState()
    rows = kernel.on_envelope(c, "6b", state, ev(0), 0)
    memory = Memory.load(state.memory)
    assert memory.ring("log") == [b"item %02d" % i for i in range(16, 20)] and memory.get("summary") == b"short" and asked == [(16, None)]
    assert [t["event_type"] for t in of(rows, "traces")] == ["ACTIVATION_START", "LLM_CALL", "ACTIVATION_END"]
    rows = kernel.on_envelope(Config(agent=agent, provider=lambda r: Response("long" * 99), summarise=summarise), "6b", KeyState(), ev(0), 0)
    assert "no smaller" in of(rows, "errors")[0]["detail"]
    with pytest.raises(ValueError):
        kernel.Summarise(("summary",), lambda i, p: ("m", []))


def test_metrics_agree_with_the_records():
    """Counters equal the records they count, over starts, suspensions, failures, orphans, batches and timers."""

    def agent(ctx):
        e = ctx.event
        if ctx.is_resume:
            return Complete("resumed")
        if e == "fail":
            raise ValueError(e)
        if e == "wait":
            ctx.request_approval()
            return Suspend(timeout_ms=100)
        ctx.call_model("m", [{"role": "user", "content": str(e)}])
        ctx.run_tool("t")
        ctx.save("n", "v")
        return Complete("ok")

    c = Config(agent=agent, provider=lambda r: Response("x", 3, 4), tools={"t": lambda: 1}, metrics=True)
    events = [ev(i, e) for i, e in enumerate(["a", "fail", "wait", "b"])] + [answer(4, "nobody")]
    rows, _ = fold.run_key(c, "6b", [dict(e, arrival=i) for i, e in enumerate(events)], end_ms=T0 + 1000)
    counters, samples = collections.Counter(), collections.defaultdict(list)
    for r in of(rows, "metrics"):
        counters.update(r["counters"])
        for k, v in r["samples"].items():
            samples[k] += v
    traces = collections.Counter(t["event_type"] for t in of(rows, "traces"))
    errors = of(rows, "errors")
    assert counters["activations"] == traces["ACTIVATION_END"] == 3 and counters["suspensions"] == traces["SUSPENDED"] == 1
    assert counters["intents_emitted"] == len(of(rows, "intents")) == 1 and counters["longterm_upserts"] == len(of(rows, "saves")) == 2
    assert counters["agent_errors"] + counters["orphaned_results"] == len(errors) == 2 and counters["orphaned_results"] == 1
    assert counters["llm_calls"] == len(samples["llm_ms"]) == 2 and counters["tool_calls"] == 2
    assert samples["tokens"] == [7, 7] and samples["prompt_tokens"] == [3, 3] and samples["completion_tokens"] == [4, 4]
    assert len(samples["activation_ms"]) == 4 and len(samples["overhead_ms"]) == len(samples["memory_bytes"]) == 3 and samples["iterations"] == [1, 1, 1]
    b = Config(agent=lambda ctx: Complete(), batching=Batching(2, 10), metrics=True)
    rows, _ = fold.run_key(b, "6b", [dict(ev(i), arrival=i) for i in range(3)], end_ms=T0 + 1000)
    counters = collections.Counter()
    for r in of(rows, "metrics"):
        counters.update(r["counters"])
    assert dict(counters) == {"events_buffered": 3, "activations": 2, "batch_flushes_size": 1, "batch_flushes_timer": 1}
    assert not of(fold.run_key(Config(agent=lambda ctx: Complete()), "6b", [dict(ev(0), arrival=0)])[0], "metrics")


def test_replay_cache_bounds():
    c = ReplayCache(entries=2, size=200, ttl_ms=10)
    c.put("a", "1", 0)
    assert c.get("a", 10) == "1" and c.get("a", 11) is None
    for k in "xyz":
        c.put(k, k, 0)
    assert list(c.rows) == ["y", "z"]
    c.put("big", "b" * 300, 0)
    assert c.get("big", 0) is None and c.rows["big"]["digest"]
    assert ReplayCache.load(c.dump()).dump() == c.dump()


def test_agents_waiting_for_nothing():
    rows, _ = fold.run_key(Config(agent=lambda ctx: Suspend("s", timeout_ms=5)), "6b", [ev(0)], end_ms=T0 + 5)
    assert of(rows, "output")[0]["payload"] == kernel.TIMEOUT_OUTPUT


def test_waits_of_keys_overlap(spark):
    import time

    def waits(ctx):
        if ctx.event == "wait":
            ctx.cancelled.wait(30)
        ctx.emit(f"{ctx.key}-{ctx.event}")
        return Complete(str(ctx.seq))

    rows = [(f"k{k:02}", 10 * i, i, "external_event", "wait" if i == 1 else str(i)) for k in range(24) for i in range(4)]
    table = spark.createDataFrame(rows, "entity_key string, event_time_ms bigint, arrival bigint, kind string, external_event string").coalesce(1)
    config = Config(agent=waits, ttl_ms=10**13, timeout_ms=500, cancel_grace_ms=2000)
    began = time.monotonic()
    got = [fold.run_agent(table, config, overlap=n).orderBy("entity_key", "ordinal").collect() for n in (24, 1)]
    took = time.monotonic() - began
    assert got[0] == got[1] and sum(r.reason == "activation_timeout" for r in got[0]) == 24
    began = time.monotonic()
    some = fold.run_agent(table, config, streams=("output",), overlap=24).orderBy("entity_key", "ordinal").collect()
    assert some == [r for r in got[0] if r.stream == "output"] and time.monotonic() - began < took / 2


def test_ids_are_those_of_uuid5():
    import uuid

    for key, seq in (("k", 0), ("schlüssel", 12)):
        assert kernel.trace_id(key, seq) == uuid.uuid5(kernel.TRACE_NAMESPACE, f"{key}|{seq}").hex
        assert kernel.span_id(key, seq, "ERROR", 3) == uuid.uuid5(kernel.TRACE_NAMESPACE, f"{key}|{seq}|ERROR|3").hex[:16]
        assert kernel.intent_id(key, seq, 2) == str(uuid.uuid5(kernel.INTENT_NAMESPACE, f"{key}|{seq}|2"))
