"""Generator agents: the records of the same calls on a context, effects checked before they are staged."""

import pytest

from keyloom.streaming import fold, kernel, tools
from keyloom.streaming.authoring import Approve, Ask, Do, Emit, Forget, Keep, Look, Remember, StreamAgent, Wait, stepwise
from keyloom.streaming.kernel import Complete, Config, KeyState, Suspend
from keyloom.streaming.model import Response

T0 = 1_700_000_000_000
REGISTRY = tools.Registry()
REGISTRY.tool(lambda n: n + 1, name="look")
REGISTRY.tool(lambda n: n, name="pay", side_effect=True)


def plain(ctx):
    if ctx.is_resume:
        ctx.memory.delete("said")
        return Complete(f"{ctx.snapshot}:{ctx.resume['intent_id']}")
    said = ctx.call_model("m", [{"role": "user", "content": ctx.event}])
    ctx.memory.set("said", said.encode())
    ctx.memory.append("all", said.encode())
    n = ctx.run_tool("look", n=int(ctx.memory.get("n") or b"0"))
    ctx.memory.set("n", str(n).encode())
    ctx.emit(said)
    ctx.act("pay", {"n": n}, ttl_ms=5000)
    if ctx.event == "wait":
        ctx.request_approval({"why": said})
        return Suspend("snap", 4000)
    ctx.save("last", said)
    return Complete(str(n))


def yielded(view):
    if view.is_resume:
        yield Forget("said")
        yield Emit(f"{view.snapshot}:{view.resume['intent_id']}")
        return
    said = yield Ask("m", [{"role": "user", "content": view.event}])
    yield Remember("said", said.encode())
    yield Remember("all", said.encode(), append=True)
    n = yield Look("look", {"n": int(view.recall("n") or b"0")})
    yield Remember("n", str(n).encode())
    yield Emit(said)
    yield Do("pay", {"n": n}, ttl_ms=5000)
    if view.event == "wait":
        yield Approve({"why": said})
        yield Wait("snap", 4000)
        return
    yield Keep("last", said)
    yield Emit(str(n))


class Yielded(StreamAgent):
    def activate(self, view):
        yield from yielded(view)


def config(agent):
    return Config(agent=agent, provider=lambda r: Response("yes", 1, 2), tools=REGISTRY, metrics=False)


def event(i, payload):
    return {"entity_key": "6b", "event_time_ms": T0 + i, "arrival": i, "kind": "external_event", "external_event": payload}


def test_records_and_state_are_those_of_the_plain_form():
    events = [event(0, "a"), event(1, "wait"), event(9000, "b"), event(9001, "c")]
    want, state = fold.run_key(config(plain), "6b", events)
    for agent in (stepwise(yielded), Yielded()):
        got, other = fold.run_key(config(agent), "6b", events)
        assert got == want and other == state
    s = KeyState()
    intent = next(r["intent_id"] for r in kernel.on_envelope(config(stepwise(yielded)), "6b", s, event(0, "wait"), 0) if r["stream"] == "intents")
    answer = event(5, None) | {"kind": "approval", "approval": {"intent_id": intent}}
    rows = kernel.on_envelope(config(stepwise(yielded)), "6b", s, answer, 0)
    assert [r["payload"] for r in rows if r["stream"] == "output"] == [f"snap:{intent}"] and s.continuation is None


BAD = [
    Do("look", {}), Do("none", {}), Do("pay", {"n": float("nan")}), Do("pay", [1]), Do("pay", {"n": 1}, ttl_ms=0), Look("pay", {"n": 1}), Look("none"), Emit(5), Remember("k", "text"), Remember("", b""),
    Keep("k", b""), Approve({}, channel=""), Wait(), Ask("", []), Ask("m", ["x"]), "no effect", None,
]


@pytest.mark.parametrize("bad", BAD, ids=repr)
def test_what_is_not_allowed_changes_nothing(bad):
    def agent(view):
        yield Remember("k", b"v")
        yield Emit("early")
        yield bad

    state = KeyState()
    rows = kernel.on_envelope(config(stepwise(agent)), "6b", state, event(0, "x"), 0)
    assert state == KeyState() and {r["stream"] for r in rows} == {"errors", "traces"} and next(r for r in rows if r["stream"] == "errors")["reason"] == "activation_error"


def test_an_agent_may_catch_what_is_refused():
    def agent(view):
        try:
            yield Do("none", {})
        except LookupError as e:
            yield Emit(str(e))

    rows = kernel.on_envelope(config(stepwise(agent)), "6b", KeyState(), event(0, "x"), 0)
    assert [r["payload"] for r in rows if r["stream"] == "output"] == ["'none' is not among the tools"] and not [r for r in rows if r["stream"] == "intents"]


def test_waiting_comes_last_and_agents_yield():
    def late(view):
        yield Do("pay", {"n": 1})
        yield Wait()
        yield Emit("more")

    for agent in (stepwise(late), stepwise(lambda view: None), StreamAgent()):
        state = KeyState()
        rows = kernel.on_envelope(config(agent), "6b", state, event(0, "x"), 0)
        assert state == KeyState() and any(r["stream"] == "errors" for r in rows)


def test_a_view_changes_nothing():
    def agent(view):
        with pytest.raises(AttributeError):
            view.seq = 5
        assert not hasattr(view, "memory") and view.events == ("x",) and view.resume is None and view.ring("none") == []
        yield Emit(f"{view.key}{view.seq}{view.is_batch}")

    rows = kernel.on_envelope(config(stepwise(agent)), "6b", KeyState(), event(0, "x"), 0)
    assert [r["payload"] for r in rows if r["stream"] == "output"] == ["6b0False"]
