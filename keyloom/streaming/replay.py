"""Replay of one activation from a state export, its trace and its envelope, and the comparison with what was traced.

The replay has no provider: model calls are served by the exported replay cache, and one that is not there makes
the activation irreproducible. Effects cannot happen, as they are only staged.

    python -m keyloom.streaming.replay --snapshot s.json --traces t.jsonl --envelope e.json --agent module:name

ends with 0 (reproduced), 1 (diverged), 2 (wrong use) or 3 (irreproducible).
"""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import importlib
import json
import sys
from collections.abc import Iterator

from . import kernel
from .kernel import Config, KeyState
from .memory import Memory, cache_key, migrate

REPRODUCED, DIVERGED, USAGE, IRREPRODUCIBLE = range(4)
#: A replayed call is always served from the cache, whatever the traced one was; how that was served is not compared.
PINNED = {"cache_hit": "true", "billed": "false"}
SERVED = ("attempts", "circuit_state")


class ReplayUsage(ValueError):
    pass


class Irreproducible(RuntimeError):
    pass


class _Missing(LookupError):
    pass


@dataclasses.dataclass(frozen=True)
class Bundle:
    key: str
    seq: int
    now_ms: int
    state: KeyState
    envelope: dict
    traced: list[dict]
    is_resume: bool


def load_state(snapshot: dict) -> KeyState:
    """The state in an export; blobs of older versions are migrated as copies, later ones raise."""
    state = KeyState.load(snapshot["raw"])
    state.memory, state.cache, state.continuation = migrate(state.memory), migrate(state.cache), migrate(state.continuation)
    return state


def attempts(events: list[dict]) -> list[list[dict]]:
    """Events of one sequence number, split at each start; a lone error is an attempt of its own."""
    out: list[list[dict]] = []
    for e in events:
        if e["event_type"] == "ACTIVATION_START" or not out:
            out.append([])
        out[-1].append(e)
    return out


def build(snapshot: dict, traces: list[dict], envelope: dict, seq: int | None = None) -> Bundle:
    key = snapshot["entity_key"]
    if envelope["entity_key"] != key:
        raise ReplayUsage(f"the envelope is of key {envelope['entity_key']}, the snapshot of {key}")
    own = [t for t in traces if t.get("entity_key", key) == key]
    if not own:
        raise ReplayUsage(f"no traced events of key {key}")
    seq = max(t["seq"] for t in own) if seq is None else seq
    own = [t for t in own if t["seq"] == seq]
    if not own:
        raise ReplayUsage(f"no traced events at seq {seq} of key {key}")
    is_resume = envelope["kind"] in ("tool_result", "approval")
    state = load_state(snapshot)
    if is_resume:
        if state.continuation is None:
            raise ReplayUsage("the envelope resumes, but the snapshot has no continuation")
        if envelope[envelope["kind"]]["intent_id"] not in state.continuation["pending_intent_ids"]:
            raise ReplayUsage("the envelope resumes an intent that the snapshot does not wait for")
    parts = attempts(own)
    wanted = [p for p in parts if p[0]["event_type"] == "ACTIVATION_START" and p[0]["attributes"].get("kind") == ("resume" if is_resume else "start")]
    traced = wanted[-1] if wanted else parts[-1]
    now_ms = next((t for t in traced if t["event_type"] == "ACTIVATION_START"), traced[0])["start_ms"]
    return Bundle(key, seq, now_ms, state, envelope, traced, is_resume)


def _chain(e: BaseException | None) -> Iterator[BaseException]:
    seen: set[int] = set()
    while e is not None and id(e) not in seen:
        seen.add(id(e))
        yield e
        e = e.__cause__ or e.__context__


def run(bundle: Bundle, config: Config) -> dict:
    """What the activation gives again: ``status, traces, intents, outputs, memory``."""

    def missing(request: dict):
        raise _Missing(cache_key(request["model"], request["messages"], request["tools"], request["params"], bundle.key, bundle.seq))

    config = dataclasses.replace(config, provider=missing, breaker=None, metrics=False)
    state = KeyState(**bundle.state.__dict__)  # an activation replaces its fields and changes none in place
    kw: dict = {"events": [bundle.envelope.get("external_event")]}
    if bundle.is_resume:
        cont = state.continuation
        kw = {"resume": dict(bundle.envelope[bundle.envelope["kind"]]) | {"kind": bundle.envelope["kind"]}, "snapshot": cont["snapshot"], "step": cont["step_index"]}
    ctx = kernel._context(config, bundle.key, state, bundle.seq, bundle.now_ms, **kw)
    try:
        rows = kernel._activate(config, bundle.key, state, ctx)
    except Exception as e:
        for cause in _chain(e):
            if isinstance(cause, _Missing):
                raise Irreproducible(f"the exported cache does not hold {cause}") from e
        error = kernel._error("activation_error", "", bundle.now_ms, bundle.key, bundle.seq, type(e).__name__, failure=kernel.failure_context(ctx))
        return {"status": "failed", "traces": error[1:], "intents": [], "outputs": [], "memory": Memory().dump()}
    of = lambda stream: [r for r in rows if r["stream"] == stream]
    return {"status": of("traces")[-1]["attributes"]["status"], "traces": of("traces"), "intents": of("intents"), "outputs": [r["payload"] for r in of("output")], "memory": state.memory}


_COMPARED = ("event_type", "step_index", "start_ms", "trace_id", "span_id", "parent_span_id")


def _pinned(event: dict) -> dict:
    attributes = dict(event["attributes"])
    if event["event_type"] == "LLM_CALL":
        attributes = {k: v for k, v in attributes.items() if k not in SERVED} | PINNED
    return {n: event.get(n) for n in _COMPARED} | {f"attribute {k}": v for k, v in attributes.items()}


def compare(bundle: Bundle, outcome: dict) -> list[tuple[str, str]]:
    """Differences ``(kind, detail)``: status, count of events, the first event that differs, and intents by place."""
    out = []
    kinds = [t["event_type"] for t in bundle.traced]
    ended = next((t["attributes"].get("status", "") for t in bundle.traced if t["event_type"] == "ACTIVATION_END"), "")
    status = "failed" if "ERROR" in kinds else ended
    if status and status != outcome["status"]:
        out.append(("status", f"traced {status!r}, replayed {outcome['status']!r}"))
    if len(bundle.traced) != len(outcome["traces"]):
        out.append(("trace_event", f"traced {len(bundle.traced)} events, replayed {len(outcome['traces'])}"))
    for k, (x, y) in enumerate(zip(bundle.traced, outcome["traces"], strict=False)):
        if x != y and (a := _pinned(x)) != (b := _pinned(y)):
            parts = [f"{n}: traced {a.get(n)!r}, replayed {b.get(n)!r}" for n in sorted(a.keys() | b.keys()) if a.get(n) != b.get(n)]
            out.append(("trace_event", f"first difference at {k} ({a['event_type']}): " + "; ".join(parts)))
            break
    names = ("intent_id", "tool_name", "intent_kind", "expires_at_ms")
    traced = [tuple(t["attributes"].get(n, "") for n in names) for t in bundle.traced if t["event_type"] == "INTENT_EMITTED"]
    again = [(i["intent_id"], i["tool_name"], i["kind"], str(i["expires_at_ms"])) for i in outcome["intents"]]
    if len(traced) != len(again):
        out.append(("intent", f"traced {len(traced)} intents, replayed {len(again)}"))
    else:
        for k, (a, b) in enumerate(zip(traced, again, strict=True)):
            if a != b:
                out.append(("intent", f"intent {k}: " + "; ".join(f"{n}: traced {x!r}, replayed {y!r}" for n, x, y in zip(names, a, b, strict=True) if x != y)))
    return out


def notes(outcome: dict) -> list[str]:
    """Digests of what has no traced counterpart."""
    digest = lambda b: f"{len(b)} bytes, sha256={hashlib.sha256(b).hexdigest()}"
    lines = [f"output {i}: {digest(o.encode())}" for i, o in enumerate(outcome["outputs"])] or ["no output"]
    return [*lines, f"memory: {digest(json.dumps(outcome['memory'], sort_keys=True).encode())}"]


def _named(path: str):
    module, _, name = path.partition(":")
    if not module or not name:
        raise ReplayUsage(f"{path!r} is not module:name")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ReplayUsage(str(e)) from e


def _json(path: str, lines: bool = False):
    try:
        with open(path, encoding="utf-8") as f:
            return [json.loads(x) for x in f if x.strip()] if lines else json.load(f)
    except (OSError, ValueError) as e:
        raise ReplayUsage(f"{path}: {e}") from e


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="replay", exit_on_error=False)
    for n in ("snapshot", "traces", "envelope", "agent"):
        p.add_argument(f"--{n}", required=True)
    p.add_argument("--seq", type=int)
    try:
        args = p.parse_args(argv)
        agent = _named(args.agent)
        config = agent if isinstance(agent, Config) else Config(agent=agent)
        bundle = build(_json(args.snapshot), _json(args.traces, lines=True), _json(args.envelope), args.seq)
    except SystemExit:
        return USAGE
    except (argparse.ArgumentError, ReplayUsage, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    print(f"agent {args.agent}, key {bundle.key}, seq {bundle.seq}, now_ms {bundle.now_ms}, {'resume' if bundle.is_resume else 'start'}")
    try:
        outcome = run(bundle, config)
    except Irreproducible as e:
        print(f"error: {e}", file=sys.stderr)
        return IRREPRODUCIBLE
    found = compare(bundle, outcome)
    print("\n".join(["diverged" if found else "reproduced", *(f"  {n}" for n in notes(outcome)), *(f"  {k}: {d}" for k, d in found)]))
    return DIVERGED if found else REPRODUCED


if __name__ == "__main__":
    sys.exit(main())
