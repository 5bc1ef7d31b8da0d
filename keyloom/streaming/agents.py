"""Small deterministic agents, used by queries and tests."""

from __future__ import annotations

import json

from .authoring import Emit, Remember, StreamAgent
from .kernel import Complete, Context, Suspend


def counter(ctx: Context) -> Complete:
    """Counts its events and sums the numbers in them; outputs both."""
    n, total = int(ctx.memory.get("n") or b"0"), int(ctx.memory.get("sum") or b"0")
    for e in ctx.events:
        n, total = n + 1, total + int(json.loads(e)["k"])
    ctx.memory.set("n", str(n).encode())
    ctx.memory.set("sum", str(total).encode())
    return Complete(json.dumps({"n": n, "sum": total}))


def last_items(ctx: Context) -> Complete:
    for e in ctx.events:
        ctx.memory.append("last", str(e).encode())
    return Complete(str(len(ctx.memory.ring("last"))))


def buyer(ctx: Context) -> Complete | Suspend:
    """Asks for approval and waits; completes with the answer."""
    if ctx.is_resume:
        return Complete(f"resumed:{ctx.snapshot}:{ctx.resume['intent_id']}")
    ctx.request_approval({"event": ctx.event})
    return Suspend(snapshot=str(ctx.event), timeout_ms=3600_000)


def failing(ctx: Context) -> Complete:
    ctx.memory.set("never", b"kept")
    raise ValueError("no")


class Counting(StreamAgent):
    """``counter``, effect by effect."""

    def activate(self, view):
        n, total = int(view.recall("n") or b"0"), int(view.recall("sum") or b"0")
        for e in view.events:
            n, total = n + 1, total + int(json.loads(e)["k"])
        yield Remember("n", str(n).encode())
        yield Remember("sum", str(total).encode())
        yield Emit(json.dumps({"n": n, "sum": total}))
