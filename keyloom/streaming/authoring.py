"""A second way to write an agent: a generator that yields its effects one by one.

    def triage(view):
        said = yield Ask("m", [{"role": "user", "content": view.event}])
        yield Remember("last", said.encode())
        if said == "risky":
            yield Approve({"event": view.event})
            yield Wait("asked")
        else:
            yield Emit(said)

    Config(agent=stepwise(triage))

Each effect is checked when it is yielded, before it is staged, and its value is sent back. An effect that isn't allowed is raised
in the agent at that place; if the agent doesn't catch it, the activation fails as a whole. Nothing counts before the generator has
ended: the kernel commits all or nothing, as for ``agent(ctx)``, and the records are those that the same calls on a context give.
What an agent sees is a view without any way to change something beside its effects. A generator runs once: an agent cannot be
drained twice.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from typing import Any

from .kernel import Complete, Context, Suspend


class Effect:
    """Something an agent wants done."""

    def check(self, ctx: Context) -> None:
        """Raise if it isn't allowed; nothing has been done by then."""

    def stage(self, ctx: Context) -> Any:
        """Do it within the activation; what the agent gets for it."""


def _arguments(args: Any) -> None:
    if not isinstance(args, dict) or not all(isinstance(k, str) for k in args):
        raise TypeError(f"arguments have names: {args!r}")
    json.dumps(args, allow_nan=False)  # raises for what an intent can't carry


@dataclass(frozen=True)
class Ask(Effect):
    """A model call; the answer's text."""

    model: str
    messages: list[dict]
    tools: list | None = None
    schema: dict | None = None
    params: dict = field(default_factory=dict)

    def check(self, ctx: Context) -> None:
        if not self.model or not all(isinstance(m, dict) and "content" in m for m in self.messages):
            raise ValueError("a call names a model and has messages with content")

    def stage(self, ctx: Context) -> str:
        return ctx.call_model(self.model, self.messages, self.tools, self.schema, **self.params)


@dataclass(frozen=True)
class Look(Effect):
    """A tool that only reads; its value."""

    tool: str
    args: dict = field(default_factory=dict)

    def check(self, ctx: Context) -> None:
        _arguments(self.args)
        if self.tool not in ctx.config.tools:
            raise LookupError(f"{self.tool!r} is not among the tools")
        if getattr(ctx.config.tools[self.tool], "side_effect", False):
            raise TypeError(f"{self.tool!r} has side effects: yield Do for it")

    def stage(self, ctx: Context) -> Any:
        return ctx.run_tool(self.tool, **self.args)


@dataclass(frozen=True)
class Do(Effect):
    """A tool with side effects, staged as an intent; the intent's id. The tool must be known to have side effects."""

    tool: str
    args: dict = field(default_factory=dict)
    ttl_ms: int | None = None

    def check(self, ctx: Context) -> None:
        _arguments(self.args)
        _positive(self.ttl_ms)
        if self.tool not in ctx.config.tools:
            raise LookupError(f"{self.tool!r} is not among the tools")
        if not getattr(ctx.config.tools[self.tool], "side_effect", False):
            raise TypeError(f"{self.tool!r} only reads: yield Look for it")

    def stage(self, ctx: Context) -> str:
        return ctx.act(self.tool, self.args, ttl_ms=self.ttl_ms)


@dataclass(frozen=True)
class Approve(Effect):
    """A request for approval; its id. ``channel``: another one than the policy's."""

    args: dict = field(default_factory=dict)
    channel: str | None = None
    ttl_ms: int | None = None

    def check(self, ctx: Context) -> None:
        _arguments(self.args)
        _positive(self.ttl_ms)
        if self.channel == "":
            raise ValueError("a channel has a name")

    def stage(self, ctx: Context) -> str:
        return ctx.act(self.channel or ctx.config.policy.approval_channel, self.args, kind="APPROVAL", ttl_ms=self.ttl_ms)


@dataclass(frozen=True)
class Remember(Effect):
    """A value in working memory; ``append`` adds it to the key's ring."""

    key: str
    value: bytes
    append: bool = False

    def check(self, ctx: Context) -> None:
        if not isinstance(self.value, bytes) or not self.key:
            raise TypeError("memory holds bytes under a name")

    def stage(self, ctx: Context) -> None:
        (ctx.memory.append if self.append else ctx.memory.set)(self.key, self.value)


@dataclass(frozen=True)
class Forget(Effect):
    key: str

    def stage(self, ctx: Context) -> None:
        ctx.memory.delete(self.key)


@dataclass(frozen=True)
class Keep(Effect):
    """A value in long-term memory."""

    name: str
    value: str

    def check(self, ctx: Context) -> None:
        if not isinstance(self.value, str) or not self.name:
            raise TypeError("long-term memory holds text under a name")

    def stage(self, ctx: Context) -> None:
        ctx.save(self.name, self.value)


@dataclass(frozen=True)
class Emit(Effect):
    """An output, in the order of emission."""

    output: str

    def check(self, ctx: Context) -> None:
        if not isinstance(self.output, str):
            raise TypeError(f"outputs are text: {self.output!r}")

    def stage(self, ctx: Context) -> None:
        ctx.emit(self.output)


@dataclass(frozen=True)
class Wait(Effect):
    """Suspend until an intent's result: the last effect of an activation, which must have staged an intent."""

    snapshot: str = ""
    timeout_ms: int | None = None

    def check(self, ctx: Context) -> None:
        _positive(self.timeout_ms)
        if not ctx.intents:
            raise ValueError("nothing is staged that could be waited for")


def _positive(ms: int | None) -> None:
    if ms is not None and ms <= 0:
        raise ValueError(f"a time span is positive, not {ms}")


class View:
    """What a generator agent sees of its activation."""

    def __init__(self, ctx: Context):
        self._ctx = ctx

    key = property(lambda self: self._ctx.key)
    seq = property(lambda self: self._ctx.seq)
    now_ms = property(lambda self: self._ctx.now_ms)
    event = property(lambda self: self._ctx.event)
    events = property(lambda self: tuple(self._ctx.events))
    is_batch = property(lambda self: self._ctx.is_batch)
    is_resume = property(lambda self: self._ctx.is_resume)
    resume = property(lambda self: None if self._ctx.resume is None else dict(self._ctx.resume))
    snapshot = property(lambda self: self._ctx.snapshot)

    def recall(self, key: str) -> bytes | None:
        """A value of working memory, as this activation left it so far."""
        return self._ctx.memory.get(key)

    def ring(self, key: str) -> list[bytes]:
        return list(self._ctx.memory.ring(key))


def stepwise(agent: Callable[[View], Generator[Effect, Any, None]]) -> Callable[[Context], Complete | Suspend]:
    """A generator agent in the form that ``Config`` takes."""

    def run(ctx: Context) -> Complete | Suspend:
        steps = agent(View(ctx))
        if not inspect.isgenerator(steps):
            raise TypeError(f"{agent!r} yields no effects")
        give, answer = steps.send, None
        while True:
            try:
                effect = give(answer)
            except StopIteration:
                return Complete()
            give = steps.send
            try:
                if not isinstance(effect, Effect):
                    raise TypeError(f"no effect: {effect!r}")
                effect.check(ctx)
                answer = None if isinstance(effect, Wait) else effect.stage(ctx)
            except Exception as e:
                give, answer = steps.throw, e  # at the agent's yield, where it may be caught
                continue
            if isinstance(effect, Wait):
                break
        for late in steps:
            raise TypeError(f"an activation ends by waiting, and {late!r} came after")
        return Suspend(effect.snapshot, effect.timeout_ms)

    return run


class StreamAgent:
    """The same as a class: ``activate(view)`` is a generator of effects. An instance stands for an agent in ``Config``."""

    def activate(self, view: View) -> Generator[Effect, Any, None]:
        raise NotImplementedError

    def __call__(self, ctx: Context) -> Complete | Suspend:
        return stepwise(self.activate)(ctx)
