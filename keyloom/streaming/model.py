"""Model calls inside an activation: budget, cache, circuit breaker, retries, and a scripted provider."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field


class ProviderError(Exception):
    """A failure that may pass: only these are retried."""

    def __init__(self, message: str, retry_after_ms: int = 0):
        super().__init__(message)
        self.retry_after_ms = retry_after_ms


class CircuitOpen(Exception):
    pass


class BudgetExceeded(Exception):
    pass


@dataclass
class Response:
    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None


@dataclass
class RetryPolicy:
    attempts: int = 3
    base_ms: int = 100
    max_ms: int = 5000

    def delay_ms(self, attempt: int, error: ProviderError, uniform: Callable[[float, float], float] = random.uniform) -> float:
        return max(uniform(0, min(self.base_ms * 2 ** (attempt - 1), self.max_ms)), error.retry_after_ms)


@dataclass
class CircuitBreaker:
    """Opens after ``failures`` in a row; after ``reset_ms`` one trial call is let through, and others only once it has succeeded."""

    failures: int = 5
    reset_ms: int = 30_000
    count: int = 0
    opened_ms: int | None = None
    trying: bool = False

    def of(self, model: str) -> CircuitBreaker:
        """The breaker of a model: this one serves all."""
        return self

    def state(self, now_ms: int) -> str:
        if self.opened_ms is None:
            return "closed"
        return "half_open" if now_ms - self.opened_ms >= self.reset_ms else "open"

    def check(self, now_ms: int) -> None:
        """Raise unless a call may be made now; the one that is let through half open is the trial."""
        state = self.state(now_ms)
        if state == "open" or (state == "half_open" and self.trying):
            raise CircuitOpen("circuit is open")
        self.trying = state == "half_open"

    def record(self, ok: bool, now_ms: int) -> None:
        self.trying = False
        if ok:
            self.count, self.opened_ms = 0, None
            return
        self.count += 1
        if self.count >= self.failures or self.opened_ms is not None:
            self.opened_ms = now_ms

    def abandon(self) -> None:
        """A call ended in a way that says nothing about the provider."""
        self.trying = False


class _Kept(CircuitBreaker):
    """The state of one model in a worker process: safe among threads, by the process's own clock."""

    def __init__(self, failures: int, reset_ms: int, clock: Callable[[], int]):
        super().__init__(failures, reset_ms)
        self.lock, self.clock = threading.Lock(), clock

    def state(self, now_ms: int) -> str:
        return super().state(self.clock())

    def check(self, now_ms: int) -> None:
        with self.lock:
            super().check(self.clock())

    def record(self, ok: bool, now_ms: int) -> None:
        with self.lock:
            super().record(ok, self.clock())


#: Of this process, by scope and model. Spark's Python workers outlive tasks and batches, and so does this.
_WORKER: dict[tuple[str, str], _Kept] = {}
_WORKER_LOCK = threading.Lock()


@dataclass(frozen=True)
class WorkerBreaker:
    """Settings of breakers that live in the worker process, one for each model: a ``Config`` is unpickled for each task and batch,
    and what its calls find out about a provider stays. ``scope`` keeps apart providers with models of the same name."""

    failures: int = 5
    reset_ms: int = 30_000
    scope: str = "default"
    clock: Callable[[], int] = field(default=lambda: time.monotonic_ns() // 1_000_000, compare=False)

    def of(self, model: str) -> CircuitBreaker:
        with _WORKER_LOCK:
            kept = _WORKER.get((self.scope, model))
            if kept is None or (kept.failures, kept.reset_ms) != (self.failures, self.reset_ms):
                kept = _WORKER[self.scope, model] = _Kept(self.failures, self.reset_ms, self.clock)
            kept.clock = self.clock
            return kept


@dataclass
class TokenBudget:
    """Trips when strictly more than ``limit`` was charged, and stays so. Cache hits are charged."""

    limit: int | None = None
    used: int = 0
    tripped: bool = False

    def check(self) -> None:
        if self.tripped:
            raise BudgetExceeded(f"{self.used} of {self.limit} tokens")

    def charge(self, tokens: int) -> None:
        self.used += tokens
        self.tripped |= self.limit is not None and self.used > self.limit


@dataclass
class ScriptedModel:
    """Rules ``(matcher, behaviour)`` tried in order; behaviours are texts, exceptions or functions."""

    rules: list[tuple] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)

    def __call__(self, request: dict) -> Response:
        self.calls.append(request)
        prompt = request["messages"][-1]["content"] if request["messages"] else ""
        for matcher, behaviour in self.rules:
            if matcher(request) if callable(matcher) else matcher in prompt:
                got = behaviour(request) if callable(behaviour) else behaviour
                if isinstance(got, Exception):
                    raise got
                return got if isinstance(got, Response) else Response(got, len(prompt.split()), len(got.split()))
        raise LookupError(f"no rule matches {prompt!r}")
