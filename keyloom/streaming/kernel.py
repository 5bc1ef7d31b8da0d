"""The activation state machine of one key, as pure functions of state, input and injected clocks.

``KeyState`` holds all that a key remembers. ``on_envelope``, ``on_hitl``, ``on_ttl`` and ``on_flush`` each take
a state and return the records to emit; the state is changed only when an activation succeeds, so a failure
leaves it as it was. Nothing here reads a wall clock or random numbers; a retried input gives equal records.

An agent is a function or coroutine function ``agent(ctx) -> Complete | Suspend``. It runs with a time limit
(``bridge``). Durations are measured for metrics alone and never reach state or other records.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import inspect
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from . import bridge
from . import tools as tool_schema
from .memory import HARD_CAP, SOFT_SHARE, Memory, ReplayCache, cache_key, migrate
from .model import BudgetExceeded, CircuitBreaker, ProviderError, Response, RetryPolicy, TokenBudget, WorkerBreaker

INTENT_NAMESPACE = uuid.UUID("6f3e9d2a-1c47-5b8e-9a10-2d4f6b8c0e11")
TRACE_NAMESPACE = uuid.UUID("b1d7c4e2-93a6-5f08-8c31-7e5a9d0f2b46")
TIMEOUT_OUTPUT = "__hitl_timeout__"


def _uuid5(space: uuid.UUID, name: str) -> bytearray:
    """The bytes of ``uuid.uuid5``, which spends most of its time on an object that is not needed here."""
    out = bytearray(hashlib.sha1(space.bytes + name.encode(), usedforsecurity=False).digest()[:16])
    out[6], out[8] = out[6] & 0x0F | 0x50, out[8] & 0x3F | 0x80
    return out


def intent_id(key: str, seq: int, step: int) -> str:
    h = _uuid5(INTENT_NAMESPACE, f"{key}|{seq}|{step}").hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


@functools.lru_cache(maxsize=64)  # all records of an activation ask for the same few
def trace_id(key: str, seq: int) -> str:
    return _uuid5(TRACE_NAMESPACE, f"{key}|{seq}").hex()


@functools.lru_cache(maxsize=64)
def span_id(key: str, seq: int, role: str, index: int) -> str:
    return _uuid5(TRACE_NAMESPACE, f"{key}|{seq}|{role}|{index}")[:8].hex()


@dataclass(frozen=True)
class Complete:
    output: str | None = None


@dataclass(frozen=True)
class Suspend:
    """Wait for the intents staged so far; ``snapshot`` comes back on resume."""

    snapshot: str = ""
    timeout_ms: int | None = None


@dataclass(frozen=True)
class Deny:
    output: str = TIMEOUT_OUTPUT


@dataclass(frozen=True)
class Drop:
    reason: str = "hitl_timeout"


@dataclass(frozen=True)
class Escalate:
    tool_name: str
    args_json: str = "{}"
    timeout_ms: int = 24 * 3600_000


@dataclass(frozen=True)
class TimeoutPolicy:
    timeout_ms: int = 24 * 3600_000
    intent_ttl_ms: int = 3600_000
    approval_channel: str = "approval"
    max_escalations: int = 0
    on_timeout: Callable[[dict], Deny | Drop | Escalate] = lambda fallback: Deny()

    def __post_init__(self):
        if self.timeout_ms <= 0 or self.intent_ttl_ms <= 0:
            raise ValueError("timeouts must be positive")
        if self.max_escalations < 0 or not self.approval_channel:
            raise ValueError("max_escalations must not be negative, and the channel must have a name")


@dataclass(frozen=True)
class Batching:
    """Adaptive batching: a size that triggers, a longest wait, and a cap on what waits."""

    max_batch_size: int = 10
    max_wait_ms: int = 500
    max_buffered_events: int | None = None

    def __post_init__(self):
        if self.max_batch_size <= 0 or self.max_wait_ms <= 0 or self.cap < self.max_batch_size:
            raise ValueError("batch bounds must be positive, and the cap no less than the batch size")

    @property
    def cap(self) -> int:
        return 4 * self.max_batch_size if self.max_buffered_events is None else self.max_buffered_events


@dataclass(frozen=True)
class Summarise:
    """Second tier of compaction, a model call after the agent: the oldest items of ``sources`` become one summary.

    ``build(items, prior)`` gives model and messages, ``extract`` the summary from the answer, which must be smaller
    than what it replaces. The newest ``keep_recent`` items of each ring stay.
    """

    sources: tuple[str, ...]
    build: Callable[[list[bytes], bytes | None], tuple[str, list[dict]]]
    extract: Callable[[str], bytes] = str.encode
    key: str = "summary"
    keep_recent: int = 8
    trigger_bytes: int = int(SOFT_SHARE * HARD_CAP)

    def __post_init__(self):
        if not self.sources or not self.key or self.key in self.sources:
            raise ValueError("name at least one ring, and a summary key that is none of them")
        if self.keep_recent < 0 or self.trigger_bytes <= 0:
            raise ValueError("keep_recent must not be negative, and trigger_bytes positive")

    def __call__(self, ctx: Context) -> None:
        memory = ctx.memory
        if memory.size < self.trigger_bytes:
            return
        kept, folded = {}, []
        for name in self.sources:
            items = memory.ring(name) if name in memory.items else []
            old = items[: max(0, len(items) - self.keep_recent)]
            if old:
                folded += old
                kept[name] = items[len(old) :]
        if not folded:
            return
        prior = memory.get(self.key)
        model, messages = self.build(folded, prior)
        summary = self.extract(ctx.call_model(model, messages))
        if len(summary) >= sum(map(len, folded)) + len(prior or b""):
            raise ValueError("the summary is no smaller than what it replaces")
        for name, items in kept.items():
            memory.set_ring(name, items)
        memory.set(self.key, summary)


@dataclass(frozen=True)
class Config:
    """An agent with its limits. ``provider`` answers model requests; ``tools`` are read-only functions.

    ``timeout_ms``: None for no limit. ``metrics``: emit a record of counters and samples for each element.
    """

    agent: Callable[[Context], Complete | Suspend]
    provider: Callable[[dict], Response] | None = None
    tools: dict[str, Callable] = field(default_factory=dict)
    policy: TimeoutPolicy = field(default_factory=TimeoutPolicy)
    batching: Batching | None = None
    ttl_ms: int = 3600_000
    token_budget: int | None = None
    memory_cap: int = HARD_CAP
    protected: tuple[str, ...] = ("__langgraph__/",)
    summarise: Summarise | None = None
    timeout_ms: int | None = 30_000
    cancel_grace_ms: int = 5_000
    metrics: bool = False
    sleep: Callable[[float], None] = time.sleep
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    breaker: CircuitBreaker | WorkerBreaker | None = None
    on_expire: Callable[[str, Memory], dict] | None = None


@dataclass
class KeyState:
    memory: dict | None = None
    cache: dict | None = None
    continuation: dict | None = None
    pending: list[dict] = field(default_factory=list)
    batch: list[dict] = field(default_factory=list)
    seq: int = 0
    ttl_at_ms: int | None = None
    hitl_at_ms: int | None = None
    flush_at_ms: int | None = None

    def dump(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, separators=(",", ":"))

    @classmethod
    def load(cls, text: str | None) -> KeyState:
        return cls(**json.loads(text)) if text else cls()


class Context:
    """What an agent sees, and what it stages. Staged effects count only if the activation succeeds."""

    def __init__(self, config: Config, key: str, seq: int, now_ms: int, memory: Memory, cache: ReplayCache, *, events: list | None = None, resume: dict | None = None, snapshot: str = "", step: int = 0):
        self.config, self.key, self.seq, self.now_ms, self.memory = config, key, seq, now_ms, memory
        self.cache, self.resume, self.snapshot, self.step, self.entry = cache, resume, snapshot, step, step
        self.events = events or []
        self.intents: list[dict] = []
        self.traces: list[dict] = []
        self.outputs: list[str] = []
        self.saves: list[dict] = []
        self.budget = TokenBudget(config.token_budget)
        self.tool_calls = 0
        self.began = time.monotonic()
        self.cancelled = threading.Event()
        self.samples: dict[str, list[int]] = {"llm_ms": [], "tool_ms": [], "prompt_tokens": [], "completion_tokens": []}

    @property
    def is_resume(self) -> bool:
        return self.resume is not None

    @property
    def is_batch(self) -> bool:
        return len(self.events) > 1

    @property
    def event(self):
        return self.events[0] if len(self.events) == 1 else self.events

    def trace(self, event_type: str, index: int, role: str | None = None, **attributes) -> None:
        role = role or ("activation" if event_type in ("ACTIVATION_START", "ACTIVATION_END") else event_type)
        own = span_id(self.key, self.seq, "activation", self.entry)
        self.traces.append(
            {
                "trace_id": trace_id(self.key, self.seq), "span_id": own if role == "activation" else span_id(self.key, self.seq, role, index), "parent_span_id": "" if role == "activation" else own,
                "seq": self.seq, "step_index": index, "event_type": event_type, "start_ms": self.now_ms, "attributes": {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in attributes.items() if v is not None},
            }
        )

    def emit(self, output: str) -> None:
        self.outputs.append(output)

    def call_model(self, model: str, messages: list[dict], tools: list | None = None, schema: dict | None = None, **params) -> str:
        """A cached response costs no call; a fresh one is retried after a delay, charged and cached.

        With a JSON ``schema`` an answer that does not fit it raises ValueError.
        """
        self.budget.check()
        self.step += 1
        request = {"model": model, "messages": messages, "tools": tools or [], "params": params}
        key = cache_key(model, messages, tools or [], params, self.key, self.seq)
        stored = self.cache.get(key, self.now_ms)
        attempts, breaker = 0, self.config.breaker.of(model) if self.config.breaker else None
        if stored is not None:
            got = Response(**json.loads(stored))
        else:
            if self.config.provider is None:
                raise RuntimeError("no provider")
            while True:
                if breaker:
                    breaker.check(self.now_ms)
                attempts += 1
                try:
                    with self._timed("llm_ms"):
                        got = self.config.provider(request)
                except ProviderError as e:
                    if breaker:
                        breaker.record(False, self.now_ms)
                    if attempts >= self.config.retry.attempts or self.cancelled.is_set():
                        raise
                    self.config.sleep(self.config.retry.delay_ms(attempts, e) / 1000)
                    continue
                except BaseException:
                    if breaker:
                        breaker.abandon()
                    raise
                if breaker:
                    breaker.record(True, self.now_ms)
                break
            self.cache.put(key, json.dumps(asdict(got), sort_keys=True), self.now_ms)
            if got.input_tokens is not None or got.output_tokens is not None:
                self.samples["prompt_tokens"].append(got.input_tokens or 0)
                self.samples["completion_tokens"].append(got.output_tokens or 0)
        self.budget.charge((got.input_tokens or 0) + (got.output_tokens or 0))
        self.trace("LLM_CALL", self.step, model=model, input_tokens=got.input_tokens, output_tokens=got.output_tokens, cache_hit=stored is not None, billed=stored is None, attempts=attempts, circuit_state=breaker.state(self.now_ms) if breaker else None)
        if schema is not None:
            tool_schema.check(json.loads(got.text), schema)
        return got.text

    @contextlib.contextmanager
    def _timed(self, name: str):
        began = time.monotonic()
        yield
        self.samples[name].append(int(1000 * (time.monotonic() - began)))  # calls that answered

    def run_tool(self, name: str, /, **args):
        """A read-only tool: no step, its own trace index."""
        tool = self.config.tools[name]
        if getattr(tool, "side_effect", False):
            raise TypeError(f"{name!r} has side effects: stage it with act()")
        with self._timed("tool_ms"):
            out = tool(**args)
        self.trace("TOOL_CALL", self.tool_calls, tool_name=name)
        self.tool_calls += 1
        return out

    def act(self, tool_name: str, args: dict | None = None, *, kind: str = "TOOL", ttl_ms: int | None = None) -> str:
        """Stage an intent; its id depends on key, sequence and step alone."""
        self.step += 1
        made = intent_id(self.key, self.seq, self.step)
        expires = self.now_ms + (self.config.policy.intent_ttl_ms if ttl_ms is None else ttl_ms)
        self.intents.append({"intent_id": made, "tool_name": tool_name, "kind": kind, "args_json": json.dumps(args or {}, sort_keys=True, separators=(",", ":"), allow_nan=False), "seq": self.seq, "step_index": self.step, "created_at_ms": self.now_ms, "expires_at_ms": expires})
        self.trace("INTENT_EMITTED", self.step, intent_id=made, tool_name=tool_name, intent_kind=kind, expires_at_ms=expires)
        return made

    def request_approval(self, args: dict | None = None, ttl_ms: int | None = None) -> str:
        return self.act(self.config.policy.approval_channel, args, kind="APPROVAL", ttl_ms=ttl_ms)

    def save(self, name: str, value: str) -> None:
        """Long-term memory: written outside, guarded by the sequence number."""
        self.saves.append({"name": name, "value": value, "seq": self.seq, "updated_at_ms": self.now_ms})


def _error(reason: str, detail: str, now_ms: int, key: str, seq: int, error_type: str | None = None, timer: bool = False, count: int = 1, trace: bool = True, failure: dict | None = None) -> list[dict]:
    out: list[dict] = [{"stream": "errors", "reason": reason, "detail": detail, "event_time_ms": now_ms} for _ in range(count)]
    if trace:
        role = "timer" if timer else "ERROR"
        out.append({"stream": "traces", "trace_id": trace_id(key, seq), "span_id": span_id(key, seq, role, 0), "parent_span_id": span_id(key, seq, "activation", 0), "seq": seq, "step_index": 0, "event_type": "ERROR", "start_ms": now_ms, "attributes": {"reason": reason} | ({"error_type": error_type} if error_type else {}) | (failure or {})})
    return out


def failure_context(ctx: Context) -> dict[str, str]:
    """Where an activation was when it failed: nothing of its contents, and the same in a replay."""
    last = ctx.traces[-1]["event_type"] if ctx.traces else ""
    return {"failure_step": str(ctx.step), "failure_last_event": last, "failure_staged_intents": str(len(ctx.intents)), "failure_llm_calls": str(len(ctx.samples["llm_ms"]))}


def admission_failure(continuation: dict | None, pending: list[dict], wanted: str, now_ms: int) -> str | None:
    """Why a result may not resume the activation; a non-positive time counts as passed."""
    if continuation is None:
        return "no_continuation"
    if wanted not in continuation["pending_intent_ids"]:
        return "unknown_intent"
    if continuation["deadline_ms"] <= 0 or now_ms >= continuation["deadline_ms"]:
        return "deadline_passed"
    if any(p["intent_id"] == wanted and (p["expires_at_ms"] <= 0 or now_ms >= p["expires_at_ms"]) for p in pending):
        return "intent_expired"
    return None


def _activate(config: Config, key: str, state: KeyState, ctx: Context, batch: tuple[int, str] | None = None, wall_ms: int | None = None) -> list[dict]:
    """Run the agent and commit; on any failure the caller's state stays as it was."""
    kind = "resume" if ctx.is_resume else "start"
    extra = {"batch_size": batch[0], "batch_trigger": batch[1]} if batch else {}
    ctx.trace("ACTIVATION_START", 0, kind=kind, **extra)

    def agent() -> Complete | Suspend:
        outcome = config.agent(ctx)
        if config.summarise is None:
            return outcome
        if inspect.isawaitable(outcome):

            async def both():
                result = await outcome
                config.summarise(ctx)
                return result

            return both()
        config.summarise(ctx)
        return outcome

    outcome = bridge.run(agent, config.timeout_ms, config.cancel_grace_ms, ctx.cancelled)
    after = KeyState(**state.__dict__)
    after.memory, after.cache, after.seq = ctx.memory.dump(), ctx.cache.dump(), state.seq + 1
    after.pending, ttl_from = list(ctx.intents), ctx.now_ms
    if isinstance(outcome, Suspend):
        timeout = config.policy.timeout_ms if outcome.timeout_ms is None else outcome.timeout_ms
        deadline = min([ctx.now_ms + timeout, *(i["expires_at_ms"] for i in ctx.intents)])
        after.continuation = {"v": 1, "seq": ctx.seq, "step_index": ctx.step + 1, "snapshot": outcome.snapshot, "deadline_ms": deadline, "escalations": 0, "pending_intent_ids": [i["intent_id"] for i in ctx.intents]}
        after.hitl_at_ms, ttl_from = deadline, max(ctx.now_ms, deadline)
        ctx.trace("SUSPENDED", ctx.step, deadline_ms=deadline)
        status = "suspended"
    elif isinstance(outcome, Complete):
        if outcome.output is not None:
            ctx.emit(outcome.output)
        after.continuation, after.hitl_at_ms, status = None, None, "completed"
    else:
        raise TypeError(f"an agent returns Complete or Suspend, not {outcome!r}")
    after.ttl_at_ms = ttl_from + config.ttl_ms
    if batch:
        after.batch, after.flush_at_ms = [], None
    elif after.continuation is None and after.batch:
        after.flush_at_ms = wall_ms  # what waited for the suspension to end
    ctx.trace("ACTIVATION_END", 0, kind=kind, status=status)
    state.__dict__.update(after.__dict__)
    rows = [{"stream": "output", "seq": ctx.seq, "payload": o} for o in ctx.outputs]
    rows += [{"stream": "intents", **i} for i in ctx.intents] + [{"stream": "traces", **t} for t in ctx.traces]
    rows += [{"stream": "saves", **s} for s in ctx.saves]
    return rows + _committed(config, ctx, status, batch)


def _metric(config: Config, now_ms: int, seq: int, counters: dict[str, int] | None = None, samples: dict[str, list[int]] | None = None) -> list[dict]:
    some = {k: v for k, v in (counters or {}).items() if v}
    full = {k: v for k, v in (samples or {}).items() if v}
    return [{"stream": "metrics", "seq": seq, "event_time_ms": now_ms, "counters": some, "samples": full}] if config.metrics and (some or full) else []


def _committed(config: Config, ctx: Context, status: str, batch: tuple[int, str] | None) -> list[dict]:
    """What a committed activation counts. A failed one commits nothing and leaves no record of this."""
    if not config.metrics:
        return []
    s = ctx.samples
    counters = {
        "activations": 1, "suspensions": int(status == "suspended"), "intents_emitted": len(ctx.intents), "longterm_upserts": len(ctx.saves), "llm_calls": len(s["llm_ms"]), "tool_calls": ctx.tool_calls,
        "batch_flushes_size": int(bool(batch) and batch[1] == "size"), "batch_flushes_timer": int(bool(batch) and batch[1] == "timer"),
    }
    wall = int(1000 * (time.monotonic() - ctx.began))
    samples = {"memory_bytes": [ctx.memory.size], "iterations": [ctx.step - ctx.entry], "llm_ms": s["llm_ms"], "overhead_ms": [max(0, wall - sum(s["llm_ms"]) - sum(s["tool_ms"]))]}
    if s["prompt_tokens"]:  # usage that was reported, and only of calls that reached the provider
        prompt, completion = sum(s["prompt_tokens"]), sum(s["completion_tokens"])
        samples |= {"tokens": [prompt + completion], "prompt_tokens": [prompt], "completion_tokens": [completion]}
    if batch:
        samples["batch_size"] = [batch[0]]
    return _metric(config, ctx.now_ms, ctx.seq, counters, samples)


def _counted(config: Config, now_ms: int, seq: int, rows: list[dict]) -> list[dict]:
    """Records with the counters of the errors among them: orphaned results, and all others."""
    if not config.metrics:
        return rows
    errors = [r for r in rows if r["stream"] == "errors"]
    orphaned = sum(r["reason"] == "orphaned_result" for r in errors)
    return rows + _metric(config, now_ms, seq, {"agent_errors": len(errors) - orphaned, "orphaned_results": orphaned})


def _context(config: Config, key: str, state: KeyState, seq: int, now_ms: int, **kw) -> Context:
    return Context(config, key, seq, now_ms, Memory.load(state.memory, config.memory_cap, config.protected), ReplayCache.load(state.cache), **kw)


def _attempt(config: Config, key: str, state: KeyState, ctx: Context, **kw) -> list[dict]:
    try:
        rows = _activate(config, key, state, ctx, **kw)
    except bridge.ActivationTimeout:
        rows = _error("activation_timeout", "", ctx.now_ms, key, ctx.seq)
    except Exception as e:
        reason = "budget_exceeded" if isinstance(e, BudgetExceeded) and "batch" not in kw else "activation_error"
        at = failure_context(ctx)
        where = f" failed_at_step={at['failure_step']} after={at['failure_last_event']}"
        rows = _error(reason, repr(e) + where, ctx.now_ms, key, ctx.seq, type(e).__name__, failure=at)
    return rows + _metric(config, ctx.now_ms, ctx.seq, samples={"activation_ms": [int(1000 * (time.monotonic() - ctx.began))]})


def _flush(config: Config, key: str, state: KeyState, trigger: str) -> list[dict]:
    """The whole buffer as one activation; a failure consumes it, one error for each element."""
    waiting = list(state.batch)
    now_ms = max(e["event_time_ms"] for e in waiting)
    ctx = _context(config, key, state, state.seq, now_ms, events=[e["external_event"] for e in waiting])
    rows = _attempt(config, key, state, ctx, batch=(len(waiting), trigger))
    if rows and rows[0]["stream"] == "errors":
        state.batch, state.flush_at_ms = [], None
        first = rows[0] | {"detail": f"{rows[0]['detail']} batch_size={len(waiting)},trigger={trigger}".strip()}
        rows = [first] * len(waiting) + rows[1:]
    return rows


def on_envelope(config: Config, key: str, state: KeyState, envelope: dict, wall_ms: int) -> list[dict]:
    """Route one element. ``wall_ms`` only arms the flush timer."""
    return _counted(config, envelope["event_time_ms"], state.seq, _routed(config, key, state, envelope, wall_ms))


def _routed(config: Config, key: str, state: KeyState, envelope: dict, wall_ms: int) -> list[dict]:
    now_ms, kind = envelope["event_time_ms"], envelope["kind"]
    if kind == "export_request":
        return [snapshot(state, now_ms, envelope["export_request"]["request_id"])]
    if kind in ("tool_result", "approval"):
        result = envelope[kind]
        cont = migrate(state.continuation)
        failure = admission_failure(cont, state.pending if cont else [], result["intent_id"], now_ms)
        if failure:
            seq = cont["seq"] if cont else state.seq
            return _error("orphaned_result", f"{failure}:{result['intent_id']}", now_ms, key, seq, failure)
        ctx = _context(config, key, state, cont["seq"], now_ms, resume=dict(result) | {"kind": kind}, snapshot=cont["snapshot"], step=cont["step_index"])
        return _attempt(config, key, state, ctx, wall_ms=wall_ms)
    if config.batching is None:
        return _attempt(config, key, state, _context(config, key, state, state.seq, now_ms, events=[envelope["external_event"]]))
    b = config.batching
    if len(state.batch) >= b.cap:
        return _error("batch_buffer_overflow", f"buffered={len(state.batch)},cap={b.cap}", now_ms, key, state.seq, trace=False)
    state.batch = [*state.batch, {"event_time_ms": now_ms, "external_event": envelope["external_event"]}]
    state.ttl_at_ms = now_ms + config.ttl_ms
    if len(state.batch) == 1:
        state.flush_at_ms = wall_ms + b.max_wait_ms
    counted = _metric(config, now_ms, state.seq, {"events_buffered": 1})
    if len(state.batch) >= b.max_batch_size and state.continuation is None:
        return _flush(config, key, state, "size") + counted
    return counted


def on_flush(config: Config, key: str, state: KeyState) -> list[dict]:
    """A stale mark or a live suspension makes this nothing."""
    state.flush_at_ms = None
    if not state.batch or state.continuation is not None:
        return []
    now_ms, seq = max(e["event_time_ms"] for e in state.batch), state.seq
    return _counted(config, now_ms, seq, _flush(config, key, state, "timer"))


def on_hitl(config: Config, key: str, state: KeyState, fired_ms: int, wall_ms: int) -> list[dict]:
    cont = migrate(state.continuation)
    if cont is None or fired_ms < cont["deadline_ms"]:
        return []
    detail = f"seq={cont['seq']}"
    try:
        route = config.policy.on_timeout({"entity_key": key, "fired_at_ms": fired_ms, **cont})
    except Exception as e:
        route, detail = Drop(), f"{detail} policy_error={e!r}"
    if isinstance(route, Escalate) and cont["escalations"] >= config.policy.max_escalations:
        route = Deny()
    if isinstance(route, Escalate):
        deadline = fired_ms + route.timeout_ms
        ctx = Context(config, key, cont["seq"], fired_ms, Memory(), ReplayCache(), step=cont["step_index"])
        made = intent_id(key, cont["seq"], cont["step_index"])
        ctx.trace("INTENT_EMITTED", cont["step_index"], intent_id=made, tool_name=route.tool_name, intent_kind="APPROVAL", expires_at_ms=deadline)
        intent = {"intent_id": made, "tool_name": route.tool_name, "kind": "APPROVAL", "args_json": route.args_json, "seq": cont["seq"], "step_index": cont["step_index"], "created_at_ms": fired_ms, "expires_at_ms": deadline}
        state.continuation = cont | {"step_index": cont["step_index"] + 1, "deadline_ms": deadline, "escalations": cont["escalations"] + 1, "pending_intent_ids": [*cont["pending_intent_ids"], made]}
        state.pending = [*state.pending, intent]
        state.hitl_at_ms, state.ttl_at_ms = deadline, deadline + config.ttl_ms
        return [{"stream": "intents", **intent}, {"stream": "traces", **ctx.traces[0]}, *_metric(config, fired_ms, cont["seq"], {"intents_emitted": 1})]
    state.continuation, state.pending, state.hitl_at_ms = None, [], None
    if state.batch:
        state.flush_at_ms = wall_ms
    trace = _error("hitl_timeout", "", fired_ms, key, cont["seq"], timer=True)[1:]
    if isinstance(route, Deny):
        return [{"stream": "output", "seq": cont["seq"], "payload": route.output}, *trace]
    return _counted(config, fired_ms, cont["seq"], [{"stream": "errors", "reason": route.reason, "detail": detail, "event_time_ms": fired_ms}, *trace])


def on_ttl(config: Config, key: str, state: KeyState, fired_ms: int) -> list[dict]:
    """Report what is lost, then forget the key."""
    rows, cont = [], migrate(state.continuation)
    if cont is not None:
        rows += _error("ttl_wiped_suspension", f"seq={cont['seq']},deadline_ms={cont['deadline_ms']}", fired_ms, key, cont["seq"], timer=True)
    if config.on_expire is not None:
        saved = config.on_expire(key, Memory.load(state.memory, config.memory_cap))
        rows += [{"stream": "saves", "name": n, "value": v, "seq": state.seq, "updated_at_ms": fired_ms} for n, v in saved.items()]
    for i in range(len(state.batch)):
        rows += _error("ttl_wiped_batch", f"buffered={len(state.batch)},index={i}", fired_ms, key, state.seq, trace=False)
    seq = state.seq
    state.__dict__.update(KeyState().__dict__)
    return _counted(config, fired_ms, seq, rows)


def snapshot(state: KeyState, now_ms: int, request_id: str) -> dict:
    """A read-only export: no activation, no sequence number, an absent continuation stays absent."""
    memory, cont = Memory.load(state.memory), state.continuation
    return {
        "stream": "snapshots", "seq": state.seq, "request_id": request_id, "snapshot_at_ms": now_ms, "memory_entries": len(memory.items), "memory_bytes": memory.size,
        "llm_cache_entries": len((state.cache or {}).get("rows", [])), "pending_intent_ids": [p["intent_id"] for p in state.pending],
        "continuation_step_index": cont["step_index"] if cont else None, "continuation_deadline_ms": cont["deadline_ms"] if cont else None, "raw": state.dump(),
    }
