"""Execution of staged intents: each is done once, in the order of its key, and every ending is a result.

``Executor`` takes one intent through its steps. It looks at signature and expiry before anything shared is touched, then asks
for the intent's lease (``leases``). A settled intent gives its stored result again and is never run again; one that another
worker holds has to wait, and so has all that follows under its key. A lease lost while a tool ran means that
the other worker's result counts.

``execute`` does so for a table. Results are written once and read from there, so further actions on the frame run no tool, and
a task that is retried finds what the first attempt settled. ``streaming.effector`` is the same on a stream.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging
from .leases import KEEP_MS, LEASE_MS, LeaseFolder

RESULT = "intent_id string, entity_key string, seq bigint, status string, payload string, error_message string, finished_at_ms bigint"
NEEDED = ["intent_id", "entity_key", "seq", "step_index", "tool_name", "kind", "args_json", "expires_at_ms"]


class Waiting(Exception):
    """The intent is held elsewhere; ``until_ms``: when its lease ends at the latest."""

    def __init__(self, until_ms: int):
        super().__init__(until_ms)
        self.until_ms = until_ms


class _Refused(Exception):
    """The intent is not one that may be run; the message says why."""


def expired(intent: dict, now_ms: int) -> bool:
    """An intent counts as expired from its time on, and if it has none."""
    return not intent["expires_at_ms"] or intent["expires_at_ms"] < 0 or now_ms >= intent["expires_at_ms"]


def result(intent: dict, status: str, now_ms: int, payload: str | None = None, why: str | None = None) -> dict:
    return {"intent_id": intent["intent_id"], "entity_key": intent["entity_key"], "seq": intent["seq"], "status": status, "payload": payload, "error_message": why, "finished_at_ms": now_ms}


def _prepared(intent: dict, tools: dict[str, Callable]) -> Callable[[], object]:
    """The call that an intent asks for, its arguments checked."""
    name = intent["tool_name"]
    if name not in tools:
        raise _Refused(f"{name!r} is not among the tools")
    tool = tools[name]
    if getattr(tool, "side_effect", True) is False:
        raise _Refused(f"{name!r} only reads; an agent runs it in place")
    try:
        args = json.loads(intent["args_json"] or "{}")
    except ValueError as e:
        raise _Refused(f"arguments of {name!r} are no JSON: {e}") from None
    if not isinstance(args, dict):
        raise _Refused(f"arguments of {name!r} are not named")
    if hasattr(tool, "schema"):
        from ..streaming.tools import check

        try:
            check(args, tool.schema)
        except ValueError as e:
            raise _Refused(str(e)) from None
    return lambda: getattr(tool, "f", tool)(**args)


def _within(call: Callable[[], object], limit_ms: int | None) -> object:
    """The call's value; TimeoutError if it takes longer. A call that goes on then is left behind on its own thread."""
    if limit_ms is None:
        return call()
    ended: list = []

    def run() -> None:
        try:
            ended.append((True, call()))
        except BaseException as e:  # noqa: BLE001  it belongs to the thread that waits
            ended.append((False, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(limit_ms / 1000)
    if not ended:
        raise TimeoutError
    good, value = ended[0]
    if good:
        return value
    raise value


def result_of(intent: dict, tools: dict[str, Callable], now_ms: int, limit_ms: int | None = None) -> dict:
    """What running one intent comes to: OK, ERROR, REJECTED (no tool was called) or EXPIRED. Never raises for a tool's sake."""
    if expired(intent, now_ms):
        return result(intent, "EXPIRED", now_ms, why="its time was over")
    try:
        call = _prepared(intent, tools)
    except _Refused as e:
        return result(intent, "REJECTED", now_ms, why=str(e))
    try:
        value = _within(call, limit_ms)
    except TimeoutError:
        return result(intent, "ERROR", now_ms, why=f"no answer from {intent['tool_name']!r} in time: unknown whether it took effect")
    except Exception as e:
        return result(intent, "ERROR", now_ms, why=f"{type(e).__name__}: {e}")
    try:
        return result(intent, "OK", now_ms, json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False))
    except (TypeError, ValueError) as e:
        return result(intent, "ERROR", now_ms, why=f"{intent['tool_name']!r} took effect, but what it gave is no JSON: {e}")


@dataclass
class Executor:
    """One worker's way through an intent. ``leases`` names the shared folder; ``check`` says why an intent is not authentic."""

    tools: dict[str, Callable]
    leases: str
    clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000
    lease_ms: int = LEASE_MS
    keep_ms: int = KEEP_MS
    limit_ms: int | None = None
    check: Callable[[dict], str | None] | None = None
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self._folder: LeaseFolder | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_folder": None}  # each task is a worker of its own

    @property
    def folder(self) -> LeaseFolder:
        if self._folder is None:
            self._folder = LeaseFolder(self.leases)
        return self._folder

    def _count(self, what: str) -> None:
        self.counts[what] = self.counts.get(what, 0) + 1

    def step(self, intent: dict) -> tuple[str, dict]:
        """``("result", row)``, ``("approval", intent)``, ``("refused", row)`` or ``("done", {})``: an approval that was routed before.
        Raises ``Waiting`` if the intent's turn has not come."""
        why = self.check(intent) if self.check is not None else None
        if why is not None:
            self._count("refused")
            return "refused", result(intent, "REFUSED", self.clock(), why=why)
        if expired(intent, self.clock()):
            self._count("expired")
            return "result", result_of(intent, self.tools, self.clock())
        got = self.folder.ask(intent["intent_id"], self.lease_ms)
        if got.kind == "settled":
            self._count("repeated")
            return ("result", got.outcome) if got.outcome is not None else ("done", {})
        if got.kind == "held":
            raise Waiting(got.until_ms)
        approval = intent["kind"] == "APPROVAL"
        made = None if approval else result_of(intent, self.tools, self.clock(), self.limit_ms)
        if not self.folder.settle(intent["intent_id"], got.fence, made, self.keep_ms):
            self._count("lost")
            raise Waiting(self.clock())
        self._count("approvals" if approval else "executed")
        return ("approval", intent) if approval else ("result", made)


def execute(intents: DataFrame, executor: Executor, *, patience_ms: int = 2 * LEASE_MS, poll_ms: int = 200) -> DataFrame:
    """Results of TOOL intents, one for each id, written once in the shared folder. Approvals are routed elsewhere (``approvals``).

    Keys are dealt to tasks and sorted by (seq, step_index): serial within a key, parallel across keys, as many at once as the
    cluster runs tasks. An intent that another worker holds is waited for, ``patience_ms`` at most; then the task fails and is
    tried again.
    """
    spark = intents.sparkSession

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in RESULT.split(", ")]
        for b in batches:
            rows = []
            for intent in b.to_pylist():
                end = time.monotonic() + patience_ms / 1000
                while True:
                    try:
                        kind, row = executor.step(intent)
                        break
                    except Waiting:
                        if time.monotonic() > end:
                            raise
                        time.sleep(poll_ms / 1000)
                if kind == "result":
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    own = intents.filter("kind <> 'APPROVAL'").select(*NEEDED).dropDuplicates(["intent_id"])
    done = own.repartition("entity_key").sortWithinPartitions("entity_key", "seq", "step_index", "intent_id").mapInArrow(work, RESULT)
    path = f"{staging.shared_dir(spark)}/keyloom/results-{uuid.uuid4().hex}"
    done.write.parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def approvals(intents: DataFrame) -> DataFrame:
    """What goes to the approval channel: the request itself, without a result."""
    return intents.filter("kind = 'APPROVAL'").dropDuplicates(["intent_id"])


def grants(intents: DataFrame, leases: str) -> DataFrame:
    """``(intent_id, grants)``: how often each intent's lease was granted, that is, how often its tool may have run."""
    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        folder = LeaseFolder(leases)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folder.grants(i) for i in b.column(0).to_pylist()], pa.int64())], ["intent_id", "grants"])

    return intents.select("intent_id").filter("intent_id is not null").distinct().mapInArrow(look, "intent_id string, grants bigint")


class PublishFailed(RuntimeError):
    pass


def with_retry(operation: Callable[[], object], attempts: int = 5, backoff_ms: int = 100, sleep: Callable[[float], None] = time.sleep):
    """Retry publishing, which is idempotent, with doubled delays. A tool never goes through here."""
    last: Exception | None = None
    for attempt in range(1, attempts + 1):
        try:
            return operation()
        except Exception as e:
            last = e
            if attempt < attempts:
                sleep(backoff_ms / 1000)
                backoff_ms *= 2
    raise PublishFailed(f"no success in {attempts} attempts") from last
