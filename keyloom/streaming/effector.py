"""Staged intents executed on a stream: a queue for each key, worked off from its head.

The operator keeps a key's intents in state, ordered by (seq, step_index). The head goes through ``effects.Executor``: verified,
checked for expiry, leased, run, settled. While another worker holds it, the key waits: a timer asks again when
that lease ends, or after ``retry_ms``, and nothing behind the head overtakes it. Other keys go on; as many run at once as
the stream has tasks, and a task runs one tool at a time.

A tool's result is settled in the shared folder before the batch ends. If the batch fails and is repeated, on this or another
executor, the settled result is given again and the tool isn't. A task that dies inside a tool leaves its lease to run out;
one that dies before has none.

Output: ``kind`` result, approval (the request, to be routed) or refused (not authentic), and the result's fields.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.effects import NEEDED, RESULT, Executor, Waiting

OUTPUT = f"kind string, tool_name string, args_json string, {RESULT}"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
RETRY_MS = 1000


def _order(intent: dict) -> tuple:
    return (intent["seq"] or 0, intent["step_index"] or 0, intent["intent_id"])


def work_off(queue: list[dict], executor: Executor) -> tuple[list[dict], int | None]:
    """Take intents from the head of a key's queue until it is empty or the head has to wait: output rows, and until when."""
    rows = []
    while queue:
        try:
            kind, made = executor.step(queue[0])
        except Waiting as e:
            return rows, e.until_ms
        head = queue.pop(0)
        if kind != "done":
            shown = made if kind != "approval" else {}
            rows.append({"kind": kind, "tool_name": head["tool_name"], "args_json": head["args_json"]} | {"intent_id": head["intent_id"], "entity_key": head["entity_key"], "seq": head["seq"]} | shown)
    return rows, None


class EffectProcessor(StatefulProcessor):
    """The queue of a key. ``executor.step`` does one item, or raises ``Waiting``."""

    def __init__(self, executor: Executor, retry_ms: int = RETRY_MS):
        self.executor, self.retry_ms = executor, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", "intents string, armed bigint")

    def _go_on(self, queue: list[dict], armed: int | None, now_ms: int):
        import pandas as pd

        rows, until = work_off(queue, self.executor)
        at = None if until is None else max(now_ms + 1, min(until, now_ms + self.retry_ms))
        if armed is not None and armed != at:
            self.handle.deleteTimer(armed)
        if at is not None and armed != at:
            self.handle.registerTimer(at)
        self.queue.update((json.dumps(queue), at)) if queue else self.queue.clear()
        return pd.DataFrame([dict.fromkeys(_COLUMNS) | r for r in rows], columns=_COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        stored, armed = self.queue.get() if self.queue.exists() else ("[]", None)
        queue = json.loads(stored)
        known = {i["intent_id"] for i in queue}
        for pdf in rows:
            for r in json.loads(pdf["intent"].to_json(orient="values")):
                intent = json.loads(r)
                if intent["intent_id"] not in known:
                    known.add(intent["intent_id"])
                    bisect.insort(queue, intent, key=_order)
        yield self._go_on(queue, armed, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        if self.queue.exists():
            yield self._go_on(json.loads(self.queue.get()[0]), None, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def run_effects_stream(intents: DataFrame, executor: Executor, retry_ms: int = RETRY_MS) -> DataFrame:
    """Results, approvals and refusals of a stream of intents, in append mode. Intents without an id or key are no intents."""
    extra = [c for c in ("key_id", "signature", "created_at_ms") if c in intents.columns]
    slim = intents.filter("intent_id is not null and entity_key is not null")
    slim = slim.select("entity_key", F.to_json(F.struct(*NEEDED, *extra), {"ignoreNullFields": "false"}).alias("intent"))
    return slim.groupBy("entity_key").transformWithStateInPandas(statefulProcessor=EffectProcessor(executor, retry_ms), outputStructType=OUTPUT, outputMode="append", timeMode="processingTime")
