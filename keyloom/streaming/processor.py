"""The kernel as a Structured Streaming operator.

Processing-time mode: timeouts and flushes are native timers; expiry follows the watermark, which is read on
each call and compared with a time kept in state, before anything else sees that state. A timer wakes an idle key about
when the watermark should get there, so a key costs one wake-up and not one a second; if event time runs faster than the
clock, the expiry is reported later, with the same records. Spark's own state expiry is silent and is not used.
State is kept in cells (memory, replay cache, buffer, the rest), and only cells that changed are written.
It is exactly-once with the checkpoint; each sink deduplicates on identity.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import kernel
from .fold import _COLUMNS, OUTPUT, STREAMS, as_row, to_envelope
from .kernel import Config, KeyState

POLL_MS = 1000


CELLS = {"memory": ("memory",), "cache": ("cache",), "batch": ("batch",), "rest": ("continuation", "pending", "seq", "ttl_at_ms", "hitl_at_ms", "flush_at_ms")}


class AgentProcessor(StatefulProcessor):
    """``streams``: the tagged outputs that are wanted, if not all; rows of others stay in the task, and ordinals are the same."""

    def __init__(self, config: Config, streams: tuple[str, ...] | None = None):
        self.config, self.streams = config, streams

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = {c: handle.getValueState(c, "blob string") for c in CELLS}
        self.place = handle.getValueState("place", "ordinal bigint, armed bigint")

    def _load(self) -> tuple[KeyState, dict[str, str | None], int, int | None]:
        """The state, its cells as they are stored, the number of records so far, and the timer that is set."""
        place = self.place.get()  # None for a key that has no state; each question to the store is a message
        if place is None:
            return KeyState(), dict.fromkeys(self.cells), 0, None
        stored = {c: (cell.get() or (None,))[0] for c, cell in self.cells.items()}
        parts = {k: v for blob in stored.values() if blob for k, v in json.loads(blob).items()}
        return KeyState(**parts), stored, *place

    def _arm(self, armed: int | None, at: int | None) -> int | None:
        """Set the key's one timer; the time it is set to."""
        if armed is not None and armed != at:
            self.handle.deleteTimer(armed)
        if at is not None and armed != at:
            self.handle.registerTimer(at)
        return at

    def _store(self, key: str, state: KeyState, stored: dict[str, str | None], ordinal: int, armed: int | None, rows: list[dict], now_ms: int, watermark_ms: int):
        import pandas as pd

        wanted = [t for t in (state.hitl_at_ms, state.flush_at_ms) if t is not None]
        if state.ttl_at_ms is not None:
            wanted.append(now_ms + max(POLL_MS, state.ttl_at_ms - (watermark_ms or state.ttl_at_ms)))
        at = self._arm(armed, max(min(wanted), now_ms + 1) if wanted else None)
        empty = state == KeyState()
        for c, names in CELLS.items():
            values = {n: getattr(state, n) for n in names}
            blob = None if empty or all(v in (None, []) for v in values.values()) else json.dumps(values, sort_keys=True, separators=(",", ":"))
            if blob != stored[c]:
                self.cells[c].clear() if blob is None else self.cells[c].update((blob,))
        self.place.clear() if empty else self.place.update((ordinal + len(rows), at))
        kept = [as_row(key, ordinal + i, r) for i, r in enumerate(rows) if self.streams is None or r["stream"] in self.streams]
        return pd.DataFrame({c: [r[c] for r in kept] for c in _COLUMNS}, dtype=object)

    def _expired(self, key: str, state: KeyState, watermark_ms: int) -> list[dict]:
        due = state.ttl_at_ms is not None and 0 < state.ttl_at_ms <= watermark_ms
        return kernel.on_ttl(self.config, key, state, state.ttl_at_ms) if due else []

    def _due(self, key: str, state: KeyState, now_ms: int, watermark_ms: int) -> list[dict]:
        rows: list[dict] = []
        if state.flush_at_ms is not None and state.flush_at_ms <= now_ms:
            rows += kernel.on_flush(self.config, key, state)
        if state.hitl_at_ms is not None and state.hitl_at_ms <= now_ms:
            before = state.hitl_at_ms
            rows += kernel.on_hitl(self.config, key, state, before, now_ms)
            if state.hitl_at_ms == before:
                state.hitl_at_ms = None
        return rows + self._expired(key, state, watermark_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        state, stored, ordinal, armed = self._load()
        now_ms, watermark_ms = timerValues.getCurrentProcessingTimeInMs(), timerValues.getCurrentWatermarkInMs()
        found = [to_envelope(dict(zip(pdf.columns, r, strict=True))) for pdf in rows for r in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True)]
        out = self._expired(key[0], state, watermark_ms)
        for e in sorted(found, key=lambda e: (e["event_time_ms"], e["arrival"])):
            out += kernel.on_envelope(self.config, key[0], state, e, now_ms)
        out += self._due(key[0], state, now_ms, watermark_ms)
        yield self._store(key[0], state, stored, ordinal, armed, out, now_ms, watermark_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        state, stored, ordinal, _ = self._load()
        now_ms, watermark_ms = timerValues.getCurrentProcessingTimeInMs(), timerValues.getCurrentWatermarkInMs()
        out = self._due(key[0], state, now_ms, watermark_ms)
        yield self._store(key[0], state, stored, ordinal, None, out, now_ms, watermark_ms)

    def close(self) -> None:
        pass


def run_agent_stream(envelopes: DataFrame, config: Config, delay: str = "10 seconds", operator: AgentProcessor | None = None, streams: tuple[str, ...] | None = None) -> DataFrame:
    """The streaming form of ``fold.run_agent``: append rows of the one output table. ``operator`` may stand for the usual one,
    and then picks the ``streams`` itself."""
    have = [c for c in ("entity_key", "event_time_ms", "arrival", "kind", "external_event", "tool_result", "approval", "export_request") if c in envelopes.columns]
    slim = envelopes.select(*(F.to_json(c).alias(c) if envelopes.schema[c].dataType.typeName() == "struct" else F.col(c) for c in have))
    timed = slim.withColumn("_time", F.timestamp_millis("event_time_ms")).withWatermark("_time", delay)
    return timed.groupBy("entity_key").transformWithStateInPandas(statefulProcessor=operator or AgentProcessor(config, streams), outputStructType=OUTPUT, outputMode="append", timeMode="processingTime")


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: one persisted batch, split into its streams. Sinks see the batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, sink in sinks.items():
                sink(batch.filter(F.col("stream") == name).select(*STREAMS[name]), batch_id)
        finally:
            batch.unpersist()

    return write


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A batch that is retried replaces its own folder, so a sink holds each batch once."""
    return lambda df, batch_id: df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
