"""A stream whose two clocks are scripted: elements, steps of the watermark and steps of processing time, each a batch of its own.

    script = Script().add(envelope).add(other).clock(60_000).watermark(FOREVER)
    stream = run(spark, script, config, path)

The operator reads both clocks from its rows. A step of a clock is a row for each key that the script has named by then, so timers
that are due fire in that batch and no other, without waiting. Elements move no clock. Both clocks begin at zero and never go
back. With no timers of Spark's own the stream ends under ``availableNow``, and a run is the same each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import kernel
from .fold import OUTPUT, to_envelope
from .kernel import Config
from .processor import AgentProcessor

FOREVER = 1 << 61
TICK = "tick"
SCHEMA = (
    "entity_key string, event_time_ms bigint, arrival bigint, kind string, external_event string, tool_result string, approval string, export_request string, "
    "now_ms bigint, watermark_ms bigint"
)


@dataclass
class Script:
    """Steps in order; each method adds one and returns the script."""

    steps: list[list[tuple]] = field(default_factory=list)
    now_ms: int = 0
    watermark_ms: int = 0
    keys: dict[str, None] = field(default_factory=dict)
    arrival: int = 0

    def add(self, *envelopes: dict) -> Script:
        """Envelopes that come in one batch; parts that are structs are given as dicts."""
        import json

        rows = []
        for e in envelopes:
            self.keys[e["entity_key"]] = None
            self.arrival += 1
            parts = [json.dumps(e[c]) if isinstance(e.get(c), dict) else e.get(c) for c in ("tool_result", "approval", "export_request")]
            rows.append((e["entity_key"], e["event_time_ms"], e.get("arrival", self.arrival), e.get("kind", "external_event"), e.get("external_event"), *parts, self.now_ms, self.watermark_ms))
        self.steps.append(rows)
        return self

    def clock(self, advance_ms: int) -> Script:
        if advance_ms < 0:
            raise ValueError("processing time does not go back")
        self.now_ms += advance_ms
        return self._tick()

    def watermark(self, at_ms: int) -> Script:
        if at_ms < self.watermark_ms:
            raise ValueError("a watermark does not go back")
        self.watermark_ms = at_ms
        return self._tick()

    def _tick(self) -> Script:
        self.steps.append([(k, 0, 0, TICK, None, None, None, None, self.now_ms, self.watermark_ms) for k in self.keys])
        return self


class ScriptedProcessor(AgentProcessor):
    """The streaming operator with its clocks in the rows."""

    def _arm(self, armed: int | None, at: int | None) -> int | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        state, stored, ordinal, armed = self._load()
        records = [r for pdf in rows for r in pdf.to_dict("records")]
        now_ms, watermark_ms = (max(int(r[c]) for r in records) for c in ("now_ms", "watermark_ms"))
        out = self._expired(key[0], state, watermark_ms)
        found = [to_envelope({k: v for k, v in r.items() if k not in ("now_ms", "watermark_ms")}) for r in records if r["kind"] != TICK]
        for e in sorted(found, key=lambda e: (e["event_time_ms"], e["arrival"])):
            out += kernel.on_envelope(self.config, key[0], state, e, now_ms)
        out += self._due(key[0], state, now_ms, watermark_ms)
        yield self._store(key[0], state, stored, ordinal, armed, out, now_ms, watermark_ms)


def source(spark: SparkSession, script: Script, path: str) -> DataFrame:
    """The script as a stream, a batch for each step that has rows."""
    for k, rows in enumerate(s for s in script.steps if s):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/step={k:06}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def run(spark: SparkSession, script: Script, config: Config, path: str) -> DataFrame:
    """The operator over the script: rows of the one output table."""
    stream = source(spark, script, path)
    return stream.groupBy("entity_key").transformWithStateInPandas(statefulProcessor=ScriptedProcessor(config), outputStructType=OUTPUT, outputMode="append", timeMode="none")
