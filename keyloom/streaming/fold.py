"""The kernel over a bounded table: one deterministic fold for each key, timers in time order.

Rows of a key are sorted by (event_time_ms, arrival); before each row the timers due by its time fire, in
order of time and then kind. Batch and stream share the kernel, so both give the same records.

Rows are dealt by key and sorted there, and each task folds them as they come: it holds one key's state and one
batch of rows, however many rows a key has. The rows of one key are still one task's work, as each needs the state
that the one before it left; ``sharded`` spreads keys that are too hot for that.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import operator
import threading
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bridge, kernel
from .kernel import Config, KeyState

OUTPUT = (
    "entity_key string, stream string, ordinal bigint, seq bigint, event_time_ms bigint, payload string, reason string, detail string, intent_id string, tool_name string, kind string, "
    "args_json string, step_index bigint, created_at_ms bigint, expires_at_ms bigint, trace_id string, span_id string, parent_span_id string, event_type string, attributes map<string, string>, body string"
)
_COLUMNS = [c.split()[0] for c in OUTPUT.replace("map<string, string>", "map").split(", ")]
STREAMS = {
    "output": ["entity_key", "seq", "ordinal", "payload"],
    "intents": ["entity_key", "seq", "ordinal", "intent_id", "tool_name", "kind", "args_json", "step_index", "created_at_ms", "expires_at_ms"],
    "traces": ["entity_key", "seq", "ordinal", "trace_id", "span_id", "parent_span_id", "step_index", "event_type", "event_time_ms", "attributes"],
    "errors": ["entity_key", "seq", "ordinal", "reason", "detail", "event_time_ms"],
    "snapshots": ["entity_key", "seq", "ordinal", "event_time_ms", "body"],
    "saves": ["entity_key", "seq", "ordinal", "event_time_ms", "body"],
    "metrics": ["entity_key", "seq", "ordinal", "event_time_ms", "body"],
}
OUT_ROWS = 5_000
_NONE, _NAMED = dict.fromkeys(_COLUMNS), frozenset(_COLUMNS)


def as_row(key: str, ordinal: int, r: dict) -> dict:
    """A record in the shape of the one output table; rare fields travel as JSON in ``body``."""
    out = _NONE.copy()
    for k in r.keys() & _NAMED:
        out[k] = r[k]
    out["entity_key"], out["ordinal"] = key, ordinal
    if "event_time_ms" not in r:
        out["event_time_ms"] = r.get("start_ms", r.get("snapshot_at_ms", r.get("updated_at_ms", r.get("created_at_ms"))))
    if r["stream"] in ("snapshots", "saves", "metrics"):
        out["body"] = json.dumps({k: v for k, v in r.items() if k != "stream"}, sort_keys=True, separators=(",", ":"))
    return out


def fire_due(config: Config, key: str, state: KeyState, now_ms: int) -> list[dict]:
    """All timers due by ``now_ms``, earliest first; of equal times flush, then timeout, then expiry."""
    rows: list[dict] = []
    for _ in range(10_000):
        due = [(t, k) for k, t in enumerate((state.flush_at_ms, state.hitl_at_ms, state.ttl_at_ms)) if t is not None and t <= now_ms]
        if not due:
            return rows
        at, kind = min(due)
        if kind == 0:
            rows += kernel.on_flush(config, key, state)
        elif kind == 1:
            before = state.hitl_at_ms
            rows += kernel.on_hitl(config, key, state, at, at)
            if state.hitl_at_ms == before:
                state.hitl_at_ms = None
        else:
            rows += kernel.on_ttl(config, key, state, at)
    raise RuntimeError(f"timers of {key!r} do not come to rest")


def run_key(config: Config, key: str, envelopes: list[dict], end_ms: int | None = None, state: KeyState | None = None) -> tuple[list[dict], KeyState]:
    state = state or KeyState()
    rows: list[dict] = []
    for e in sorted(envelopes, key=lambda e: (e["event_time_ms"], e["arrival"])):
        rows += fire_due(config, key, state, e["event_time_ms"])
        rows += kernel.on_envelope(config, key, state, e, e["event_time_ms"])
    if end_ms is not None:
        rows += fire_due(config, key, state, end_ms)
    return rows, state


def to_envelope(r: dict) -> dict:
    return {k: json.loads(v) if k in ("tool_result", "approval", "export_request") and isinstance(v, str) else v for k, v in r.items()}


def _batch(rows: list[dict]):
    """Records as an Arrow batch in the shape of ``OUTPUT``."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "string": pa.string(), "map": pa.map_(pa.string(), pa.string())}
    named = dict(zip(_COLUMNS, (c.split()[1] for c in OUTPUT.replace("map<string, string>", "map").split(", ")), strict=True))
    cols = []
    for name, kind in named.items():
        values = [r[name] for r in rows]
        cols.append(pa.array([None if v is None else list(v.items()) for v in values] if kind == "map" else values, kinds[kind]))
    return pa.RecordBatch.from_arrays(cols, _COLUMNS)


class _Key:
    """A key's state in a fold, and the number of its next record."""

    def __init__(self, key: str):
        self.key, self.state, self.ordinal = key, KeyState(), 0

    def taken(self, rows: list[dict], streams: tuple[str, ...] | None) -> list[dict]:
        first, self.ordinal = self.ordinal, self.ordinal + len(rows)
        return [as_row(self.key, first + i, r) for i, r in enumerate(rows) if streams is None or r["stream"] in streams]


def run_agent(envelopes: DataFrame, config: Config, end_ms: int | None = None, streams: tuple[str, ...] | None = None, overlap: int = 1) -> DataFrame:
    """Fold a table of envelopes; ``tool_result``, ``approval`` and ``export_request`` are structs or JSON. ``streams``: the
    tagged outputs that are wanted, if not all; rows of others stay in the task, and ordinals are the same. ``overlap``: so many
    keys of a task are at work by turns, one giving its turn up while its agent waits; such agents run in several threads."""

    def work(one: _Key, rows: list[dict], ended: bool) -> Iterator[dict]:
        """Records of some rows of one key, and of its timers if these are its last."""
        for r in rows:
            yield from one.taken(fire_due(config, one.key, one.state, r["event_time_ms"]), streams)
            yield from one.taken(kernel.on_envelope(config, one.key, one.state, to_envelope(r), r["event_time_ms"]), streams)
        if ended and end_ms is not None:
            yield from one.taken(fire_due(config, one.key, one.state, end_ms), streams)

    def fold(batches):
        turn, last, out = threading.Lock(), None, []

        def apart(run: tuple) -> list[dict]:
            with bridge.taking(turn):
                return list(work(*run))

        with ThreadPoolExecutor(overlap) if overlap > 1 else contextlib.nullcontext() as pool:
            for b in itertools.chain(batches, [None]):
                runs: list[list] = []
                for key, rows in itertools.groupby(b.to_pylist() if b is not None else [{"entity_key": None}], key=operator.itemgetter("entity_key")):
                    if last is None or key != last.key:
                        if last is not None:
                            runs = runs or [[last, [], False]]
                            runs[-1][2] = True
                        last = _Key(key)
                    runs.append([last, list(rows) if key is not None else [], False])
                for made in pool.map(apart, runs) if pool else itertools.starmap(work, runs):
                    for row in made:
                        out.append(row)
                        if len(out) >= OUT_ROWS:
                            yield _batch(out)
                            out.clear()
        yield _batch(out)

    known = ("entity_key", "event_time_ms", "arrival", "kind", "external_event", "tool_result", "approval", "export_request")
    have = [c for c in known if c in envelopes.columns]
    slim = envelopes.select(*(F.to_json(c).alias(c) if envelopes.schema[c].dataType.typeName() == "struct" else F.col(c) for c in have))
    slim = slim.filter(F.col("entity_key").isNotNull())
    return in_order(slim).mapInArrow(fold, OUTPUT)


def in_order(envelopes: DataFrame) -> DataFrame:
    """Dealt by key, each key's rows in order. The number of parts is given, as one that Spark adapts follows the bytes: a few
    parts for rows that are small but take long."""
    spark = envelopes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return envelopes.repartition(parts, "entity_key").sortWithinPartitions("entity_key", "event_time_ms", "arrival")


def stream_of(rows: DataFrame, name: str) -> DataFrame:
    """One of the tagged outputs."""
    return rows.filter(F.col("stream") == name).select(*STREAMS[name])


def sharded(envelopes: DataFrame, n: int, assignment: str = "hash") -> DataFrame:
    """Spread hot keys over ``n`` shards, as ``key#i``: stable ones by payload, or in turn (``round_robin``)."""
    from ..functions import ids

    if assignment not in ("hash", "round_robin"):
        raise ValueError(f"{assignment!r} is neither hash nor round_robin")
    if assignment == "round_robin":
        return envelopes.withColumn("entity_key", ids.round_robin_key(F.col("entity_key"), n))
    return envelopes.withColumn("entity_key", ids.shard_key(F.col("entity_key"), F.coalesce("external_event", F.lit("")), n))


def iterate(rows: DataFrame) -> Iterator[dict]:
    yield from (r.asDict(recursive=True) for r in rows.toLocalIterator())
