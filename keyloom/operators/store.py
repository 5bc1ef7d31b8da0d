"""The record tables and their rollups, kept on storage and brought up to date batch by batch.

Tables are ``segments``: events by trace, errors, snapshots and rollups by entity. A batch is merged by the rules of ``merge``
with the stored rows of its own keys; the rows that change are counted and appended, and so are the rollups of the activations,
traces and entities that they touch. Readers see a batch whole or not at all, and a job that fails or is retried leaves only
folders that no version names.

``sink`` makes the store the target of a stream: the batch's token is committed in the version that holds its rows, so a batch
that is replayed after a crash changes nothing, whatever the crash left behind. Several streams and other writers may
share a store.

The events of an activation are found by the trace that its key and sequence give (``ids.trace_id``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import ids
from ..schemas import ERROR_RECORD, SNAPSHOT, TRACE_EVENT
from . import merge, rollups
from .segments import Segments, State

IDENTITY = {"events": list(merge.EVENT_KEY), "errors": ["error_id"], "snapshots": list(merge.SNAPSHOT_KEY)}
#: The first column deals rows into buckets.
KEYS = {"events": list(merge.EVENT_KEY), "errors": ["entity_key", "error_id"], "snapshots": list(merge.SNAPSHOT_KEY), "activations": ["entity_key", "seq"], "traces": ["trace_id"], "entities": ["entity_key"]}
TIMES = {"events": "start_ms", "errors": "event_time_ms", "snapshots": "snapshot_at_ms"}
_KEYED = "entity_key <> ''"  # a lossy copy whose other half has not come yet belongs to no activation
DDL = {"events": TRACE_EVENT, "errors": ERROR_RECORD, "snapshots": SNAPSHOT}
ATTEMPTS = 20


class RecordStore:
    """Any number of readers and writers; writers that meet start again from what the other has stored."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fanout: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.segments = Segments(spark, path, KEYS, TIMES, buckets, fanout)
        self._schemas: dict[str, StructType] = {}

    # reading

    def table(self, name: str) -> DataFrame:
        """A table as of the last version: events, errors, snapshots, or a rollup."""
        return self.segments.read(name, self.schema(name), self.segments.current())

    def schema(self, name: str) -> StructType:
        if not self._schemas:
            none = {t: self.spark.createDataFrame([], d) for t, d in DDL.items()}
            self._schemas = {t: df.schema for t, df in none.items()} | {t: df.schema for t, df in self._rollups(none["events"], none["errors"]).items()}
        return self._schemas[name]

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def errors(self) -> DataFrame:
        return self.table("errors")

    @property
    def snapshots(self) -> DataFrame:
        return self.table("snapshots")

    def tokens(self) -> dict[str, int]:
        """The last batch of each query that is in the store."""
        return self.segments.current().tokens

    @staticmethod
    def _rollups(events: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
        acts = rollups.activations(events, errors)
        return {"activations": acts, "traces": rollups.traces(events), "entities": rollups.entities(acts, errors)}

    # writing

    def write(self, events: DataFrame | None = None, errors: DataFrame | None = None, snapshots: DataFrame | None = None, token: tuple[str, int] | None = None) -> int:
        """Merge a batch; returns how many records it added or changed: 0 for one that was there already.

        ``arrival`` orders copies inside the batch; later batches come after all earlier ones. ``token``: the query and number
        of a batch that may come again; numbers of a query grow.
        """
        given = {t: df for t, df in (("events", events), ("errors", errors), ("snapshots", snapshots)) if df is not None}
        scratch = _Scratch(self, "write")
        try:
            batch = {t: scratch.put(t, self._shaped(t, df)) for t, df in given.items()}
            for _ in range(ATTEMPTS):
                state = self.segments.current().next()
                if token is not None and state.tokens.get(token[0], -1) >= token[1]:
                    return 0
                changed = self._merge(batch, state, _Scratch(self, f"merge-{state.number}", scratch))
                if token is not None:
                    state.tokens[token[0]] = token[1]
                elif not changed:
                    return 0
                if self.segments.commit(state):
                    self.segments.compact({t: self.schema(t) for t in KEYS})
                    return changed
        finally:
            scratch.drop()
        raise RuntimeError(f"other writers came first in {ATTEMPTS} attempts")

    def _shaped(self, table: str, df: DataFrame) -> DataFrame:
        """The columns of a table, absent ones null; a null in the key counts as empty or zero."""
        def column(f):
            c = (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType)
            none = F.lit("" if f.dataType.typeName() == "string" else 0).cast(f.dataType)
            return (F.coalesce(c, none) if f.name in KEYS[table] else c).alias(f.name)

        return df.select(*map(column, self.schema(table).fields))

    def _merge(self, batch: dict[str, DataFrame], state: State, scratch: _Scratch) -> int:
        changed, hit = 0, {}
        for table, rows in batch.items():
            rows = rows.withColumn("arrival", F.lit(state.number << 40) + F.coalesce("arrival", F.lit(0)))
            key, schema = KEYS[table], self.schema(table)
            stored = self.segments.read(table, schema, state, rows.select(*key))
            # what a stored row says goes through the merge with it, so it is read and dealt once
            both = stored.withColumn("_was", _hash(key, schema)).unionByName(rows.withColumn("_was", F.lit(None).cast("bigint")))
            merged = self._merged(table, both).withColumn("_row", _hash(key, schema))
            fresh = scratch.put(f"fresh-{table}", merged.filter(~F.col("_row").eqNullSafe(F.col("_was"))).select(*schema.names))
            n = fresh.count()
            if n:
                self.segments.append(table, fresh, state)
                changed, hit[table] = changed + n, fresh
        if hit:
            self._recompute(state, hit, scratch)
        return changed

    def _merged(self, table: str, both: DataFrame) -> DataFrame:
        was = F.max("_was").alias("_was")
        if table == "events":
            return merge.merged(both, was)
        out = merge.merge_errors(both) if table == "errors" else merge.merge_snapshots(both.drop("_was"))
        return out.join(both.groupBy(*IDENTITY[table]).agg(F.max("arrival").alias("arrival"), was), IDENTITY[table])

    def _read(self, table: str, state: State, keys: DataFrame) -> DataFrame:
        """Rows with the given keys (columns that the table's key begins with), from the buckets that may hold them."""
        return self.segments.read(table, self.schema(table), state, keys)

    def _recompute(self, state: State, hit: dict[str, DataFrame], scratch: _Scratch) -> None:
        """Rollups of what a batch touched."""
        traces = scratch.put("traces", hit["events"].select("trace_id").distinct()) if "events" in hit else None
        entities = None
        if traces is not None:
            own = self._read("events", state, traces)
            entities = own.select("entity_key").distinct()
        if "errors" in hit:
            own = hit["errors"].select("entity_key").distinct()
            entities = own if entities is None else entities.union(own).distinct()
        if entities is None:
            return
        self._roll(state, scratch.put("entities", entities), traces, scratch)

    def _roll(self, state: State, entities: DataFrame, traces: DataFrame | None, scratch: _Scratch, gone: dict[str, DataFrame] | None = None) -> None:
        """Rows of rollups for some entities and traces; ``gone``: keys of rollups that go unless they come again."""
        gone = gone or {}
        # Events of an activation share the trace that its key and sequence give, so errors lead to buckets of events.
        errors = scratch.put("own-errors", self._read("errors", state, entities))
        of_error = ids.trace_id(F.col("entity_key"), F.col("seq"))
        asked = errors.filter("seq is not null").select(of_error.alias("trace_id"))
        traced = scratch.put("traced", (asked if traces is None else asked.union(traces)).distinct())
        events = scratch.put("own-events", self._read("events", state, traced))
        acts = rollups.activations(events.filter(_KEYED), errors.filter("seq is not null").join(traced, of_error == F.col("trace_id"), "left_semi"))
        self._replace("activations", acts, state, scratch, gone.get("activations"))
        if traces is not None:
            self._replace("traces", rollups.traces(events.join(traces, "trace_id", "left_semi")), state, scratch, gone.get("traces"))
        kept = self._read("activations", state, entities)
        self._replace("entities", rollups.entities(kept, errors), state, scratch, gone.get("entities"))

    def _replace(self, table: str, rows: DataFrame, state: State, scratch: _Scratch, gone: DataFrame | None) -> None:
        if gone is not None:
            rows = scratch.put(f"new-{table}", rows)
            gone = scratch.put(f"gone-{table}", gone.select(*KEYS[table]).distinct().join(rows.select(*KEYS[table]), KEYS[table], "left_anti"))
        self.segments.append(table, rows, state, gone)

    # retention and upkeep

    def prune(self, now_ms: int, retention_ms: int) -> int:
        """Remove records older than the retention and bring the rollups of what they belonged to up to date.

        Segments that are old as a whole are forgotten without being rewritten; rows of others are marked as removed.
        Returns the number of records removed.
        """
        cut = now_ms - retention_ms
        for _ in range(ATTEMPTS):
            before = self.segments.current()
            state, removed, old, scratch = before.next(), 0, {}, _Scratch(self, "prune")
            try:
                for table, time in TIMES.items():
                    schema, key = self.schema(table), KEYS[table]
                    held = scratch.put(f"held-{table}", self.segments.raw(table, schema, before).filter(F.col(time) < cut).select(*key).distinct())
                    found = self._read(table, before, held.select(key[0]).distinct()).join(held, key, "left_semi").filter(F.col(time) < cut)
                    old[table] = scratch.put(f"old-{table}", found)
                    n = old[table].count()
                    if not n:
                        continue
                    removed += n
                    self.segments.drop_before(table, cut, state)
                    self.segments.append(table, old[table].limit(0), state, self._raw_keys(table, state, old[table]))
                if not removed:
                    return 0
                keyed = lambda t: old[t].filter("seq is not null").select("entity_key", "seq")  # noqa: E731, B023
                traces = scratch.put("old-traces", old["events"].select("trace_id").distinct())
                entities = scratch.put("old-entities", old["events"].select("entity_key").union(old["errors"].select("entity_key")).distinct())
                acts = keyed("events").union(keyed("errors")).distinct()
                of = acts.select(ids.trace_id(F.col("entity_key"), F.col("seq")).alias("trace_id")).union(traces).distinct()
                self._roll(state, entities, scratch.put("rolled", of), scratch, {"activations": acts.filter(_KEYED), "traces": of, "entities": entities.filter(_KEYED)})
                if self.segments.commit(state):
                    return removed
            finally:
                scratch.drop()
        raise RuntimeError(f"other writers came first in {ATTEMPTS} attempts")

    def _raw_keys(self, table: str, state: State, rows: DataFrame) -> DataFrame:
        """Those of the keys that segments of this version still hold."""
        key = KEYS[table]
        return self.segments.raw(table, self.schema(table), state, self.segments.places(table, rows.select(*key), state)[0]).select(*key).distinct().join(rows.select(*key), key, "left_semi")

    def compact(self) -> int:
        """Merge all segments of each bucket into one; the number of buckets merged."""
        return self.segments.compact({t: self.schema(t) for t in KEYS}, whole=True)

    def vacuum(self) -> None:
        """Remove what the last version does not name. No reader of an older version may be left, and no writer at work."""
        self.segments.vacuum()
        self.segments.folder.delete("_scratch")

    # streams

    def sink(self, query: str | None = None, kind: str | None = None, done: Callable[[int, int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that stores each batch exactly once.

        ``kind``: the batches are ``events``, ``errors`` or ``snapshots``; without it they are rows of ``processor.run_agent_stream``,
        whose traces, errors and snapshots go into one version. ``query``: a name that stays the same when the query is started
        again; the stream's own id, which its checkpoint keeps, if it is not given. ``done(batch, changed)`` is told the outcome.
        """

        def store(batch: DataFrame, number: int) -> None:
            own = query or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            if not own:
                raise ValueError("the stream has no id here: name the query")
            if self.tokens().get(own, -1) >= number:
                changed = 0
            else:
                tables = {kind: batch} if kind else from_output(batch)
                changed = self.write(**tables, token=(own, number))
            if done is not None:
                done(number, changed)

        return store


def _hash(key: list[str], schema: StructType) -> Column:
    """A hash of all but the key and the arrival."""
    value = lambda f: F.map_from_entries(F.array_sort(F.map_entries(f.name))).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name)
    return F.xxhash64(*(F.to_json(F.struct(value(f))) for f in schema.fields if f.name not in (*key, "arrival")))


def from_output(rows: DataFrame) -> dict[str, DataFrame]:
    """Records of the kernel's one output table as batches of the store."""
    arrival = F.coalesce("ordinal", F.lit(0)).cast("long")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    of = lambda name: rows.filter(F.col("stream") == name)
    time = F.coalesce("event_time_ms", F.lit(0))
    events = of("traces").select(
        "trace_id", "span_id", text("parent_span_id"), text("entity_key"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("step_index", F.lit(0)).alias("step_index"),
        "event_type", time.alias("start_ms"), time.alias("end_ms"), "attributes", F.lit("native").alias("provenance"), arrival.alias("arrival"),
    )
    errors = of("errors").select(text("entity_key"), "seq", "reason", text("detail"), time.alias("event_time_ms"), F.lit("native").alias("provenance"), arrival.alias("arrival"))
    errors = merge.normalise_error_seq(errors).withColumn("error_id", ids.error_id(F.col("entity_key"), F.col("seq"), F.col("reason"), F.col("event_time_ms"), F.col("detail")))
    snapshots = of("snapshots").select(F.from_json("body", SNAPSHOT).alias("s"), "entity_key", arrival.alias("_at")).select(
        F.col("entity_key"), *(F.col(f"s.{f.name}") for f in StructType.fromDDL(SNAPSHOT).fields if f.name not in ("entity_key", "provenance", "arrival")), F.lit("native").alias("provenance"), F.col("_at").alias("arrival")
    )
    return {"events": events, "errors": errors, "snapshots": snapshots}


class _Scratch:
    """Tables that one write reads several times, in a folder of its own."""

    def __init__(self, store: RecordStore, what: str, within: _Scratch | None = None):
        self.store = store
        self.name = f"{within.name if within else '_scratch'}/{what}-{uuid.uuid4().hex[:8]}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.store.path}/{self.name}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self.store.segments.folder.delete(self.name)
