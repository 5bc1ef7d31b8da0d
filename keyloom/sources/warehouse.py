"""Trace rows of a warehouse table, read window by window: a streaming source whose offset is a watermark of event time.

A window reaches from the last watermark, less an overlap for rows that came late, to the present time, its end excluded; the first
one begins a lookback before. Merging makes the overlap harmless. The table is a folder of Parquet files, in day folders
``event_date=YYYY-MM-DD`` or not, as ``ingest.warehouse_rows`` writes it. Day folders and row groups outside the window are
not read. A task reads one row group, batch by batch.

    spark.dataSource.register(warehouse.WindowedTraces)
    spark.readStream.format("trace-windows").option("path", ...).option("lookbackMs", ...).load()

Rows come as trace events of the given provenance, with ``problem``: null, or why the row is no trace event; then ``row`` holds it.
``split`` takes a batch apart. A window in which time has not moved on reads nothing.
"""

from __future__ import annotations

import datetime
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import EVENT_TYPES, PROVENANCES, TRACE_EVENT

LOOKBACK_MS, OVERLAP_MS = 24 * 3600_000, 60_000
SCHEMA = f"{TRACE_EVENT}, problem string, row string"
_TEXT = ("trace_id", "span_id", "parent_span_id", "entity_key")
_NUMBERS = ("seq", "step_index", "start_ms", "end_ms")
_FIELDS = ("trace_id", "span_id", "parent_span_id", "entity_key", "seq", "step_index", "event_type", "start_ms", "end_ms", "attributes", "provenance", "arrival")


@dataclass
class RowGroup(InputPartition):
    """A row group of one file, and the window that its rows must lie in."""

    path: str
    group: int
    begin: int
    end: int


def event_of(row: dict, provenance: str) -> dict:
    """A row as a trace event; ValueError if it is none. Null means the default."""
    kind = row.get("event_type")
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type: {kind!r}")
    out = {c: row.get(c) or "" for c in _TEXT}
    if not out["trace_id"] or not out["span_id"] or not all(isinstance(v, str) for v in out.values()):
        raise ValueError("no trace or span")
    for c in _NUMBERS:
        value = row.get(c)
        if value is not None and (isinstance(value, bool) or not isinstance(value, int)):
            raise ValueError(f"{c} is no whole number: {value!r}")
        out[c] = value or 0
    pairs = row.get("attributes") or []
    try:
        attributes = {p["key"]: p["value"] for p in pairs} if isinstance(pairs, list) and all(isinstance(p, dict) for p in pairs) else dict(pairs)
    except (KeyError, TypeError) as e:
        raise ValueError(f"attributes are no pairs: {e}") from e
    if not all(isinstance(k, str) for k in attributes):
        raise ValueError("an attribute has no name")
    return out | {"event_type": kind, "attributes": attributes, "provenance": provenance, "arrival": row.get("arrival") or 0}


class WindowReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default: int(options.get(name.lower(), options.get(name, default)))
        self.path = options.get("path", "")
        self.lookback, self.overlap, self.every = number("lookbackMs", LOOKBACK_MS), number("overlapMs", OVERLAP_MS), number("everyMs", 1)
        self.time = options.get("timecolumn", options.get("timeColumn", "start_ms"))
        self.provenance = options.get("provenance", "bigquery")
        self.until = number("until", -1)
        self.clock_file = options.get("clockfile", options.get("clockFile"))
        if not self.path or min(self.lookback, self.every) < 1 or self.overlap < 0 or self.provenance not in PROVENANCES:
            raise ValueError("trace-windows needs a path, a positive lookback and interval, and a known provenance")
        self.last = 0

    def _now(self) -> int:
        if self.until >= 0:
            return self.until
        if self.clock_file:
            with open(self.clock_file, encoding="utf-8") as f:
                return int(f.read())
        return time.time_ns() // 1_000_000

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        now = self._now()
        if now >= self.last + self.every:
            self.last = now
        return {"until": self.last}

    def window(self, start: dict, end: dict) -> tuple[int, int]:
        """Half-open, and empty if time has not moved on."""
        if end["until"] <= start["until"]:
            return end["until"], end["until"]
        begin = start["until"] - self.overlap if start["until"] else end["until"] - self.lookback
        return max(0, begin), end["until"]

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        self.last = max(self.last, start["until"], end["until"])
        begin, stop = self.window(start, end)
        if begin >= stop:
            return []
        fs, top = pyarrow.fs.FileSystem.from_uri(self.path) if ":" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        day = lambda ms: str(datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).date())
        out = []
        for f in fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True)):
            own = re.search(r"/event_date=(\d{4}-\d\d-\d\d)/", f.path)
            if not f.path.endswith(".parquet") or (own and not day(begin) <= own[1] <= day(stop - 1)):
                continue
            with fs.open_input_file(f.path) as file:
                meta = pq.ParquetFile(file).metadata
            at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == self.time), None)
            for g in range(meta.num_row_groups):
                s = None if at is None else meta.row_group(g).column(at).statistics
                if s is None or not s.has_min_max or (s.max >= begin and s.min < stop):
                    out.append(RowGroup(f.path, g, begin, stop))
        return out

    def read(self, partition: RowGroup) -> Iterator[tuple]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        fs = pyarrow.fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else pyarrow.fs.LocalFileSystem()
        with fs.open_input_file(partition.path) as file:
            for b in pq.ParquetFile(file).iter_batches(4096, row_groups=[partition.group]):
                for row in b.to_pylist():
                    at = row.get(self.time)
                    if isinstance(at, int) and not partition.begin <= at < partition.end:
                        continue
                    try:
                        event = event_of(row, self.provenance)
                        yield (*(event[n] for n in _FIELDS), None, None)
                    except ValueError as e:
                        yield (*(None for _ in _FIELDS), str(e), json.dumps(row, default=str, sort_keys=True))


class WindowedTraces(DataSource):
    """Streaming source ``trace-windows``. Options: path; lookbackMs, overlapMs, everyMs, timeColumn, provenance; until: a fixed
    present time, or clockFile: a file that holds it."""

    @classmethod
    def name(cls) -> str:
        return "trace-windows"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> WindowReader:  # noqa: N802
        return WindowReader(dict(self.options))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trace events, and the rows that are none with what is wrong with them."""
    return rows.filter("problem is null").drop("problem", "row"), rows.filter("problem is not null").select("problem", "row")
