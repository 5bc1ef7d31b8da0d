"""Counters and distributions of the runtime, from the ``metrics`` records of a fold or a stream.

An activation's record is emitted with its other records and only if it commits, so the counters agree with the
records: ``activations`` with ACTIVATION_END traces, ``intents_emitted`` with intents, ``agent_errors`` and
``orphaned_results`` together with errors, ``batch_flushes_*`` with samples of ``batch_size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names under which the runtime is observed.
COUNTERS = [
    "activations", "llm_calls", "tool_calls", "intents_emitted", "agent_errors", "suspensions", "orphaned_results", "longterm_upserts",
    "events_buffered", "batch_flushes_size", "batch_flushes_timer",
]
DISTRIBUTIONS = ["activation_ms", "overhead_ms", "llm_ms", "tokens", "prompt_tokens", "completion_tokens", "memory_bytes", "iterations", "batch_size"]

_BODY = "counters map<string, bigint>, samples map<string, array<bigint>>"


def moved(body: Column) -> Column:
    """The counters of one metrics record, as a map."""
    return F.from_json(body, _BODY)["counters"]


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """Rows ``(*by, name, value)``: sums of the counters that moved. ``rows``: the one output table."""
    m = rows.filter("stream = 'metrics'").withColumn("m", F.from_json("body", _BODY))
    return m.select(*by, F.explode("m.counters").alias("name", "value")).groupBy(*by, "name").agg(F.sum("value").alias("value"))


def distributions(rows: DataFrame, *by: str) -> DataFrame:
    """Rows ``(*by, name, count, total, smallest, largest)`` of all samples."""
    m = rows.filter("stream = 'metrics'").withColumn("m", F.from_json("body", _BODY))
    each = m.select(*by, F.explode("m.samples").alias("name", "values")).select(*by, "name", F.explode("values").alias("value"))
    return each.groupBy(*by, "name").agg(F.count("*").alias("count"), F.sum("value").alias("total"), F.min("value").alias("smallest"), F.max("value").alias("largest"))


def summary(rows: DataFrame) -> dict[str, dict]:
    """All metrics of a bounded run, with zeros for what never moved: twenty small numbers on the driver."""
    seen = {r["name"]: r["value"] for r in counters(rows).collect()}
    sampled = {r["name"]: r.asDict() for r in distributions(rows).collect()}
    none = {"count": 0, "total": 0, "smallest": None, "largest": None}
    return {"counters": {n: seen.get(n, 0) for n in COUNTERS}, "distributions": {n: {k: v for k, v in (sampled.get(n) or none).items() if k != "name"} for n in DISTRIBUTIONS}}
