"""Idempotent merge of late and repeated telemetry.

Every operator is one aggregation with map-side combination: whatever the order or repetition of batches, the
same rows come out, given an ``arrival`` column that says which copy is later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_KEY = ("trace_id", "span_id", "event_type")
SNAPSHOT_KEY = ("entity_key", "seq", "request_id", "snapshot_at_ms")


def later(value: str, keep_if: Column | None = None) -> Column:
    """The value of the latest copy; with ``keep_if``, of the latest copy that satisfies it.

    The condition belongs to the ordering: max_by keeps a null value at the top but skips null orderings.
    """
    arrival = F.col("arrival") if keep_if is None else F.when(keep_if, F.col("arrival"))
    return F.max_by(value, arrival)


def merge_events(raw: DataFrame, *more: Column) -> DataFrame:
    """One row for each (trace, span, type). A later copy wins, but blanks and zeros erase nothing and a lossy
    copy replaces neither provenance nor place of a lossless one. Attribute keys are never dropped. ``more``: further aggregates."""
    base = raw.groupBy(*EVENT_KEY).agg(
        F.coalesce(later("parent_span_id", F.col("parent_span_id") != ""), F.lit("")).alias("parent_span_id"),
        F.coalesce(later("entity_key", F.col("entity_key") != ""), F.lit("")).alias("entity_key"),
        F.coalesce(later("seq", F.col("provenance") != "otlp"), later("seq")).alias("seq"),
        F.coalesce(later("step_index", F.col("provenance") != "otlp"), later("step_index")).alias("step_index"),
        F.coalesce(later("start_ms", F.col("start_ms") != 0), F.lit(0)).cast("bigint").alias("start_ms"),
        F.coalesce(later("end_ms", F.col("end_ms") != 0), F.lit(0)).cast("bigint").alias("end_ms"),
        F.coalesce(later("provenance", F.col("provenance") != "otlp"), later("provenance")).alias("provenance"),
        F.count("*").alias("copies"),
        *more,
    )
    return base


def merge_attributes(raw: DataFrame) -> DataFrame:
    """One row for each (trace, span, type, attribute): the last value."""
    each = raw.select(*EVENT_KEY, "arrival", F.explode("attributes").alias("attribute", "value"))
    return each.groupBy(*EVENT_KEY, "attribute").agg(later("value").alias("value"))


def merged(raw: DataFrame, *more: Column) -> DataFrame:
    """Events and attributes together, in the shape of a trace event, and ``more`` aggregates."""
    maps = merge_attributes(raw).groupBy(*EVENT_KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("attributes"))
    return merge_events(raw, F.max("arrival").alias("arrival"), *more).drop("copies").join(maps, list(EVENT_KEY), "left")


def merge_errors(raw: DataFrame) -> DataFrame:
    """One row for each error identity; only the provenance may change, and never to a lossy one."""
    same = ("entity_key", "seq", "reason", "detail", "event_time_ms")
    return raw.groupBy("error_id").agg(*(F.first(c).alias(c) for c in same), F.coalesce(later("provenance", F.col("provenance") != "otlp"), later("provenance")).alias("provenance"))


def merge_snapshots(raw: DataFrame) -> DataFrame:
    rest = [c for c in raw.columns if c not in (*SNAPSHOT_KEY, "arrival", "raw")]
    kept = [later("raw", F.length("raw") > 0).alias("raw")] if "raw" in raw.columns else []
    return raw.groupBy(*SNAPSHOT_KEY).agg(*(later(c).alias(c) for c in rest), *kept)


def changed(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The incoming rows that would change the stored table: new keys, or other values under a known key."""
    cols = [c for c in incoming.columns if c in stored.columns]
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in cols))
    return incoming.withColumn("_row", row).join(stored.select(*key, row.alias("_row")), [*key, "_row"], "left_anti").drop("_row")


def normalise_error_seq(records: DataFrame) -> DataFrame:
    """The activation number that some error details carry: JSON for dead letters, ``seq=n`` for timers."""
    text = F.regexp_extract("detail", r"(?:\A|[\s,;])seq=(-?\d+)", 1)
    parsed = F.when(F.col("reason") == "intent_dead_letter", F.expr("try_cast(get_json_object(detail, '$.seq') as bigint)")).when(F.col("reason").isin("ttl_wiped_suspension", "hitl_timeout"), F.expr("1") * F.when(text != "", text).cast("bigint"))
    return records.withColumn("seq", F.coalesce(F.col("seq"), parsed))


def retained(df: DataFrame, time_col: str, now_ms: int, retention_ms: int) -> DataFrame:
    """What retention keeps. Rollups are derived, so pruning base tables is all there is to do."""
    return df.filter(F.col(time_col) >= now_ms - retention_ms)
