"""Rollups of the base tables: activations, traces, spans, entities. One shuffle on the key of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def number(name: str) -> Column:
    """An attribute as a number; null if it is absent or unreadable."""
    return F.expr(f"try_cast(attributes['{name}'] as bigint)")


def activations(events: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each (entity_key, seq) found in trace events or in error records with a sequence."""
    kind = F.col("event_type")
    order = F.struct("start_ms", "span_id", "event_type")
    is_start, is_end, is_error, is_llm = (kind == t for t in ("ACTIVATION_START", "ACTIVATION_END", "ERROR", "LLM_CALL"))
    has_model = is_llm & (F.coalesce(attribute("model"), F.lit("")) != "")
    tool = F.when(kind.isin("TOOL_CALL", "INTENT_EMITTED") & (F.coalesce(attribute("tool_name"), F.lit("")) != ""), attribute("tool_name"))
    ev = events.groupBy("entity_key", "seq").agg(
        F.min_by("trace_id", order).alias("trace_id"),
        F.collect_set(F.when(is_start, F.col("span_id"))).alias("start_spans"),
        F.collect_set(F.when(is_end, F.col("span_id"))).alias("end_spans"),
        F.max(F.when(is_error, F.col("start_ms"))).alias("error_ms"),
        F.count_if(is_error).alias("error_events"),
        F.max_by(attribute("status"), F.when(is_end, order)).alias("end_status"),
        F.max(F.when(is_end, order))["start_ms"].alias("end_ms"),
        F.max_by(attribute("kind"), F.when(is_start, order)).alias("start_kind"),
        F.max_by(attribute("kind"), F.when(is_end, order)).alias("end_kind"),
        F.min("start_ms").alias("first_ms"),
        F.min(F.when(is_start, F.col("start_ms"))).alias("first_start_ms"),
        F.max_by(attribute("model"), F.when(has_model, order)).alias("model"),
        F.count_if(is_llm).alias("llm_calls"),
        F.count_if(kind == "TOOL_CALL").alias("tool_calls"),
        F.count_if(kind == "INTENT_EMITTED").alias("intents"),
        F.sum(F.when(is_llm, number("input_tokens"))).alias("prompt_tokens"),
        F.sum(F.when(is_llm, number("output_tokens"))).alias("completion_tokens"),
        F.count_if(is_llm & (attribute("cache_hit") == "true")).alias("cache_hits"),
        F.collect_set(tool).alias("tools"),
        F.collect_set(F.when(is_error & (F.coalesce(attribute("reason"), F.lit("")) != ""), attribute("reason"))).alias("event_reasons"),
        F.collect_set("provenance").alias("event_provenance"),
        F.count("*").alias("events"),
    )
    er = errors.filter(F.col("seq").isNotNull()).groupBy("entity_key", "seq").agg(
        F.count("*").alias("records"), F.max("event_time_ms").alias("record_ms"), F.min("event_time_ms").alias("first_record_ms"),
        F.collect_set(F.when(F.col("reason") != "", F.col("reason"))).alias("record_reasons"), F.collect_set("provenance").alias("record_provenance"),
    )
    a = ev.join(er, ["entity_key", "seq"], "full_outer")
    none = F.array().cast("array<string>")
    starts, ends = F.coalesce("start_spans", none), F.coalesce("end_spans", none)
    failed_ms = F.greatest("error_ms", "record_ms")
    ended_well = (F.size(ends) > 0) & (F.size(F.array_except(starts, ends)) == 0)
    declared = F.col("end_status").isin("completed", "suspended")
    status = F.when(failed_ms.isNotNull(), "error").when(ended_well & declared, F.col("end_status")).otherwise("in_flight")
    ended = F.when(failed_ms.isNotNull(), failed_ms).when(ended_well & declared, F.col("end_ms"))
    kind_name = F.when(F.size(starts) > 0, F.col("start_kind")).otherwise(F.col("end_kind"))
    wall = ended - F.col("first_start_ms")
    both = F.array_union(F.coalesce("event_provenance", none), F.coalesce("record_provenance", none))
    return a.select(
        "entity_key", "seq",
        F.coalesce("trace_id", ids.trace_id(F.col("entity_key"), F.col("seq"))).alias("trace_id"),
        status.alias("status"),
        F.when(kind_name.isin("start", "resume"), kind_name).otherwise("unknown").alias("kind"),
        F.greatest(F.size(F.array_union(starts, ends)), F.lit(1)).cast("bigint").alias("attempts"),
        F.least("first_ms", "first_record_ms").alias("started_ms"),
        ended.alias("ended_ms"),
        F.when(wall > 0, wall).alias("wall_ms"),
        "model",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("llm_calls", "tool_calls", "intents")),
        F.greatest(F.coalesce("error_events", F.lit(0)), F.coalesce("records", F.lit(0))).alias("errors"),
        "prompt_tokens", "completion_tokens",
        F.when(F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull(), F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("total_tokens"),
        F.coalesce("cache_hits", F.lit(0)).alias("cache_hits"),
        F.array_sort(F.coalesce("tools", none)).alias("tools"),
        F.array_sort(F.array_union(F.coalesce("event_reasons", none), F.coalesce("record_reasons", none))).alias("reasons"),
        F.array_sort(both).alias("provenance"),
        ((F.size(starts) > 0) | ~F.array_contains(both, "otlp")).alias("complete_provenance"),
    )


def traces(events: DataFrame) -> DataFrame:
    return events.groupBy("trace_id").agg(F.max("entity_key").alias("entity_key"), F.max("seq").alias("seq"), F.min("start_ms").alias("started_ms"), F.max("start_ms").alias("last_event_ms"), F.count("*").alias("events"), F.count_distinct("span_id").alias("spans"))


def spans(events: DataFrame) -> DataFrame:
    own = F.col("event_type").isin("ACTIVATION_START", "ACTIVATION_END")
    return events.groupBy("trace_id", "span_id").agg(
        F.max("parent_span_id").alias("parent_span_id"), F.max("entity_key").alias("entity_key"), F.max("seq").alias("seq"),
        F.when(F.bool_or(own), "activation").otherwise(F.min("event_type")).alias("role"),
        F.min("step_index").alias("step_index"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.count("*").alias("events"),
    )


def entities(acts: DataFrame, errors: DataFrame) -> DataFrame:
    a = acts.groupBy("entity_key").agg(
        F.count("*").alias("activations"), F.min("started_ms").alias("a_first"), F.max(F.coalesce("ended_ms", "started_ms")).alias("a_last"),
        F.sum("errors").alias("a_errors"), F.sum("total_tokens").alias("total_tokens"), F.max("seq").alias("latest_seq"), F.max_by("status", "seq").alias("latest_status"),
    )
    e = errors.groupBy("entity_key").agg(F.min("event_time_ms").alias("e_first"), F.max("event_time_ms").alias("e_last"), F.count_if(F.col("seq").isNull()).alias("unscoped"))
    return a.join(e, "entity_key", "full_outer").select(
        "entity_key", F.least("a_first", "e_first").alias("first_seen_ms"), F.greatest("a_last", "e_last").alias("last_seen_ms"),
        F.coalesce("activations", F.lit(0)).alias("activations"), (F.coalesce("a_errors", F.lit(0)) + F.coalesce("unscoped", F.lit(0))).alias("errors"),
        "total_tokens", "latest_seq", "latest_status",
    )


def facets(acts: DataFrame, column: str) -> DataFrame:
    """Distinct members of ``tools`` or ``reasons`` of each activation."""
    return acts.select("entity_key", "seq", F.explode(column).alias("member")).distinct()
