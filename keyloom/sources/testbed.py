"""The record model over the synthetic tables: envelopes, traces, errors, snapshots and outcomes from ``events`` and ``orders``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..schemas import REASONS

PER_ACTIVATION = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _some(**values: Column) -> Column:
    """A map of the attributes that have a value."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with key, time, activation number and step: five events of a user to an activation."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("etype"), "value", "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        ids.hex_key(F.col("user_id").cast("string")).alias("entity_key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "ts",
    )
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.withColumn("rn", rn).select("*", F.floor(F.col("rn") / PER_ACTIVATION).cast("bigint").alias("seq"), (F.col("rn") % PER_ACTIVATION).cast("bigint").alias("step")).drop("rn", "ts")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One external event for each row of ``events``."""
    e = stepped(spark, sf_dir)
    return e.select("entity_key", F.col("t").alias("event_time_ms"), F.col("event_id").alias("arrival"), F.lit("external_event").alias("kind"), F.col("props").alias("external_event"), "k", "value", "etype")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = stepped(spark, sf_dir)
    kind = (
        F.when(F.col("etype") == "signup", "ACTIVATION_START")
        .when((F.col("etype") == "view") & (k % 9 == 4), "SUSPENDED")
        .when(F.col("etype") == "view", "LLM_CALL")
        .when((F.col("etype") == "click") & (k % 3 == 1), "INTENT_EMITTED")
        .when(F.col("etype") == "click", "TOOL_CALL")
        .when(F.col("etype") == "purchase", "ACTIVATION_END")
        .otherwise("ERROR")
    )
    e = e.withColumn("event_type", kind).withColumn("trace_id", ids.trace_id(F.col("entity_key"), F.col("seq")))
    before = Window.partitionBy("user_id", "seq").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("ls", F.max(F.when(F.col("event_type") == "ACTIVATION_START", F.col("step"))).over(before))
    e = e.withColumn("le", F.max(F.when(F.col("event_type") == "ACTIVATION_END", F.col("step"))).over(before))
    is_end, is_start = F.col("event_type") == "ACTIVATION_END", F.col("event_type") == "ACTIVATION_START"
    running = F.col("ls").isNotNull() & (F.col("le").isNull() | (F.col("le") < F.col("ls")))
    head = F.substring("trace_id", 1, 12)
    attempt = F.when(is_end & running, F.col("ls")).otherwise(F.col("step"))
    span = F.concat(head, F.when(is_start | is_end, F.concat(F.lit("a00"), attempt.cast("string"))).otherwise(F.concat(F.lit("b00"), F.col("step").cast("string"))))
    parent = F.when(is_start | is_end | F.col("ls").isNull(), "").otherwise(F.concat(head, F.lit("a00"), F.col("ls").cast("string")))
    llm = F.col("event_type") == "LLM_CALL"
    intent = F.col("event_type") == "INTENT_EMITTED"
    error = F.col("event_type") == "ERROR"
    attributes = _some(
        kind=F.when((is_start | is_end) & (k % 3 != 2), F.when(k % 3 == 0, "start").otherwise("resume")),
        status=F.when(is_end & (k % 4 != 3), F.when(k % 4 == 2, "suspended").otherwise("completed")),
        model=F.when(llm, F.concat(F.lit("m-"), k % 4)),
        input_tokens=F.when(llm & (k % 5 != 0), F.floor("value")),
        output_tokens=F.when(llm & (k % 5 != 0), k % 11),
        cache_hit=F.when(llm & (k % 8 != 0), F.when(k % 3 == 0, "true").otherwise("false")),
        billed=F.when(llm, F.when(k % 2 == 0, "true").otherwise("false")),
        attempts=F.when(llm, 1 + k % 3),
        circuit_state=F.when(llm & (k % 6 < 3), F.when(k % 6 == 0, "closed").when(k % 6 == 1, "open").otherwise("half_open")),
        tool_name=F.when(intent | (F.col("event_type") == "TOOL_CALL"), F.concat(F.lit("tool-"), k % 7)),
        intent_id=F.when(intent, ids.intent_id(F.col("entity_key"), F.col("seq"), F.col("step"))),
        intent_kind=F.when(intent, F.when(k % 2 == 0, "APPROVAL").otherwise("TOOL")),
        expires_at_ms=F.when(intent, F.col("t") + 3600000),
        deadline_ms=F.when(F.col("event_type") == "SUSPENDED", F.col("t") + 86400000),
        reason=F.when(error & (k % 3 != 1), F.element_at(F.array(*map(F.lit, REASONS)), k % 10 + 1)),
        error_type=F.when((error & (k % 4 != 0)) | (llm & (k % 13 == 0)), F.concat(F.lit("E"), k % 3)),
        failure_step=F.when(error & (k % 5 == 1), F.col("step")),
        failure_last_event=F.when(error & (k % 5 == 1), F.when(k % 2 == 0, "LLM_CALL").otherwise("TOOL_CALL")),
        failure_staged_intents=F.when(error & (k % 5 == 1), k % 3),
        failure_llm_calls=F.when(error & (k % 5 == 1), k % 4),
    )
    return e.select("trace_id", span.alias("span_id"), parent.alias("parent_span_id"), "entity_key", "seq", F.col("step").alias("step_index"), "event_type", F.col("t").alias("start_ms"), F.col("t").alias("end_ms"), attributes.alias("attributes"), F.lit("native").alias("provenance"), F.col("event_id").alias("arrival"))


def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = stepped(spark, sf_dir).filter((F.col("etype") == "error") & (k % 2 == 0))
    seq, detail, time_ms = F.when(k % 4 == 0, F.col("seq")), F.concat(F.lit("d-"), k), F.col("t") + k % 3
    reason = F.element_at(F.array(*map(F.lit, REASONS)), k % 10 + 1)
    e = e.select("entity_key", seq.alias("seq"), reason.alias("reason"), detail.alias("detail"), time_ms.alias("event_time_ms"), F.lit("native").alias("provenance"), F.col("event_id").alias("arrival"))
    return e.withColumn("error_id", ids.error_id(F.col("entity_key"), F.col("seq"), F.col("reason"), F.col("event_time_ms"), F.col("detail")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state export after the last event of each tenth activation."""
    e = stepped(spark, sf_dir).filter((F.col("step") == PER_ACTIVATION - 1) & (F.col("seq") % 10 == 0))
    return e.select("entity_key", "seq", F.col("t").alias("snapshot_at_ms"), F.lit(1).alias("state_schema_version"), F.concat(F.lit("r-"), F.col("event_id")).alias("request_id"), F.col("k").cast("bigint").alias("memory_entries"), (F.col("k") * 10).cast("bigint").alias("memory_bytes"), F.lit("native").alias("provenance"), F.col("event_id").alias("arrival"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events with late lossy copies: every tenth event again, without key, sequence, parent and times."""
    e = trace_events(spark, sf_dir)
    late = e.filter(F.col("arrival") % 10 == 0).select(
        "trace_id", "span_id", F.lit("").alias("parent_span_id"), F.lit("").alias("entity_key"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("step_index"), "event_type",
        F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"), F.create_map(F.lit("exporter"), F.lit("otlp")).alias("attributes"), F.lit("otlp").alias("provenance"), (F.col("arrival") + 1000000000).alias("arrival"),
    )
    return e.unionByName(late)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes from ``orders``: customers stand for entities."""
    o = table(spark, sf_dir, "orders")
    return o.select(ids.hex_key(F.col("o_custkey").cast("string")).alias("entity_key"), (F.col("o_orderkey") % 7).cast("bigint").alias("seq"), F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("label"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("event_time_ms"), F.col("o_orderkey").alias("arrival"))


@dataclass
class Store:
    """The base tables that the analytical queries read."""

    events: DataFrame
    errors: DataFrame
    snapshots: DataFrame


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(trace_events(spark, sf_dir), error_records(spark, sf_dir), snapshots(spark, sf_dir))
