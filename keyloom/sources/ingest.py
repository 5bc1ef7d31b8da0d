"""Sources: decoding of telemetry and of generic rows into the record model.

Text formats only: one JSON document to a row for exported spans, warehouse rows as structs, and captured
files of frames, each a varint length and that many bytes of JSON. What cannot be read is never dropped in
silence: it comes back as error records or a ``truncated`` flag.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import EVENT_TYPES, PROVENANCES, SNAPSHOT, TRACE_EVENT

OTLP_SPAN = (
    "traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string, "
    "attributes array<struct<key: string, value: struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>>>"
)


def otlp_events(spans: DataFrame, json_col: str = "span") -> DataFrame:
    """Exported spans to trace events: nanoseconds to milliseconds, names to types, no key and no sequence."""
    s = F.from_json(F.col(json_col), OTLP_SPAN)
    one = spans.select(s.alias("s"), F.col("arrival") if "arrival" in spans.columns else F.shiftrightunsigned(F.xxhash64(F.col(json_col)), 2).alias("arrival"))

    def value(v: Column) -> Column:
        return F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))

    ms = lambda c: F.floor(F.col(c).cast("decimal(20,0)") / 1000000).cast("bigint")
    attributes = F.map_from_entries(F.transform(F.coalesce("s.attributes", F.array().cast("array<struct<key: string, value: struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>>>")), lambda a: F.struct(a["key"], value(a["value"]))))
    return one.select(
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.lower(F.coalesce("s.parentSpanId", F.lit(""))).alias("parent_span_id"), F.lit("").alias("entity_key"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("step_index"),
        F.when(F.upper("s.name").isin(*EVENT_TYPES), F.upper("s.name")).otherwise("EVENT_TYPE_UNSPECIFIED").alias("event_type"), ms("s.startTimeUnixNano").alias("start_ms"), ms("s.endTimeUnixNano").alias("end_ms"), attributes.alias("attributes"), F.lit("otlp").alias("provenance"), F.col("arrival").cast("bigint").alias("arrival"),
    )


def warehouse_events(rows: DataFrame, provenance: str = "bigquery") -> DataFrame:
    """Warehouse rows (attributes as repeated key and value) to trace events; null means the default, an unknown
    type is an error."""
    if provenance not in PROVENANCES:
        raise ValueError(f"unknown provenance {provenance!r}")
    kind = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null")))))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    attributes = F.map_from_entries(F.coalesce("attributes", F.array().cast("array<struct<key: string, value: string>>")))
    return rows.select(text("trace_id"), text("span_id"), text("parent_span_id"), text("entity_key"), number("seq"), number("step_index"), kind.alias("event_type"), number("start_ms"), number("end_ms"), attributes.alias("attributes"), F.lit(provenance).alias("provenance"), number("arrival"))


def warehouse_rows(events: DataFrame) -> DataFrame:
    """The reverse: attributes as a sorted list, the event's day as a partition column."""
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return events.withColumn("attributes", pairs).withColumn("event_date", F.to_date(F.timestamp_millis("start_ms")))


def pull_window(rows: DataFrame, time_col: str, now_ms: int, watermark_ms: int | None, lookback_ms: int = 24 * 3600_000, overlap_ms: int = 60_000) -> DataFrame:
    """The rows of one incremental read, half-open: from the watermark less an overlap, or a first lookback.
    Merging makes the overlap harmless."""
    start = now_ms - lookback_ms if watermark_ms is None else watermark_ms - overlap_ms
    return rows.filter((F.col(time_col) >= start) & (F.col(time_col) < now_ms))


def frames(data: bytes) -> tuple[list[bytes], bool]:
    """The complete frames of a captured file, and whether it ends inside one."""
    out, at = [], 0
    while at < len(data):
        size, shift, k = 0, 0, at
        while True:
            if k >= len(data) or shift > 63:
                return out, True
            size |= (data[k] & 0x7F) << shift
            shift += 7
            k += 1
            if not data[k - 1] & 0x80:
                break
        if k + size > len(data):
            return out, True
        out.append(data[k : k + size])
        at = k + size
    return out, False


def frame(body: bytes) -> bytes:
    size, head = len(body), bytearray()
    while True:
        head.append(size & 0x7F | (0x80 if size > 0x7F else 0))
        size >>= 7
        if not size:
            return bytes(head) + body


def read_bundle(spark: SparkSession, path: str, provenance: str = "bundle", split_bytes: int | None = None) -> DataFrame:
    """Trace events of captured files of frames: ``(file, position, truncated, event...)``. Large files are read in splits.

    A frame that is no trace event has null fields."""
    from . import frames as files

    raw = files.read_frames(spark, path, split_bytes or files.SPLIT_BYTES).select("file", "position", "truncated", F.decode("body", "UTF-8").alias("body"))
    event = raw.withColumn("e", F.from_json("body", TRACE_EVENT))
    return event.select("file", "position", "truncated", "e.*").withColumns({"provenance": F.lit(provenance), "arrival": F.col("position")})


_ERROR = "entity_key string, seq bigint, reason string, detail string, event_time_ms bigint"


def _messages(raw: DataFrame, body: str) -> DataFrame:
    """One row for each record of a payload: the payload itself if it is one JSON object, else its frames.

    ``_index`` is its place, ``_cut`` says that the payload ends inside a frame.
    """
    kept = [f for f in raw.schema.fields if f.name not in ("_text", "_index", "_cut")]

    def split(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows, texts, index, cut = [], [], [], []
            for i, data in enumerate(b.column(body).to_pylist()):
                data = data.encode() if isinstance(data, str) else data
                parts, truncated = ([data], False) if data is None or data.lstrip()[:1] == b"{" else frames(data)
                for k, x in enumerate(parts or [None]):
                    rows.append(i)
                    texts.append(None if x is None else x.decode("utf-8", "replace"))
                    index.append(k)
                    cut.append(truncated)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(texts, pa.string()), pa.array(index, pa.int64()), pa.array(cut, pa.bool_())], [*b.schema.names, "_text", "_index", "_cut"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return raw.select(*(f.name for f in kept)).mapInArrow(split, f"{shape}, _text string, _index bigint, _cut boolean")


def _arrival(each: DataFrame) -> Column:
    """The order of records: the message's offset and the place in it, or without an offset a hash of the record; both are the same
    in a retried task."""
    if "offset" in each.columns:
        return F.shiftleft(F.col("offset").cast("bigint"), 20) + F.col("_index")
    return F.shiftrightunsigned(F.xxhash64("_text"), 2)


def _torn(each: DataFrame) -> Column:
    return F.col("_cut") | F.col("truncated") if "truncated" in each.columns else F.col("_cut")


def decode_errors(raw: DataFrame, body: str = "value", provenance: str = "kafka") -> tuple[DataFrame, DataFrame]:
    """Error records of payloads, and what is none: bare records or records inside an envelope, one or a framed batch.

    A record without a reason is no error. The second frame has the payload's columns, ``_text`` and ``why``.
    """
    each = _messages(raw, body).withColumn("_wrapped", F.get_json_object("_text", "$.external_event"))
    each = each.withColumn("_r", F.coalesce(*(F.when(F.coalesce(r["reason"], F.lit("")) != "", r) for r in (F.from_json("_wrapped", _ERROR), F.from_json("_text", _ERROR)))))
    good = each.filter("_r is not null").select("_r.*", F.lit(provenance).alias("provenance"), _arrival(each).alias("arrival"), _torn(each).alias("truncated"))
    good = good.withColumn("error_id", ids.error_id(F.coalesce("entity_key", F.lit("")), F.col("seq"), F.col("reason"), F.coalesce("event_time_ms", F.lit(0)), F.coalesce("detail", F.lit(""))))
    return good, each.filter("_r is null").drop("_r", "_wrapped", "_index").withColumn("why", F.when(F.col("_cut"), "truncated").otherwise("not an error record"))


def decode_snapshots(raw: DataFrame, body: str = "value", provenance: str = "kafka") -> tuple[DataFrame, DataFrame]:
    """State exports of payloads, and what is none. One counts only if it is canonical: writing what was read gives
    the same bytes again."""
    need = ("entity_key", "seq", "snapshot_at_ms")

    def canonical(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ok = []
            for t in b.column("_text").to_pylist():
                try:
                    found = json.loads(t or "")
                    ok.append(isinstance(found, dict) and all(n in found for n in need) and canonical_json(found) == t)
                except ValueError:
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], [*b.schema.names, "_ok"])

    each = _messages(raw, body)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema.fields)
    each = each.mapInArrow(canonical, f"{shape}, _ok boolean")
    good = each.filter("_ok").select(F.from_json("_text", SNAPSHOT).alias("s"), _torn(each).alias("truncated"), _arrival(each).alias("_at")).select("s.*", "truncated", "_at")
    good = good.withColumns({"provenance": F.lit(provenance), "arrival": F.col("_at")}).drop("_at")
    return good, each.filter("not _ok").drop("_ok", "_index").withColumn("why", F.lit("not a canonical state export"))


def decode_traces(raw: DataFrame, body: str = "value", provenance: str = "kafka", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Trace events of the messages of a topic, batch or stream, and the messages that are none (to quarantine).

    Column by column in Catalyst, so it runs on a stream as it is. ``arrival``: the message's offset, or a hash of it if it has
    none. ``keep``: columns of the messages that the events keep.
    """
    text = F.col(body).cast("string")
    e = F.from_json(text, TRACE_EVENT)
    arrival = F.col("offset").cast("bigint") if "offset" in raw.columns else F.shiftrightunsigned(F.xxhash64(text), 2)
    each = raw.withColumn("_e", e).withColumn("_arrival", arrival)
    ok = F.col("_e.trace_id").isNotNull() & F.col("_e.span_id").isNotNull() & F.col("_e.event_type").isin(*EVENT_TYPES)
    blank = {"parent_span_id": "", "entity_key": "", "seq": 0, "step_index": 0, "start_ms": 0, "end_ms": 0}
    good = each.filter(ok).select("_e.*", "_arrival", *keep).drop("arrival", "provenance").withColumnRenamed("_arrival", "arrival")
    good = good.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in blank.items()}).withColumn("provenance", F.lit(provenance))
    return good, each.filter(~F.coalesce(ok, F.lit(False))).drop("_e", "_arrival")


def topic(spark: SparkSession, servers: str, name: str, streaming: bool = True, **options) -> DataFrame:
    """The messages ``(key, value, topic, partition, offset, ...)`` of a Kafka topic; needs Spark's Kafka connector."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).options(**options).load()


def memory_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A source for tests and examples: rows given as they are, such as envelopes or intents."""
    return spark.createDataFrame(rows, schema)


def scripted(spark: SparkSession, path: str, steps: list[list], schema: str) -> DataFrame:
    """A stream with a scripted clock: each step is one file and one batch, in the order given, so the watermark and the
    batches advance exactly as the steps say."""
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/step={k:06}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def read_capture(spark: SparkSession, path: str, kind: str, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A captured file of frames as ``traces``, ``errors`` or ``snapshots`` with ``truncated``, and its frames that are none.

    The first frame's ``arrival`` is the place of a record in its file, so a retried task gives the same. Large files are read in
    splits. Of a file that ends inside a frame the complete ones are read."""
    from . import frames as files

    decode = {"traces": decode_traces, "errors": decode_errors, "snapshots": decode_snapshots}
    if kind not in decode:
        raise ValueError(f"{kind!r} is none of traces, errors, snapshots")
    raw = files.read_frames(spark, path, split_bytes or files.SPLIT_BYTES).filter("position >= 0")
    raw = raw.select("file", F.col("position").alias("offset"), F.col("body").alias("value"), "truncated")
    if kind == "traces":
        good, bad = decode_traces(raw, "value", "bundle", keep=("truncated",))
        return good, bad.withColumn("why", F.lit("not a trace event"))
    return decode[kind](raw, "value", "bundle")


def otlp_spans(events: DataFrame) -> DataFrame:
    """Trace events as exported spans, one JSON document ``span`` for each but ACTIVATION_START, which has the span id of its end."""
    text = lambda v: F.struct(v.alias("stringValue"))
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), text(e["value"]).alias("value"))))
    nano = lambda c: F.concat(F.col(c).cast("string"), F.lit("000000")).alias
    status = F.when(F.col("event_type") == "ERROR", F.struct(F.lit(2).alias("code")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.lower("event_type").alias("name"),
        nano("start_ms")("startTimeUnixNano"), nano("end_ms")("endTimeUnixNano"), pairs.alias("attributes"), status.alias("status"),
    )
    return events.filter("event_type <> 'ACTIVATION_START'").select(F.to_json(span).alias("span"))


def rows_to_envelopes(rows: DataFrame, event_time_field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Generic rows ``key, payload[, time]`` to envelopes, and the malformed ones to error records.

    Text and bytes are accepted; a row without a time counts as time zero. ``arrival`` is the source's offset or
    arrival if the rows have one, else a hash of the row: the same in a retried task, which a row number is not.
    """
    given = next((c for c in ("arrival", "offset") if c in rows.columns), None)
    arrival = F.col(given).cast("bigint") if given else F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in ("key", "payload"))), 1)
    key = F.col("key").cast("binary")
    bad = F.when(F.col("key").isNull(), "key is missing").when(F.length(key) == 0, "key is empty").when(F.col("payload").isNull(), "payload is missing")
    time = F.lit(0).cast("bigint")
    if event_time_field:
        number = F.expr(f"try_cast(`{event_time_field}` as bigint)")
        bad = bad.when(F.col(event_time_field).isNotNull() & number.isNull(), "event time is no number")
        time = F.coalesce(number, F.lit(0))
    each = rows.withColumn("_bad", bad).withColumn("_time", time).withColumn("_key", ids.hex_key(F.col("key")))
    good = each.filter("_bad is null").select(F.col("_key").alias("entity_key"), F.col("_time").alias("event_time_ms"), arrival.alias("arrival"), F.lit("external_event").alias("kind"), F.col("payload").cast("string").alias("external_event"))
    errors = each.filter("_bad is not null").select(F.coalesce("_key", F.lit("")).alias("entity_key"), F.lit(None).cast("bigint").alias("seq"), F.lit("malformed_input_row").alias("reason"), F.col("_bad").alias("detail"), F.col("_time").alias("event_time_ms"), F.lit("native").alias("provenance"))
    return good, errors


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
