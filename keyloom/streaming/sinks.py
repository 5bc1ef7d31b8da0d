"""Sinks by URI, checked when a pipeline is built.

``parquet:///path``, ``memory://name``, ``console:///path`` (the record store there: traces, errors and snapshots, each batch
once), ``kafka://servers/topic``, ``otlp://host:port`` (traces only),
``pubsub://project/topic`` and ``bigquery://project.dataset.table`` (not for snapshots). The last two need a client that
Spark does not have: ``register`` names a function that writes a batch, and without one the URI is refused at once.

A sink is a function of a batch frame and a batch id. Retried batches replace what they wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import STREAMS

IDENTITY = {"traces": ("trace_id", "span_id", "event_type"), "intents": ("intent_id",), "errors": ("entity_key", "seq", "ordinal"), "output": ("entity_key", "seq", "ordinal"), "snapshots": ("entity_key", "seq", "ordinal"), "saves": ("entity_key", "seq", "ordinal"), "metrics": ("entity_key", "seq", "ordinal")}
MEMORY: dict[str, list] = {}
Sink = Callable[[DataFrame, int], None]


def resolve(uri: str, stream: str) -> Sink:
    """The sink of one stream; a bad URI fails here, before any query starts."""
    if stream not in STREAMS:
        raise ValueError(f"unknown stream {stream!r}")
    u = urlsplit(uri)
    if u.scheme == "parquet":
        if not u.path:
            raise ValueError(f"{uri!r} has no path")
        base = f"{u.netloc and f'file://{u.netloc}'}{u.path}" if u.netloc else u.path
        return lambda df, batch: df.dropDuplicates(list(IDENTITY[stream])).write.mode("overwrite").parquet(f"{base}/{stream}/batch={batch}")
    if u.scheme == "memory":
        if not u.netloc:
            raise ValueError(f"{uri!r} has no name")
        table = MEMORY.setdefault(u.netloc, [])
        return lambda df, batch: table.extend((batch, r) for r in df.toLocalIterator())
    if u.scheme == "kafka":
        topic = u.path.strip("/")
        if not u.netloc or not topic or "/" in topic:
            raise ValueError(f"{uri!r} is not kafka://servers/topic")
        options = dict(parse_qsl(u.query))
        return lambda df, batch: keyed(df).write.format("kafka").option("kafka.bootstrap.servers", u.netloc).option("topic", topic).options(**options).save()
    if u.scheme == "console":
        if stream not in ("traces", "errors", "snapshots") or not u.path.strip("/"):
            raise ValueError(f"{uri!r}: console:///path takes traces, errors and snapshots")
        options = dict(parse_qsl(u.query))
        return _console(u.path if not u.netloc else f"{u.netloc}{u.path}", stream, int(options.get("buckets", 64)), options.get("query", "console"))
    if u.scheme == "otlp":
        if stream != "traces" or not u.hostname:
            raise ValueError(f"{uri!r}: otlp://host[:port] takes traces only")
        options = dict(parse_qsl(u.query)) | {"url": f"http://{u.netloc}{u.path or '/v1/traces'}"}
        return lambda df, batch: export_spans(df, batch, options)
    if u.scheme in ("pubsub", "bigquery"):
        if u.scheme == "pubsub" and (not u.netloc or not u.path.strip("/") or "/" in u.path.strip("/")):
            raise ValueError(f"{uri!r} is not pubsub://project/topic")
        if u.scheme == "bigquery" and (stream == "snapshots" or u.netloc.count(".") != 2 or not all(u.netloc.split("."))):
            raise ValueError(f"{uri!r}: bigquery://project.dataset.table takes no snapshots")
        if u.scheme not in WRITERS:
            raise ValueError(f"no writer is registered for {u.scheme}://")
        return WRITERS[u.scheme](uri, stream)
    raise ValueError(f"no sink for {uri!r}")


WRITERS: dict[str, Callable[[str, str], Sink]] = {}


def register(scheme: str, factory: Callable[[str, str], Sink]) -> None:
    """``factory(uri, stream)`` gives the sink of a scheme that needs a foreign client."""
    WRITERS[scheme] = factory


def _console(path: str, stream: str, buckets: int, query: str) -> Sink:
    """Batches of one stream into the record store, under the token of query, stream and batch."""
    from ..operators.store import RecordStore, from_output

    kind = {"traces": "events"}.get(stream, stream)

    def write(df: DataFrame, batch: int) -> None:
        rows = df.withColumn("stream", F.lit(stream))
        absent = {c: F.lit(None).cast("string") for c in ("reason", "detail", "body", "event_type", "trace_id", "span_id", "parent_span_id") if c not in df.columns}
        absent |= {c: F.lit(None).cast("bigint") for c in ("seq", "step_index", "ordinal", "event_time_ms") if c not in df.columns}
        absent |= {} if "attributes" in df.columns else {"attributes": F.lit(None).cast("map<string, string>")}
        RecordStore(df.sparkSession, path, buckets).write(**{kind: from_output(rows.withColumns(absent))[kind]}, token=(f"{query}/{stream}", batch))

    return write


def export_spans(traces: DataFrame, batch: int, options: dict[str, str]) -> None:
    """A batch of trace events through the best-effort exporter; its report, if one is asked for, is named by the batch."""
    from . import exporter

    traces.sparkSession.dataSource.register(exporter.SpanExport)
    own = options | ({"report": f"{options['report']}/{batch}"} if options.get("report") else {})
    exporter.spans(traces).write.format("otlp").mode("append").options(**own).save()


INTENT = ["entity_key", "seq", "step_index", "intent_id", "tool_name", "kind", "args_json", "created_at_ms", "expires_at_ms"]


def unsendable(max_key_bytes: int) -> Column:
    """Why an intent can never be sent; null if it can."""
    return (
        F.when(F.col("entity_key").isNull() | (F.col("entity_key") == ""), "no key").when(F.octet_length("entity_key") > max_key_bytes, "the key is too long")
        .when(F.col("intent_id").isNull(), "no intent id").when(F.col("args_json").isNotNull() & F.expr("try_parse_json(args_json)").isNull(), "arguments are no JSON")
    )


def checked(intents: DataFrame, max_key_bytes: int) -> DataFrame:
    return intents.select(*INTENT).withColumn("why", unsendable(max_key_bytes))


def outbox(intents: DataFrame, key_id: str | None = None, secret: str | None = None, max_key_bytes: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Intents as ``(key, value)`` messages, signed if a key is given, and dead letters ``(intent_id, why)``.

    Messages of a key lie in one partition in order of (seq, step_index), so a writer that keeps the order of a partition
    keeps that of a key. An intent that cannot be sent is a dead letter and never stops the others.
    """
    each = checked(intents, max_key_bytes)
    good = each.filter("why is null").drop("why")
    if key_id is not None:
        good = signed(good, key_id, secret)
    ordered = good.repartition("entity_key").sortWithinPartitions("entity_key", "seq", "step_index")
    return keyed(ordered), each.filter("why is not null").select("entity_key", "intent_id", "why")


def keyed(df: DataFrame) -> DataFrame:
    """Key and canonical bytes of each record: maps sorted, nulls left out."""
    cols = [F.map_from_entries(F.array_sort(F.map_entries(f.name))).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.col("entity_key").cast("binary").alias("key"), F.to_json(F.struct(*cols)).cast("binary").alias("value"))


def signed(intents: DataFrame, key_id: str, secret: str) -> DataFrame:
    """Intents with ``key_id`` and an HMAC-SHA256 ``signature`` of their canonical form, in Catalyst expressions."""
    return intents.withColumn("key_id", F.lit(key_id)).withColumn("signature", hmac_sha256(secret.encode(), _canonical(intents)))


def verified(intents: DataFrame, keys: dict[str, str], mode: str = "require") -> DataFrame:
    """``verdict``: ok, unsigned, unknown_signing_key or bad_signature; ``accepted`` under the mode off,
    permissive (unsigned passes) or require."""
    plain = intents.drop("key_id", "signature")
    expected = None
    for k, secret in keys.items():
        own = hmac_sha256(secret.encode(), _canonical(plain))
        expected = F.when(F.col("key_id") == k, own) if expected is None else expected.when(F.col("key_id") == k, own)
    unsigned = F.col("signature").isNull() | (F.col("signature") == "")
    known = F.col("key_id").isin(*keys)
    verdict = F.when(unsigned, "unsigned").when(~F.coalesce(known, F.lit(False)), "unknown_signing_key").when(F.col("signature") != (F.lit("") if expected is None else expected), "bad_signature").otherwise("ok")
    accepted = {"off": F.lit(True), "permissive": F.col("verdict").isin("ok", "unsigned"), "require": F.col("verdict") == "ok"}[mode]
    return intents.withColumn("verdict", verdict).withColumn("accepted", accepted)


def _canonical(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(c for c in df.columns if c not in ("key_id", "signature"))))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    import hashlib

    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer)), first), 256)
