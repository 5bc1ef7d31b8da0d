"""Deterministic identities as Catalyst expressions: no Python runs for any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name spaces of derived identities.
INTENT_NAMESPACE = "6f3e9d2a1c475b8e9a102d4f6b8c0e11"
TRACE_NAMESPACE = "b1d7c4e293a65f088c317e5a9d0f2b46"


def hex_key(key: Column) -> Column:
    """The lower-case hexadecimal form of a key's bytes."""
    return F.lower(F.hex(key.cast("binary")))


def uuid5_hex(namespace: str, name: Column) -> Column:
    """The 32 hexadecimal digits of a version 5 UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def uuid5(namespace: str, name: Column) -> Column:
    h = uuid5_hex(namespace, name)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def trace_id(entity_key: Column, seq: Column) -> Column:
    """``entity_key`` is already hexadecimal."""
    return uuid5_hex(TRACE_NAMESPACE, F.concat_ws("|", entity_key, seq.cast("string")))


def span_id(entity_key: Column, seq: Column, role: Column, index: Column) -> Column:
    return F.substring(uuid5_hex(TRACE_NAMESPACE, F.concat_ws("|", entity_key, seq.cast("string"), role, index.cast("string"))), 1, 16)


def intent_id(entity_key: Column, seq: Column, step: Column) -> Column:
    return uuid5(INTENT_NAMESPACE, F.concat_ws("|", entity_key, seq.cast("string"), step.cast("string")))


def span_role(event_type: Column) -> Column:
    """Both activation events share the attempt's own span."""
    return F.when(event_type.isin("ACTIVATION_START", "ACTIVATION_END"), "activation").otherwise(event_type)


def error_id(entity_key: Column, seq: Column, reason: Column, time_ms: Column, detail: Column) -> Column:
    parts = (entity_key, F.coalesce(seq.cast("string"), F.lit("")), reason, time_ms.cast("string"), detail)
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"), 256)


def shard_number(payload: Column, n: int) -> Column:
    """The first eight bytes of the payload's SHA-256 as an unsigned number, modulo ``n``."""
    head = F.conv(F.substring(F.sha2(payload.cast("binary"), 256), 1, 16), 16, 10)
    return (head.cast("decimal(20,0)") % F.lit(n)).cast("int")


def shard_key(key: Column, payload: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("a key needs one shard at least")
    return F.concat(key, F.lit("#"), shard_number(payload, n).cast("string"))


def round_robin_key(key: Column, n: int) -> Column:
    """Shards in turn, evenly whatever the payloads; not the same in a replay, as it follows the place of a row."""
    if n < 1:
        raise ValueError("a key needs one shard at least")
    return F.concat(key, F.lit("#"), (F.monotonically_increasing_id() % F.lit(n)).cast("string"))


def unshard_key(key: Column) -> Column:
    """Strip exactly one trailing ``#digits``; anything else is an error."""
    plain = F.regexp_extract(key, "(?s)^(.*)#[0-9]+$", 1)
    return F.when(key.rlike("(?s)^.*#[0-9]+$"), plain).otherwise(F.raise_error(F.concat(F.lit("not a sharded key: "), key)))


def sampled(trace: Column, percent: int) -> Column:
    """Whether a trace (128-bit hexadecimal) falls in the first ``percent`` of a hundred, deterministically.

    A number modulo 100 from 16-digit halves: 2**64 is 16 modulo 100.
    """

    def half(start: int) -> Column:
        return F.conv(F.substring(trace, start, 16), 16, 10).cast("decimal(20,0)") % F.lit(100)

    return (half(1) * 16 + half(17)) % F.lit(100) < F.lit(percent)
