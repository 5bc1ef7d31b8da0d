import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from keyloom.functions import ids
from keyloom.operators import merge
from keyloom.streaming import kernel


def test_uuids_match_the_standard_library(spark):
    rows = [(f"{i:02x}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, s bigint").select("k", "s", ids.trace_id(F.col("k"), F.col("s")).alias("t"), ids.intent_id(F.col("k"), F.col("s"), F.lit(2)).alias("i"), ids.span_id(F.col("k"), F.col("s"), F.lit("activation"), F.lit(0)).alias("p"))
    for r in df.collect():
        assert r["t"] == kernel.trace_id(r["k"], r["s"]) and r["i"] == kernel.intent_id(r["k"], r["s"], 2) and r["p"] == kernel.span_id(r["k"], r["s"], "activation", 0)
        assert uuid.UUID(r["i"]).version == 5


def test_shards(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(256)], "p string").select("p", ids.shard_number(F.col("p"), 7).alias("n"), ids.unshard_key(ids.shard_key(F.lit("a#1"), F.col("p"), 7)).alias("k"))
    for r in df.collect():
        assert r["n"] == int.from_bytes(hashlib.sha256(r["p"].encode()).digest()[:8], "big") % 7 and r["k"] == "a#1"
    with pytest.raises(ValueError):
        ids.shard_key(F.lit("k"), F.lit("p"), 0)
    with pytest.raises(Exception, match="not a sharded key"):
        spark.range(1).select(ids.unshard_key(F.lit("plain"))).collect()


def test_sampling_is_the_128_bit_modulus(spark):
    t = [hashlib.md5(str(i).encode()).hexdigest() for i in range(300)]
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(x,) for x in t], "t string").select("t", ids.sampled(F.col("t"), 10).alias("s")).collect()}
    assert got == {x: int(x, 16) % 100 < 10 for x in t}


def test_error_id_and_seq_of_details(spark):
    df = spark.createDataFrame([("6b", None, "hitl_timeout", 5, "seq=3 more"), ("6b", None, "intent_dead_letter", 5, '{"seq": 4}'), ("6b", None, "other", 5, "seq=9")], "entity_key string, seq bigint, reason string, event_time_ms bigint, detail string")
    got = {r["reason"]: r for r in merge.normalise_error_seq(df).withColumn("id", ids.error_id(F.col("entity_key"), F.lit(None), F.col("reason"), F.col("event_time_ms"), F.col("detail"))).collect()}
    assert (got["hitl_timeout"]["seq"], got["intent_dead_letter"]["seq"], got["other"]["seq"]) == (3, 4, None)
    assert got["other"]["id"] == hashlib.sha256(b"6b\0\0other\x005\0seq=9").hexdigest()
