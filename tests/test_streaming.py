import json
import time

from pyspark.sql import functions as F

from keyloom.streaming import agents, fold, processor
from keyloom.streaming.kernel import Config

SCHEMA = "entity_key string, event_time_ms bigint, arrival bigint, kind string, external_event string, tool_result struct<intent_id: string>"


def test_stream_equals_fold(spark, tmp_path):
    rows = [(f"k{i % 3}", 1_700_000_000_000 + i, i, "external_event", json.dumps({"k": i}), None) for i in range(30)]
    for b in range(3):
        spark.createDataFrame(rows[10 * b : 10 * b + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = Config(agent=agents.counter, ttl_ms=10**13)
    batch = fold.stream_of(fold.run_agent(spark.createDataFrame(rows, SCHEMA), config), "output")
    want = sorted(tuple(r) for r in batch.select("entity_key", "seq", "payload").collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sinks = {n: processor.parquet_sink(str(tmp_path / n)) for n in ("output", "traces")}
    q = processor.run_agent_stream(source, config).writeStream.foreachBatch(processor.fan_out(sinks)).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + 90
        while time.time() < end:
            if q.exception():
                raise q.exception()
            if (tmp_path / "output").exists() and sum(p.numInputRows for p in map(_Progress, q.recentProgress)) >= 30:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.read.parquet(str(tmp_path / "output"))
    assert sorted(tuple(r) for r in got.select("entity_key", "seq", "payload").collect()) == want
    assert spark.read.parquet(str(tmp_path / "traces")).filter(F.col("event_type") == "ACTIVATION_START").count() == 30


class _Progress:
    def __init__(self, p):
        self.numInputRows = p["numInputRows"] if isinstance(p, dict) else p.numInputRows


def test_sharded_envelopes_keep_all_events(spark):
    rows = [("hot", 1_700_000_000_000 + i, i, "external_event", json.dumps({"k": i}), None) for i in range(40)]
    out = fold.stream_of(fold.run_agent(fold.sharded(spark.createDataFrame(rows, SCHEMA), 4), Config(agent=agents.counter)), "output")
    got = out.groupBy("entity_key").agg(F.count("*").alias("n")).collect()
    assert len(got) == 4 and sum(r["n"] for r in got) == 40
