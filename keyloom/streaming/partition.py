"""A stream dealt into tagged outputs by a policy, with what came too late as an output of its own.

Spark's windowed operators leave out rows behind the watermark without a word. Here a row is compared with the watermark that held
when its batch began, and carries the tag ``late`` instead of the policy's if it is behind. So each row is in exactly one output and
can be counted there. The watermark is that of the latest event times of earlier batches, less a delay; a batch that is repeated
sees the same one, and tags its rows alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "late"
_OUTPUT = "tag string, body string"


class Tagger(StatefulProcessor):
    """Keeps no state: it is there for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            behind = pdf["at_ms"] < watermark  # a row without a time is never late
            yield pdf.assign(tag=pdf["tag"].mask(behind, LATE))[["tag", "body"]]

    def close(self) -> None:
        pass


def tagged(stream: DataFrame, policy: Column, *, key: str, time_ms: str, delay: str = "10 seconds") -> DataFrame:
    """The rows of a stream with a column ``tag``: the policy's text, or ``late``. Rows without a key share one.

    ``key`` deals rows to tasks; a key that holds most rows can be any column that spreads them, as no state is kept."""
    body = stream.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"), policy.cast("string").alias("tag"), F.col(f"`{time_ms}`").cast("double").alias("at_ms"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in stream.columns)), {"ignoreNullFields": "false"}).alias("body"))
    timed = body.withColumn("_time", F.timestamp_millis(F.col("at_ms").cast("long"))).withWatermark("_time", delay)
    out = timed.groupBy("_key").transformWithStateInPandas(statefulProcessor=Tagger(), outputStructType=_OUTPUT, outputMode="append", timeMode="processingTime")
    return out.select("tag", F.from_json("body", stream.schema).alias("_row")).select("tag", "_row.*")


def deal(sinks: dict[str, Callable[[DataFrame, int], None]], rest: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each tag's rows to its sink, all others to ``rest``; without it a tag that nobody takes fails."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            other = batch.filter(~F.coalesce(F.col("tag").isin(*sinks), F.lit(False)))
            if rest is not None:
                rest(other, number)
            elif not other.isEmpty():
                raise ValueError(f"no sink for {other.first()['tag']!r}")
            for tag, sink in sinks.items():
                sink(batch.filter(F.col("tag") == tag).drop("tag"), number)
        finally:
            batch.unpersist()

    return write
