"""An ordered outbox on a stream: messages of a key are published one after another, and a failure holds up that key alone.

The queue is that of ``effector``: a key's messages wait in state, ordered by (seq, step_index). The head is published; if that
fails, the key is held, nothing overtakes it, and a timer tries again after ``retry_ms``, in later batches and after a
restart alike. Other keys go on. A message that never can be sent (no key, a key that is too long, arguments that are no JSON, or
``Unsendable`` from the client) becomes a dead letter in its turn and holds up nobody.

Delivery is at least once: a batch that is repeated publishes again, under the same intent id and with the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.effects import Waiting
from . import effector, sinks

FOREVER = 1 << 62


class Unsendable(Exception):
    """The client can't take this message, now or later."""


@dataclass
class Publisher:
    """``connect`` makes a client once in each worker: a function of key and value that returns when the message is safe."""

    connect: Callable[[], Callable[[bytes, bytes], None]]
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self._client = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}

    def step(self, message: dict) -> tuple[str, dict]:
        why = message["why"]
        if why is None:
            try:
                if self._client is None:
                    self._client = self.connect()
                self._client(message["entity_key"].encode(), message["value"].encode())
            except Unsendable as e:
                why = str(e)
            except Exception as e:
                self.counts["held"] = self.counts.get("held", 0) + 1
                raise Waiting(FOREVER) from e
        kind = "dead_letter" if why is not None else "sent"
        self.counts[kind] = self.counts.get(kind, 0) + 1
        return kind, {"error_message": why}


def publish_stream(intents: DataFrame, publisher: Publisher, *, key_id: str | None = None, secret: str | None = None, max_key_bytes: int = 1024, retry_ms: int = 1000) -> DataFrame:
    """Rows of ``effector.OUTPUT`` with ``kind`` sent or dead_letter, in append mode. Rows without a key share one queue."""
    checked = sinks.checked(intents, max_key_bytes)
    good = sinks.signed(checked.drop("why"), key_id, secret) if key_id is not None else checked.drop("why")
    value = F.to_json(F.struct(*sorted(good.columns)))
    rows = good.withColumn("value", value).withColumn("why", sinks.unsendable(max_key_bytes))
    slim = rows.select(F.coalesce("entity_key", F.lit("")).alias("entity_key"), F.to_json(F.struct(F.coalesce("intent_id", F.lit("")).alias("intent_id"), "entity_key", "seq", "step_index", "tool_name", "args_json", "value", "why"), {"ignoreNullFields": "false"}).alias("intent"))
    worker = effector.EffectProcessor(publisher, retry_ms)
    return slim.groupBy("entity_key").transformWithStateInPandas(statefulProcessor=worker, outputStructType=effector.OUTPUT, outputMode="append", timeMode="processingTime")
