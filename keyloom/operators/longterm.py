"""Long-term memory, replay comparison, effects and evaluation: relational forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(rows: DataFrame) -> DataFrame:
    """Per (entity_key, name): applied if the sequence is not older; of equal ones the last to arrive."""
    return rows.groupBy("entity_key", "name").agg(F.max_by(F.struct("value", "seq", "updated_at_ms"), F.struct("seq", "arrival")).alias("r")).select("entity_key", "name", "r.*")


def load(memory: DataFrame, entity_key: str, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Names that begin with the literal prefix, in order."""
    out = memory.filter((F.col("entity_key") == entity_key) & F.col("name").startswith(prefix)).orderBy("name")
    return out if limit is None else out.limit(limit)


def overlay(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Read your own writes: a staged row stands before the stored one."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(staged.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("entity_key", "name").orderBy(F.col("_p").desc(), F.col("seq").desc()))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r", "_p")


def size_batches(events: DataFrame, n: int, key: str = "entity_key", order: tuple[str, ...] = ("event_time_ms", "arrival")) -> DataFrame:
    """Buffers flushed by size: a batch number for each event, and the batch's clock."""
    w = Window.partitionBy(key).orderBy(*order)
    out = events.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n).cast("bigint"))
    return out.groupBy(key, "batch").agg(F.count("*").alias("size"), F.max("event_time_ms").alias("now_ms"), (F.count("*") >= n).alias("flushed"))


def running(events: DataFrame, value: Column, key: str = "entity_key", order: tuple[str, ...] = ("event_time_ms", "arrival")) -> DataFrame:
    """Memory of the simple agents as a window frame: count and sum so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({"n": F.count("*").over(w), "sum": F.sum(value).over(w)})


def last_n(events: DataFrame, n: int, key: str = "entity_key", order: tuple[str, ...] = ("event_time_ms", "arrival")) -> DataFrame:
    """A ring per key: its last ``n`` rows, by a limited window."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def budget_trips(calls: DataFrame, tokens: Column, limit: int, scope: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Calls with the tokens charged before them, refused once strictly more than ``limit`` was charged."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("before", F.coalesce(F.sum(tokens).over(w), F.lit(0))).withColumn("refused", F.col("before") > limit)


def admission(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Resume admission as a left join: why an answer is refused, or null.

    ``questions (entity_key, seq, intent_id, deadline_ms, expires_at_ms)``; ``answers (entity_key, seq,
    intent_id, event_time_ms)``. The question of an answer is that of its activation.
    """
    q = questions.select("entity_key", "seq", F.col("intent_id").alias("asked"), "deadline_ms", "expires_at_ms")
    j = answers.join(q, ["entity_key", "seq"], "left")
    now = F.col("event_time_ms")
    why = (
        F.when(F.col("asked").isNull(), "no_continuation").when(F.col("asked") != F.col("intent_id"), "unknown_intent")
        .when((F.col("deadline_ms") <= 0) | (now >= F.col("deadline_ms")), "deadline_passed").when((F.col("expires_at_ms") <= 0) | (now >= F.col("expires_at_ms")), "intent_expired")
    )
    return j.withColumn("refusal", why)


def select_attempt(events: DataFrame, kind: str | None = None) -> DataFrame:
    """Events of the chosen attempt of each activation: attempts begin at a start; the last of the wanted kind,
    else the last."""
    w = Window.partitionBy("entity_key", "seq").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("attempt", F.sum(F.when(F.col("event_type") == "ACTIVATION_START", 1).otherwise(0)).over(w))
    own = F.when((F.col("event_type") == "ACTIVATION_START") & (F.col("attributes")["kind"] == (kind or "")), F.col("attempt"))
    g = e.groupBy("entity_key", "seq").agg(F.coalesce(F.max(own), F.max("attempt")).alias("chosen"))
    return e.join(g, ["entity_key", "seq"]).filter("attempt = chosen").drop("chosen")


def first_divergence(left: DataFrame, right: DataFrame, key: tuple[str, ...], compared: tuple[str, ...]) -> DataFrame:
    """Positional comparison of two event lists: the first position that differs, and what differs there.

    Both sides carry ``position``; an event that one side lacks differs as ``missing``.
    """
    a = left.select(*key, "position", F.struct(*compared).alias("l"))
    b = right.select(*key, "position", F.struct(*compared).alias("r"))
    j = a.join(b, [*key, "position"], "full_outer")
    what = F.when(F.col("l").isNull() | F.col("r").isNull(), "missing")
    for c in compared:
        what = what.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c)
    return j.withColumn("what", what).filter("what is not null").groupBy(*key).agg(F.min("position").alias("position"), F.min_by("what", "position").alias("what"))


def intent_diff(traced: DataFrame, replayed: DataFrame, key: tuple[str, ...] = ("entity_key", "seq")) -> DataFrame:
    """Intents by place in their activation: ``count`` (position -1) where the numbers differ, else each place that
    differs with the first field that does."""
    fields = ("intent_id", "tool_name", "kind", "expires_at_ms")
    a = traced.groupBy(*key).agg(F.count("*").alias("a"))
    n = a.join(replayed.groupBy(*key).agg(F.count("*").alias("b")), list(key), "full_outer").select(*key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    other = n.filter("a <> b").select(*key, F.lit(-1).cast("bigint").alias("position"), F.lit("count").alias("what"))
    both = traced.select(*key, "position", F.struct(*fields).alias("l")).join(replayed.select(*key, "position", F.struct(*fields).alias("r")), [*key, "position"]).join(n.filter("a = b").select(*key), list(key), "left_semi")
    what = F.coalesce(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c) for c in fields))
    return other.unionByName(both.select(*key, "position", what.alias("what")).filter("what is not null"))


def effect_status(intents: DataFrame, now_ms: int, known: list[str]) -> DataFrame:
    """Status of each intent before execution: expired ones are refused before any claim, unknown tools
    rejected, approvals routed on without a result; one row for each intent id however often it came."""
    one = intents.groupBy("intent_id").agg(F.min_by(F.struct(*[c for c in intents.columns if c != "intent_id"]), "created_at_ms").alias("r")).select("intent_id", "r.*")
    status = F.when((F.col("expires_at_ms") <= 0) | (F.col("expires_at_ms") <= now_ms), "EXPIRED").when(F.col("kind") == "APPROVAL", "ROUTED").when(~F.col("tool_name").isin(*known), "REJECTED").otherwise("OK")
    return one.withColumn("status", status)


def judge_join(traces: DataFrame, outcomes: DataFrame, wait_ms: int) -> DataFrame:
    """Traces (one for each entity_key, seq) with their first outcome inside the deadline: ``joined``,
    ``no_outcome``; and outcomes that are late, repeated or without a trace: ``orphaned``."""
    t = traces.groupBy("entity_key", "seq").agg(F.min("end_ms").alias("end_ms"))
    j = outcomes.join(t, ["entity_key", "seq"], "left")
    late = F.col("end_ms").isNull() | (F.col("event_time_ms") > F.col("end_ms") + wait_ms) | (F.col("event_time_ms") < F.col("end_ms"))
    rank = F.row_number().over(Window.partitionBy("entity_key", "seq", late).orderBy("event_time_ms", "arrival"))
    j = j.withColumn("verdict", F.when(late | (rank > 1), "orphaned").otherwise("joined"))
    got = j.filter("verdict = 'joined'").select("entity_key", "seq")
    none = t.join(got, ["entity_key", "seq"], "left_anti").withColumn("verdict", F.lit("no_outcome"))
    return j.unionByName(none, allowMissingColumns=True)


def hourly_quality(judged: DataFrame, hour_ms: int = 3600_000) -> DataFrame:
    """Per (window, scenario): rows judged, mean score (null when none), without outcome, errors."""
    g = judged.groupBy((F.floor(F.col("event_time_ms") / hour_ms) * hour_ms).cast("bigint").alias("window_ms"), "scenario").agg(
        F.count("score").alias("judged"), F.sum("score").alias("total"), F.count_if(F.col("label").isNull()).alias("no_outcome"), F.count_if(F.col("label").isNotNull() & F.col("score").isNull()).alias("judge_errors"),
    )
    return g.withColumn("mean_score", F.when(F.col("judged") > 0, F.col("total") / F.col("judged"))).drop("total")


def latest(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row for each key: the latest."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order)))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")
