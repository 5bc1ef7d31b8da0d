"""Continuous evaluation: activations joined with outcomes inside a deadline, a judge, and hourly quality.

The join is one stateful operator in event time. An outcome is answered when it arrives; an activation without one is
reported when the watermark passes its deadline, and its state goes then. An outcome without live state (repeated, late,
or never traced) is orphaned. ``longterm.judge_join`` is the same over bounded tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .model import ProviderError, Response

VERDICT = "entity_key string, seq bigint, verdict string, scenario string, label string, event_time_ms bigint, activation_status string, input_tokens bigint, output_tokens bigint"
_COLUMNS = [c.split()[0] for c in VERDICT.split(", ")]


def summarise(events: list[dict]) -> dict:
    """What a verdict says of an activation: its last status, and tokens, null where no call said any."""
    total = {}
    for n in ("input_tokens", "output_tokens"):
        said = [int(e["attributes"][n]) for e in events if e["event_type"] == "LLM_CALL" and (e["attributes"] or {}).get(n)]
        total[n] = sum(said) if said else None
    ended = [e for e in sorted(events, key=lambda e: e["start_ms"]) if e["event_type"] == "ACTIVATION_END"]
    status = "error" if any(e["event_type"] == "ERROR" for e in events) else (ended[-1]["attributes"] or {}).get("status") if ended else None
    return {"activation_status": status} | total


class OutcomeJoin(StatefulProcessor):
    def __init__(self, deadline_ms: int):
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "body string")
        self.done = handle.getValueState("done", "flag boolean")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def _bagged(self) -> list[dict]:
        return [json.loads(r[0]) for r in self.events.get()] if self.events.exists() else []

    @staticmethod
    def _row(key, verdict: str, found: dict, scenario=None, label=None, at: int | None = None) -> dict:
        return {"entity_key": key[0], "seq": int(key[1]), "verdict": verdict, "scenario": scenario, "label": label, "event_time_ms": at} | {"activation_status": None, "input_tokens": None, "output_tokens": None} | found

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        found = sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: (r["event_time_ms"], r["tag"] != "trace"))
        out, latest = [], None
        for r in found:
            done = self.done.exists()
            if r["tag"] == "trace":
                if not done:
                    self.events.appendValue((r["body"],))
                    latest = max(latest or 0, int(r["event_time_ms"]))
                continue
            outcome, bagged = json.loads(r["body"]), [] if done else self._bagged()
            if done or not bagged:
                out.append(self._row(key, "orphaned", {}, outcome.get("scenario"), outcome.get("label"), int(r["event_time_ms"])))
                continue
            self.done.update((True,))
            self.events.clear()
            out.append(self._row(key, "joined", summarise(bagged), outcome.get("scenario"), outcome.get("label"), int(r["event_time_ms"])))
        if latest is not None:
            before = self.timer.get()[0] if self.timer.exists() else None
            at = max(latest + self.deadline_ms, before or 0)
            if at != before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(at)
                self.timer.update((at,))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        bagged = [] if self.done.exists() else self._bagged()
        out = [self._row(key, "no_outcome", summarise(bagged), at=self.timer.get()[0])] if bagged else []
        for cell in (self.events, self.done, self.timer):
            cell.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def outcome_join(traces: DataFrame, outcomes: DataFrame, deadline_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Verdict rows of two streams: trace events, and ``outcomes (entity_key, seq, scenario, label, event_time_ms)``."""
    body = F.to_json(F.struct("event_type", "start_ms", "attributes"), {"ignoreNullFields": "false"})
    t = traces.select("entity_key", "seq", F.lit("trace").alias("tag"), F.col("start_ms").alias("event_time_ms"), body.alias("body"))
    o = outcomes.select("entity_key", "seq", F.lit("outcome").alias("tag"), "event_time_ms", F.to_json(F.struct("scenario", "label")).alias("body"))
    both = t.unionByName(o).withColumn("_time", F.timestamp_millis("event_time_ms")).withWatermark("_time", delay)
    return both.groupBy("entity_key", "seq").transformWithStateInPandas(statefulProcessor=OutcomeJoin(deadline_ms), outputStructType=VERDICT, outputMode="append", timeMode="eventTime")


PROMPT = "Rate from 1 to 5 how well the activation served the outcome.\nstatus: {activation_status}\ninput tokens: {input_tokens}\noutput tokens: {output_tokens}\nscenario: {scenario}\noutcome: {label}\nAnswer as JSON with score and rationale."


def judged(joined: DataFrame, provider: Callable[[], Callable[[dict], Response]], model: str, prompt: str = PROMPT, version: str = "v1") -> DataFrame:
    """Joined rows with a score. ``kind`` is ``verdict``, or ``judge_error`` with the reason: a provider's failure, or an
    answer that is no JSON object with a whole ``score`` of 1 to 5 and a text ``rationale``. A score is never made up.

    ``provider`` makes the client once in each task.
    """

    def judge(batches):
        import pyarrow as pa

        call = provider()
        for b in batches:
            cols: dict[str, list] = {"kind": [], "score": [], "rationale": [], "judge_error": []}
            for r in b.to_pylist():
                kind, score, rationale, error = "judge_error", None, None, None
                request = {"model": model, "messages": [{"role": "user", "content": prompt.format(**r)}], "tools": [], "params": {"temperature": 0}}
                try:
                    text = call(request).text
                except ProviderError as e:
                    error = type(e).__name__
                else:
                    score, rationale = _verdict(text)
                    kind, error = ("verdict", None) if score is not None else ("judge_error", "invalid_verdict")
                for n, v in zip(cols, (kind, score, rationale, error), strict=True):
                    cols[n].append(v)
            made = [pa.array(v, pa.int64() if n == "score" else pa.string()) for n, v in cols.items()]
            extra = [pa.array([x] * b.num_rows, pa.string()) for x in (version, model)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made, *extra], [*b.schema.names, *cols, "judge_prompt_version", "judge_model"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.mapInArrow(judge, f"{fields}, kind string, score bigint, rationale string, judge_error string, judge_prompt_version string, judge_model string")


def _verdict(text: str) -> tuple[int | None, str | None]:
    try:
        found = json.loads(text)
    except ValueError:
        return None, None
    if not isinstance(found, dict):
        return None, None
    score, rationale = found.get("score"), found.get("rationale")
    ok = isinstance(score, int) and not isinstance(score, bool) and 1 <= score <= 5 and isinstance(rationale, str)
    return (score, rationale) if ok else (None, None)


def quality(rows: DataFrame, window: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Per window, scenario and prompt version: ``judged, mean_score`` (null when none)``, no_outcome, judge_errors``.

    ``rows``: ``kind`` (verdict, no_outcome, judge_error), ``score, scenario, judge_prompt_version, event_time_ms``. With
    ``delay`` the rows may be a stream: a window is emitted once when the watermark passes its end.
    """
    timed = rows.withColumn("_time", F.timestamp_millis("event_time_ms"))
    timed = timed.withWatermark("_time", delay) if delay else timed
    verdict = F.col("kind") == "verdict"
    g = timed.groupBy(F.window("_time", window).alias("w"), F.coalesce("scenario", F.lit("")).alias("scenario"), F.col("judge_prompt_version")).agg(
        F.count_if(verdict).alias("judged"), F.sum(F.when(verdict, F.col("score"))).alias("total"), F.count_if(F.col("kind") == "no_outcome").alias("no_outcome"), F.count_if(F.col("kind") == "judge_error").alias("judge_errors"),
    )
    return g.select(F.unix_millis("w.start").alias("window_ms"), "scenario", "judge_prompt_version", "judged", F.when(F.col("judged") > 0, F.col("total") / F.col("judged")).alias("mean_score"), "no_outcome", "judge_errors")
