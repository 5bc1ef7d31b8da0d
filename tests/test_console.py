"""Fixtures of the query layer: the suspend/resume activation, merges in any order, gaps and percentiles."""

import itertools
import random

from pyspark.sql import functions as F

from keyloom import schemas
from keyloom.operators import merge, rollups
from keyloom.plans import console
from keyloom.sources.testbed import Store

T0 = 1_700_000_000_000


def events(spark, rows):
    full = [(r[0], r[1], r[2], "6b", 7, r[3], r[4], r[5], r[5], r[6], r[7] if len(r) > 7 else "native", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.TRACE_EVENT)


SUSPEND_RESUME = [
    ("t", "s1", "", 0, "ACTIVATION_START", T0, {"kind": "start"}),
    ("t", "s2", "s1", 1, "LLM_CALL", T0, {"model": "m", "input_tokens": "10", "output_tokens": "5", "cache_hit": "false"}),
    ("t", "s3", "s1", 2, "INTENT_EMITTED", T0, {"tool_name": "pay", "intent_kind": "APPROVAL", "intent_id": "i"}),
    ("t", "s4", "s1", 2, "SUSPENDED", T0, {"deadline_ms": str(T0 + 1000)}),
    ("t", "s1", "", 0, "ACTIVATION_END", T0, {"kind": "start", "status": "suspended"}),
    ("t", "s5", "", 0, "ACTIVATION_START", T0 + 900, {"kind": "resume"}),
    ("t", "s6", "s5", 3, "TOOL_CALL", T0 + 900, {"tool_name": "look"}),
    ("t", "s7", "s5", 4, "LLM_CALL", T0 + 900, {"model": "m", "input_tokens": "20", "output_tokens": "7", "cache_hit": "true"}),
    ("t", "s5", "", 0, "ACTIVATION_END", T0 + 900, {"kind": "resume", "status": "completed"}),
]


def store(spark, rows, errors=()):
    return Store(events(spark, rows), spark.createDataFrame(list(errors), schemas.ERROR_RECORD), spark.createDataFrame([], schemas.SNAPSHOT))


def test_suspend_and_resume_is_one_activation(spark):
    s = store(spark, SUSPEND_RESUME)
    a = rollups.activations(s.events, s.errors).first()
    assert (a["status"], a["kind"], a["attempts"], a["wall_ms"], a["total_tokens"], a["cache_hits"]) == ("completed", "resume", 2, 900, 42, 1)
    assert (a["tools"], a["llm_calls"], a["intents"]) == (["look", "pay"], 2, 1)
    t = console.attempts(s.events).orderBy("start_ms").collect()
    assert [(r["kind"], r["entry_step_index"], r["status"]) for r in t] == [("start", 1, "suspended"), ("resume", 3, "completed")]
    p = console.approvals(s).first()
    assert (p["deadline_ms"], p["decision"], p["escalations"]) == (T0 + 1000, "pending", 0)
    tree = [tuple(r) for r in console.span_tree(s.events).orderBy("position").select("span_id", "depth").collect()]
    assert tree == [("s1", 0), ("s2", 1), ("s3", 1), ("s4", 1), ("s5", 0), ("s6", 1), ("s7", 1)]
    d = console.activation_detail(s, rollups.activations(s.events, s.errors), "6b", 7)
    assert d["events"].count() == 9 and d["summary"].count() == 1 and d["snapshot"].count() == 0


def test_open_attempt_is_in_flight_and_single_attempt_has_no_wall(spark):
    s = store(spark, SUSPEND_RESUME[:7])
    a = rollups.activations(s.events, s.errors).first()
    assert (a["status"], a["ended_ms"], a["wall_ms"]) == ("in_flight", None, None)
    s = store(spark, SUSPEND_RESUME[:5])
    a = rollups.activations(s.events, s.errors).first()
    assert (a["status"], a["wall_ms"]) == ("suspended", None)


def test_error_record_alone_makes_an_activation_and_unifies_with_its_trace(spark):
    err = ("e1", "6b", None, "activation_error", "boom", T0 + 5, "native", 1)
    s = store(spark, [("t", "s1", "", 0, "ACTIVATION_START", T0, {}), ("t", "s9", "s1", 1, "ERROR", T0 + 4, {"reason": "activation_error", "error_type": "ValueError"})], [err])
    u = [tuple(r) for r in console.unified_errors(s).select("seq", "detail", "error_type").collect()]
    assert u == [(None, "boom", "ValueError")]
    only = store(spark, [], [("e2", "6b", 3, "activation_timeout", "", T0, "native", 1)])
    a = rollups.activations(only.events, only.errors).first()
    assert (a["status"], a["seq"], a["started_ms"], a["errors"], len(a["trace_id"])) == ("error", 3, T0, 1, 32)


def test_merge_any_order_and_repetition(spark):
    native = [("t", f"s{i}", "p", "6b", 7, i, "LLM_CALL", T0 + i, T0 + i, {"model": "m", "x": str(i)}, "native", i) for i in range(6)]
    late = [("t", f"s{i}", "", "", 0, 0, "LLM_CALL", 0, 0, {"x": "late"}, "otlp", 100 + i) for i in range(0, 6, 2)]
    want = None
    for seed in range(3):
        rows = [*native, *late, *native[:3]]
        random.Random(seed).shuffle(rows)
        m = merge.merged(spark.createDataFrame(rows, schemas.TRACE_EVENT))
        got = sorted((r["span_id"], r["seq"], r["step_index"], r["entity_key"], r["start_ms"], r["provenance"], tuple(sorted(r["attributes"].items()))) for r in m.collect())
        want = want or got
        assert got == want
    assert want[0] == ("s0", 7, 0, "6b", T0, "native", (("model", "m"), ("x", "late")))
    stored = merge.merge_events(spark.createDataFrame(native, schemas.TRACE_EVENT))
    assert merge.changed(stored, stored, merge.EVENT_KEY).count() == 0


def test_pages_cover_everything_once(spark):
    rows = [(T0 + i // 3, f"k{i % 5}", i) for i in range(47)]
    df = spark.createDataFrame(rows, "started_ms bigint, entity_key string, seq bigint")
    seen, cursor = [], None
    for _ in itertools.count():
        page, cursor, total = console.fetch_page(df, console.ACTIVATION_ORDER, cursor, 10)
        seen += [tuple(r) for r in page]
        assert total == 47
        if cursor is None:
            break
    assert seen == sorted(rows, reverse=True)


def test_gap_fill_percentile_and_ratio(spark):
    df = spark.createDataFrame([("a", 5), ("a", 38), ("b", 12)], "g string, t bigint")
    got = sorted(tuple(r) for r in console.gap_filled(df, ["g"], "t", F.lit(10), F.count("*")).collect())
    assert got == [("a", 0, 1.0), ("a", 10, 0.0), ("a", 20, 0.0), ("a", 30, 1.0), ("b", 10, 1.0)]
    p = spark.createDataFrame([(x,) for x in range(10, 201, 10)], "w bigint").selectExpr("percentile_disc(0.5) within group (order by w) p50", "percentile_disc(0.95) within group (order by w) p95").first()
    assert (p["p50"], p["p95"]) == (100, 190)
    assert console.bucket_size(100, 48) == 3 and console.bucket_size(0, 48) == 1


def test_never_measured_is_null_not_zero(spark):
    e = events(spark, [("t", "a", "", 0, "LLM_CALL", T0, {"model": "m"}), ("t", "b", "", 0, "LLM_CALL", T0, {"model": "n", "input_tokens": "0", "cache_hit": "false"})])
    got = {r["model"]: (r["prompt_tokens"], r["total_tokens"], r["cache_hit_ratio"]) for r in console.models(e).collect()}
    assert got == {"m": (None, None, None), "n": (0, 0, 0.0)}


def test_empty_store(spark):
    s = store(spark, [])
    a = rollups.activations(s.events, s.errors)
    assert a.count() == 0 and console.newest(s, a) is None
    assert console.overview(s, a, 1000)["headline"].first()["activations"] == 0
