"""Leases shared by workers, and intents executed once: by tables, by queues, and on a stream that is started again."""

import json
import multiprocessing
import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from keyloom.operators import effects
from keyloom.operators.effects import Executor, Waiting
from keyloom.operators.leases import LeaseFolder, Standing
from keyloom.streaming import effector, outbox, sinks

from .conftest import ROOT


class Clock:
    now = 1_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def two(tmp_path, clock):
    """Two workers on one folder."""
    return LeaseFolder(f"file://{tmp_path}/leases", clock), LeaseFolder(f"{tmp_path}/leases", clock)


# -- leases -----------------------------------------------------------------------------------------------------------


def test_a_name_has_one_holder(two, clock):
    a, b = two
    first = a.ask("i", 100)
    assert (first.kind, first.until_ms) == ("granted", clock.now + 100)
    assert b.ask("i", 100) == Standing("held", first.fence, first.until_ms) == a.ask("i", 100)
    clock.now += 99
    assert b.ask("i").kind == "held"


def test_an_outcome_is_kept_as_it_was_stored(two, clock):
    a, b = two
    outcome = {"payload": '"é\\n"', "seq": 2**60, "status": "OK", "none": None}
    assert a.settle("i", a.ask("i").fence, outcome, 500)
    assert b.ask("i").outcome == outcome == a.ask("i").outcome
    assert json.dumps(b.ask("i").outcome, sort_keys=True) == json.dumps(outcome, sort_keys=True)
    assert a.settle("approval", a.ask("approval").fence, None) and (b.ask("approval").kind, b.ask("approval").outcome) == ("settled", None)
    clock.now += 500
    again = b.ask("i")
    assert again.kind == "granted" and again.fence > 2  # fences go on growing


def test_only_the_holder_settles_or_gives_back(two):
    a, b = two
    got = a.ask("i")
    for worker, fence in ((b, got.fence), (a, got.fence + 1), (a, got.fence - 1)):
        assert not worker.settle("i", fence, {}) and not worker.give_back("i", fence)
    assert b.ask("i").kind == "held"
    assert a.give_back("i", got.fence) and not a.give_back("i", got.fence) and not a.settle("i", got.fence, {})
    assert b.ask("i").kind == "granted" and b.grants("i") == 1


def test_who_takes_over_decides(two, clock):
    a, b = two
    old = a.ask("i", 100)
    clock.now += 100
    assert not a.settle("i", old.fence, {"by": "a"})  # too late even before anyone took over
    new = b.ask("i", 100)
    assert new.kind == "granted" and new.fence > old.fence
    assert not a.settle("i", old.fence, {"by": "a"}) and not a.give_back("i", old.fence)
    assert b.settle("i", new.fence, {"by": "b"}) and not b.settle("i", new.fence, {"by": "x"}) and a.ask("i").outcome == {"by": "b"}
    assert a.grants("i") == 2


def test_a_folder_that_workers_cannot_mount_is_refused():
    with pytest.raises(ValueError):
        LeaseFolder("hdfs://host/leases")
    assert LeaseFolder("file:///a/b").top == LeaseFolder("file:/a/b").top == LeaseFolder("/a/b").top == "/a/b"


def test_swept_names_are_as_if_never_seen(two, clock):
    a, b = two
    for name in ("old", "kept"):
        a.settle(name, a.ask(name).fence, {}, 100 if name == "old" else 10_000)
    a.ask("held", 10)
    clock.now += 200
    assert b.sweep() == 1 and b.sweep() == 0
    assert a.ask("kept").kind == "settled" and a.ask("old").fence == 1 and a.ask("held").kind == "granted"


def _contend(folder, names, out):
    worker = LeaseFolder(folder)
    for n in names:
        if worker.ask(n).kind == "granted":
            out.put(n)


def test_many_processes_at_once(tmp_path):
    names, found = [f"i{k}" for k in range(60)], multiprocessing.get_context("spawn")
    out = found.Queue()
    workers = [found.Process(target=_contend, args=(str(tmp_path / "l"), names, out)) for _ in range(4)]
    for w in workers:
        w.start()
    got = [out.get(timeout=60) for _ in names]
    for w in workers:
        w.join(30)
    assert sorted(got) == sorted(names) and out.empty()


def test_leases_between_executors(tmp_path):
    """The same names asked for in every task of two executors: each is granted once."""
    script = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
def work(batches):
    import os
    import pyarrow as pa
    from keyloom.operators.leases import LeaseFolder
    folder = LeaseFolder({str(tmp_path / "l")!r})
    for b in batches:
        got = [n for n in (f"i{{k}}" for k in range(40)) if folder.ask(n).kind == "granted"]
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array([os.getcwd()] * len(got))], ["name", "executor"])
rows = s.range(4).repartition(4, "id").mapInArrow(work, "name string, executor string").collect()
print("GRANTED", sorted(r.name for r in rows) == sorted(f"i{{k}}" for k in range(40)))
s.stop()
"""
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=240)
    assert "GRANTED True" in done.stdout, done.stderr[-2000:]


# -- one intent -------------------------------------------------------------------------------------------------------


def intent(k=1, **kw):
    return {"intent_id": f"i{k}", "entity_key": "6b", "seq": 0, "step_index": k, "tool_name": "pay", "kind": "TOOL", "args_json": f'{{"n":{k}}}', "expires_at_ms": 10**15} | kw


@pytest.fixture
def calls():
    return []


@pytest.fixture
def worker(tmp_path, clock, calls):
    def make(**kw):
        w = Executor({"pay": lambda n: calls.append(n) or n, "stop": lambda n: threading.Event().wait(20)}, str(tmp_path / "leases"), clock=clock, **kw)
        w._folder = LeaseFolder(w.leases, clock)
        return w

    return make


def test_expiry_and_authenticity_come_before_the_lease(worker, tmp_path, calls, clock):
    for when in (clock.now, 0, None, -5):
        kind, row = worker().step(intent(expires_at_ms=when))
        assert (kind, row["status"]) == ("result", "EXPIRED")
    assert worker(check=lambda i: "unsigned").step(intent()) [0] == "refused"
    assert calls == [] and not (tmp_path / "leases").exists()


def test_a_settled_intent_is_told_again_and_not_run_again(worker, calls, clock):
    first = worker().step(intent())
    clock.now += 50
    other = worker()
    assert other.step(intent()) == first and calls == [1] and other.counts == {"repeated": 1}
    assert worker().step(intent(2, kind="APPROVAL"))[0] == "approval" and worker().step(intent(2, kind="APPROVAL")) == ("done", {})


def test_a_held_intent_waits_and_nothing_overtakes_it(worker, calls, clock):
    dead = worker(lease_ms=1000)
    held = dead.folder.ask("i1", 1000)
    queue = [intent(1), intent(2)]
    assert effector.work_off(queue, worker()) == ([], held.until_ms) and len(queue) == 2 and calls == []
    clock.now += 1000  # its worker is gone
    rows, until = effector.work_off(queue, worker())
    assert [r["intent_id"] for r in rows] == ["i1", "i2"] and until is None and queue == [] and calls == [1, 2]


def test_a_wait_ends_when_the_other_settles(worker, calls):
    other = worker()
    got = other.folder.ask("i1")
    with pytest.raises(Waiting):
        worker().step(intent())
    made = effects.result(intent(), "OK", 5, '"theirs"')
    assert other.folder.settle("i1", got.fence, made)
    assert worker().step(intent()) == ("result", made) and calls == []


def test_a_lost_lease_gives_no_result(worker, clock, tmp_path):
    slow = worker(lease_ms=100)

    def late(n):
        clock.now += 200  # the lease ran out in the middle
        assert LeaseFolder(str(tmp_path / "leases"), clock).ask("i1").kind == "granted"

    slow.tools["pay"] = late
    with pytest.raises(Waiting):
        slow.step(intent())
    assert slow.counts == {"lost": 1}


def test_a_tool_has_a_time_limit(worker):
    began = time.monotonic()
    kind, row = worker(limit_ms=100).step(intent(tool_name="stop"))
    assert row["status"] == "ERROR" and "unknown whether" in row["error_message"] and time.monotonic() - began < 10


def test_signatures_are_checked_first(spark, worker, calls):
    rows = sinks.signed(spark.createDataFrame([intent(1), intent(2)], "intent_id string, entity_key string, seq bigint, step_index bigint, tool_name string, kind string, args_json string, expires_at_ms bigint"), "k", "secret")
    verdicts = {r.intent_id: r.verdict for r in sinks.verified(rows.withColumn("args_json", F.when(F.col("step_index") == 2, "{}").otherwise(F.col("args_json"))), {"k": "secret"}).collect()}
    one = worker(check=lambda i: None if verdicts[i["intent_id"]] == "ok" else verdicts[i["intent_id"]])
    assert [one.step(intent(k))[0] for k in (1, 2)] == ["result", "refused"] and calls == [1]


# -- tables and streams -----------------------------------------------------------------------------------------------


def logging_tools(folder):
    def pay(n):
        with open(f"{folder}/calls", "a") as f:  # one write to the end of a file
            f.write(f"{n}\n")
        return n

    return {"pay": pay}


SHAPE = "intent_id string, entity_key string, seq bigint, step_index bigint, tool_name string, kind string, args_json string, expires_at_ms bigint"


def test_a_second_action_runs_no_tool(spark, tmp_path):
    df = spark.createDataFrame([intent(k, entity_key=f"k{k % 3}") for k in range(12)] * 2, SHAPE)
    executor = Executor(logging_tools(tmp_path), f"{tmp_path}/leases")
    out = effects.execute(df, executor)
    assert out.count() == 12 and sorted(r.payload for r in out.collect()) == sorted(str(k) for k in range(12))
    assert sorted(r.payload for r in effects.execute(df, executor).collect()) == sorted(str(k) for k in range(12))
    ran = (tmp_path / "calls").read_text().split()
    assert sorted(ran) == sorted(str(k) for k in range(12))
    assert {r.grants for r in effects.grants(df, executor.leases).collect()} == {1}
    for key in range(3):  # in order within a key
        own = [int(n) for n in ran if int(n) % 3 == key]
        assert own == sorted(own)


def test_a_stream_that_starts_again_runs_no_tool_twice(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    executor = Executor(logging_tools(tmp_path), f"{tmp_path}/leases", lease_ms=60_000)
    blocked = LeaseFolder(executor.leases).ask("i2", 60_000)  # another worker has it
    assert blocked.kind == "granted"
    rows = [intent(k) for k in (1, 2, 3)] + [intent(4, entity_key="7c"), intent(5, entity_key="7c", kind="APPROVAL")]
    spark.createDataFrame(rows[::-1], SHAPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = effector.run_effects_stream(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), executor, retry_ms=100)

    def run(sink, checkpoint):
        out.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(once=True).start().awaitTermination(120)

    def dies(df, batch):
        df.collect()
        raise RuntimeError("before the checkpoint knows")

    with pytest.raises(Exception, match="before the checkpoint"):
        run(dies, "cp")
    assert sorted((tmp_path / "calls").read_text().split()) == ["1", "4"]
    got = []
    run(lambda df, batch: got.extend(df.collect()), "cp")
    assert sorted((r.intent_id, r.kind, r.status) for r in got if r.intent_id != "i5") == [("i1", "result", "OK"), ("i4", "result", "OK")]  # i2 waits, i3 behind it
    assert sorted((tmp_path / "calls").read_text().split()) == ["1", "4"]
    folder = LeaseFolder(executor.leases)
    folder.worker = "other"  # time passes: the lease is over
    place = folder._place("i2")
    n, last = folder._last(place)
    assert folder._add(place, n + 1, last | {"until_ms": 1})
    time.sleep(0.3)
    spark.createDataFrame([intent(6, entity_key="8d")], SHAPE).write.mode("append").parquet(str(tmp_path / "in"))
    run(lambda df, batch: got.extend(df.collect()), "cp")
    assert [r.intent_id for r in got if r.entity_key == "6b"] == ["i1", "i2", "i3"]
    assert sorted((tmp_path / "calls").read_text().split()) == ["1", "2", "3", "4", "6"]


# -- the ordered outbox -----------------------------------------------------------------------------------------------


def files(folder):
    """A client that appends to a file for each key, and fails while the key is down."""

    def connect():
        def send(key, value):
            if os.path.exists(f"{folder}/down-{key.decode()}"):
                raise ConnectionError("down")
            if b"never" in value:
                raise outbox.Unsendable("too odd")
            with open(f"{folder}/sent-{key.decode()}", "ab") as f:
                f.write(value + b"\n")

        return send

    return connect


def sent(folder, key):
    path = folder / f"sent-{key}"
    return [json.loads(x)["intent_id"] for x in path.read_text().splitlines()] if path.exists() else []


MESSAGE = SHAPE + ", created_at_ms bigint"


def test_a_failure_holds_up_one_key(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "down-6b").touch()
    row = lambda k, **kw: tuple((intent(k) | {"created_at_ms": 1} | kw).values())
    first = [row(3), row(1), row(2, args_json="never"), row(9, args_json='{"never":1}'), row(4, entity_key="7c"), row(5, entity_key="x" * 2000), row(6, entity_key=None), row(7, entity_key="7c", args_json='{"never":1}')]
    spark.createDataFrame(first, MESSAGE).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = outbox.publish_stream(spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in")), outbox.Publisher(files(tmp_path)), key_id="k", secret="s", retry_ms=100)
    got = []

    def run():
        out.writeStream.foreachBatch(lambda df, batch: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination(120)

    run()
    assert sent(tmp_path, "6b") == [] and sent(tmp_path, "7c") == ["i4"]
    assert sorted((r.intent_id, r.kind, r.error_message) for r in got) == [("i4", "sent", None), ("i5", "dead_letter", "the key is too long"), ("i6", "dead_letter", "no key"), ("i7", "dead_letter", "too odd")]
    (tmp_path / "down-6b").unlink()
    time.sleep(0.3)
    spark.createDataFrame([row(8), row(0)], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # after a restart: in order, with what came meanwhile in its place
    assert sent(tmp_path, "6b") == ["i0", "i1", "i3", "i8"]
    assert [(r.intent_id, r.kind) for r in got if r.entity_key == "6b"] == [("i0", "sent"), ("i1", "sent"), ("i2", "dead_letter"), ("i3", "sent"), ("i8", "sent"), ("i9", "dead_letter")]
    assert {"signature", "key_id"} <= json.loads((tmp_path / "sent-6b").read_text().splitlines()[0]).keys()
