"""Best-effort export of spans: a data source that writes OTLP/JSON over HTTP and never fails or holds up a pipeline.

Each task puts its spans into batches, and batches into a bounded queue that a thread of its own sends from. A batch that finds the
queue full is dropped; so is what is not sent when the task's deadline is over. A refused connection or a server's error is
tried again until the deadline, a client's error isn't. Nothing is raised: tasks return their counts with their commit
messages, the driver adds them up for each batch, and ``report`` names a folder for them.

    spark.dataSource.register(exporter.SpanExport)
    exporter.spans(traces).write.format("otlp").mode("append").option("url", "http://collector:4318/v1/traces").save()
"""

from __future__ import annotations

import json
import os
import queue
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

BATCH, QUEUED, DEADLINE_S, SERVICE = 512, 8, 5.0, "keyloom"


@dataclass
class Counts(WriterCommitMessage):
    """What became of the spans of a task, or of a batch."""

    exported: int = 0
    dropped: int = 0
    requests: int = 0
    failures: int = 0

    def add(self, other: Counts) -> None:
        for k, v in asdict(other).items():
            setattr(self, k, getattr(self, k) + v)


class Refused(Exception):
    """The receiver has no use for these spans: sending them again is no use either."""


def post(url: str, service: str, timeout_s: float) -> Callable[[list[str]], None]:
    """A function that sends spans (JSON documents) in one request."""
    head = json.dumps({"attributes": [{"key": "service.name", "value": {"stringValue": service}}]})

    def send(spans: list[str]) -> None:
        body = f'{{"resourceSpans":[{{"resource":{head},"scopeSpans":[{{"spans":[{",".join(spans)}]}}]}}]}}'
        ask = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
        try:
            urllib.request.urlopen(ask, timeout=timeout_s).close()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code not in (408, 429):
                raise Refused(e.code) from e
            raise

    return send


class Outbound:
    """A bounded queue of batches and the thread that empties it. Only the thread touches the network."""

    def __init__(self, send: Callable[[list[str]], None], batch: int = BATCH, queued: int = QUEUED, deadline_s: float = DEADLINE_S):
        self.send, self.size, self.deadline_s = send, batch, deadline_s
        self.waiting: queue.Queue[list[str]] = queue.Queue(max(1, queued))
        self.open: list[str] = []
        self.end: float | None = None  # set when the task wants to be done
        self.lock, self.counts, self.given = threading.Lock(), Counts(), 0
        self.stopped = threading.Event()
        threading.Thread(target=self._run, daemon=True).start()

    def put(self, span: str) -> None:
        """Never blocks."""
        self.open.append(span)
        if len(self.open) >= self.size:
            self._enqueue()

    def _enqueue(self) -> None:
        if self.open:
            self.given += len(self.open)
            try:
                self.waiting.put_nowait(self.open)
            except queue.Full:
                self._count(dropped=len(self.open))
            self.open = []

    def _count(self, **what: int) -> None:
        with self.lock:
            if not self.stopped.is_set():  # what a thread left behind does later has been counted as dropped
                self.counts.add(Counts(**what))

    def _run(self) -> None:
        while not self.stopped.is_set():
            try:
                spans = self.waiting.get(timeout=0.02)
            except queue.Empty:
                continue
            self._deliver(spans)
            self.waiting.task_done()

    def _deliver(self, spans: list[str]) -> None:
        until, wait = time.monotonic() + self.deadline_s, 0.05
        while True:
            try:
                self._count(requests=1)
                self.send(spans)
                return self._count(exported=len(spans))
            except Refused:
                return self._count(failures=1, dropped=len(spans))
            except Exception:
                self._count(failures=1)
            left = min(until, self.end or until) - time.monotonic()
            if left <= 0 or self.stopped.wait(min(wait, left)):
                return self._count(dropped=len(spans))
            wait = min(2 * wait, 1.0)

    def finish(self) -> Counts:
        """Send what is left within the deadline, and count the rest as dropped."""
        self._enqueue()
        self.end = time.monotonic() + self.deadline_s
        while time.monotonic() < self.end and self.waiting.unfinished_tasks:
            time.sleep(0.01)
        time.sleep(0.02 if self.waiting.unfinished_tasks else 0)
        with self.lock:
            self.stopped.set()
            out = self.counts
            out.dropped = self.given - out.exported  # the queue's rest, and a batch that hangs in the network
        return out


class _Writer:
    def __init__(self, options: dict[str, str]):
        self.options = options
        if not options.get("url"):
            raise ValueError("otlp needs the option url")

    def write(self, iterator: Iterator) -> Counts:
        o = self.options
        deadline = float(o.get("deadline", DEADLINE_S))
        out = Outbound(post(o["url"], o.get("service", SERVICE), deadline), int(o.get("batch", BATCH)), int(o.get("queue", QUEUED)), deadline)
        for b in iterator:
            for span in b.column("span").to_pylist():
                if span is not None:
                    out.put(span)
        return out.finish()

    def _report(self, messages: list[Counts | None], name: str) -> None:
        whole = Counts()
        for m in messages:
            whole.add(m or Counts())
        folder = self.options.get("report")
        if folder:
            os.makedirs(folder, exist_ok=True)
            draft = os.path.join(folder, f".{name}.{os.getpid()}")
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(asdict(whole), f)
            os.replace(draft, os.path.join(folder, f"{name}.json"))


class SpanWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Counts | None]) -> None:
        self._report(messages, "batch")

    def abort(self, messages: list[Counts | None]) -> None:
        self._report(messages, "aborted")


class SpanStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Counts | None], batchId: int) -> None:  # noqa: N803
        self._report(messages, f"batch-{batchId}")

    def abort(self, messages: list[Counts | None], batchId: int) -> None:  # noqa: N803
        self._report(messages, f"aborted-{batchId}")


class SpanExport(DataSource):
    """Sink ``otlp`` for a column ``span``. Options: url; batch, queue, deadline (seconds), service, report (a folder of the driver)."""

    @classmethod
    def name(cls) -> str:
        return "otlp"

    def writer(self, schema, overwrite: bool) -> SpanWriter:
        return SpanWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> SpanStreamWriter:  # noqa: N802
        return SpanStreamWriter(dict(self.options))


def spans(traces: DataFrame) -> DataFrame:
    """The exported form of trace events. A start shares the span id of its end and is not exported."""
    from ..sources.ingest import otlp_spans

    both = {"start_ms": F.col("event_time_ms"), "end_ms": F.col("event_time_ms")}
    return otlp_spans(traces if "end_ms" in traces.columns else traces.withColumns(both))


def counts(folder: str) -> dict[str, Counts]:
    """The reports of a folder, by batch."""
    out = {}
    for n in sorted(os.listdir(folder) if os.path.isdir(folder) else []):
        if n.endswith(".json"):
            with open(os.path.join(folder, n), encoding="utf-8") as f:
                out[n.removesuffix(".json")] = Counts(**json.load(f))
    return out
