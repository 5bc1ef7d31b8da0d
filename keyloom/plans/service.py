"""The queries and the store over HTTP: thirteen read routes, four ingest endpoints, and a feed of changes.

``Service.respond`` maps a method, a path and parameters to a status and a JSON body, so it can be called without a
server; ``serve`` puts it behind the standard library's. Every answer is bounded: page sizes are clamped to 1..500, and
lists without pages are groups of small vocabularies or have their own limit.
"""

from __future__ import annotations

import http.server
import json
import threading
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import RecordStore
from ..sources import ingest
from . import console

PAGE, MOST, BUCKETS, MOST_BUCKETS, DAY_MS = 50, 500, 48, 1024, 24 * 3600_000


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


class LiveFeed:
    """Notices of what changed, one for each kind and activation of a batch, to any number of subscribers.

    A subscriber holds at most ``depth`` notices. What does not fit is counted, and the next thing it gets is one
    ``lagged`` notice with that count; publishing never waits for a reader.
    """

    def __init__(self, depth: int = 256):
        if depth < 1:
            raise ValueError("a subscriber holds one notice at least")
        self.depth, self.lock, self.readers = depth, threading.Condition(), {}

    def publish(self, notices: list[dict]) -> None:
        with self.lock:
            for box in self.readers.values():
                for n in notices:
                    if len(box["held"]) >= self.depth:
                        box["dropped"] += 1
                    else:
                        box["held"].append(n)
            self.lock.notify_all()

    def subscribe(self) -> Subscription:
        return Subscription(self)

    @staticmethod
    def notices(batch: dict[str, DataFrame]) -> list[dict]:
        """Of a batch: counts by kind, entity, sequence and trace, added up before they reach the driver."""
        out = []
        for table, kind in (("events", "trace"), ("errors", "error"), ("snapshots", "snapshot")):
            if table in batch:
                trace = F.col("trace_id") if table == "events" else F.lit("")
                for r in batch[table].groupBy("entity_key", "seq", trace.alias("trace_id")).count().orderBy("entity_key", "seq", "trace_id").toLocalIterator():
                    out.append({"kind": kind, "entity_key": r["entity_key"] or "", "seq": r["seq"], "trace_id": r["trace_id"], "count": r["count"]})
        return out


class Subscription:
    def __init__(self, feed: LiveFeed):
        self.feed, self.box = feed, {"held": deque(), "dropped": 0}
        with feed.lock:
            feed.readers[id(self)] = self.box

    def take(self, timeout: float | None = None) -> dict | None:
        """The next notice, or None if none came in time."""
        with self.feed.lock:
            if not self.feed.lock.wait_for(lambda: self.box["dropped"] or self.box["held"], timeout):
                return None
            if self.box["dropped"]:
                n, self.box["dropped"] = self.box["dropped"], 0
                return {"kind": "lagged", "entity_key": "", "seq": None, "trace_id": "", "count": n}
            return self.box["held"].popleft()

    def close(self) -> None:
        with self.feed.lock:
            self.feed.readers.pop(id(self), None)

    def frames(self, timeout: float = 15.0) -> Iterator[str]:
        """Server-sent events; a comment where nothing came for a while."""
        try:
            while True:
                n = self.take(timeout)
                yield ": idle\n\n" if n is None else f"data: {json.dumps(n, separators=(',', ':'))}\n\n"
        finally:
            self.close()


class NotFound(LookupError):
    pass


class BadRequest(ValueError):
    pass


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


class Service:
    def __init__(self, store: RecordStore, feed: LiveFeed | None = None, retention_ms: int | None = None):
        self.store, self.feed, self.retention_ms = store, feed or LiveFeed(), retention_ms
        self.spark: SparkSession = store.spark
        self.writing = threading.Lock()  # the store has one writer at a time
        self.routes: dict[str, Callable[[dict], object]] = {
            "overview": self.overview, "activations": self.activations, "traces": self.traces, "errors": self.errors, "errors/groups": self.error_groups,
            "models": lambda p: _rows(console.models(store.events, self._int(p, "since_ms")).orderBy(F.col("calls").desc(), "model")),
            "tools": lambda p: _rows(console.tools(store.events, self._int(p, "since_ms")).orderBy(F.col("calls").desc(), F.col("intents").desc(), "tool_name")),
            "approvals": lambda p: _rows(console.approvals(store, p.get("pending_only") in ("true", "1")).orderBy(F.col("requested_ms").desc(), F.col("intent_id").desc()).limit(self._limit(p, 100))),
            "entities": lambda p: self._page(console.entities(self.acts), ["last_seen_ms", "entity_key"], p),
            "search": lambda p: _rows(console.search(store, self.acts, p.get("q", ""), self._limit(p))),
            "store": lambda p: _rows(console.store_status(store, self.acts)),
        }

    @property
    def acts(self) -> DataFrame:
        return self.store.table("activations")

    @staticmethod
    def _int(p: dict, name: str, default: int | None = None) -> int | None:
        try:
            return int(p[name]) if p.get(name) not in (None, "") else default
        except ValueError as e:
            raise BadRequest(f"{name} is no number") from e

    def _limit(self, p: dict, default: int = PAGE) -> int:
        return clamp(self._int(p, "limit", default), 1, MOST)

    def _page(self, df: DataFrame, keys: list[str], p: dict) -> dict:
        try:
            rows = console.page(df, keys, p.get("cursor"), self._limit(p) + 1)
        except ValueError as e:
            raise BadRequest(str(e)) from e
        found = _rows(rows)
        more, found = len(found) > self._limit(p), found[: self._limit(p)]
        return {"items": found, "next_cursor": console.encode_cursor(tuple(found[-1][k] for k in keys)) if more else None, "total": df.count()}

    def overview(self, p: dict) -> dict:
        window, buckets = self._int(p, "window_ms", DAY_MS), clamp(self._int(p, "buckets", BUCKETS), 1, MOST_BUCKETS)
        parts = {k: _rows(v) for k, v in console.overview(self.store, self.acts, window, buckets).items()}
        return parts | {"headline": parts["headline"][0]}

    def activations(self, p: dict) -> dict:
        names = ("entity_key", "status", "kind", "model", "tool", "reason", "query")
        f = console.ActivationFilter(**{n: p[n] for n in names if p.get(n)}, since_ms=self._int(p, "since_ms"), until_ms=self._int(p, "until_ms"))
        return self._page(f.apply(self.acts), console.ACTIVATION_ORDER, p)

    def traces(self, p: dict) -> dict:
        return self._page(console.traces(self.acts, self.store.events, p.get("query") or None), ["started_ms", "entity_key", "seq"], p)

    def errors(self, p: dict) -> dict:
        u = console.unified_errors(self.store)
        for c in ("reason", "entity_key"):
            u = u.filter(F.col(c) == p[c]) if p.get(c) else u
        since = self._int(p, "since_ms")
        return self._page(u if since is None else u.filter(F.col("event_time_ms") >= since), console.ERROR_ORDER, p)

    def error_groups(self, p: dict) -> list[dict]:
        since = self._int(p, "since_ms")
        u = console.unified_errors(self.store)
        u = u if since is None else u.filter(F.col("event_time_ms") >= since)
        return _rows(console.error_groups(u).orderBy(F.col("count").desc(), "reason", "error_type"))

    def activation(self, entity_key: str, seq: int) -> dict:
        parts = {k: _rows(v) for k, v in console.activation_detail(self.store, self.acts, entity_key, seq).items()}
        if not parts["summary"]:
            raise NotFound(f"no activation {entity_key}#{seq}")
        return parts | {"summary": parts["summary"][0], "snapshot": (parts["snapshot"] or [None])[0], "replay": f"python -m keyloom.streaming.replay --seq {seq} --snapshot FILE --traces FILE --envelope FILE --agent MODULE:NAME"}

    def trace(self, trace_id: str) -> dict:
        parts = {k: _rows(v) for k, v in console.trace_detail(self.store, self.acts, trace_id).items()}
        if not parts["spans"]:
            raise NotFound(f"no trace {trace_id}")
        return parts

    def ingest(self, what: str, body: bytes, content_type: str = "") -> dict:
        """Decode, merge and announce a payload: what arrived and what it changed. Nothing is written if any of it cannot
        be read."""
        raw = self.spark.createDataFrame([(body,)], "value binary")
        if what == "traces":
            lines, cut = ([x for x in body.split(b"\n") if x.strip()], False) if body.lstrip()[:1] == b"{" else ingest.frames(body)
            if cut:
                raise BadRequest("the payload ends inside a frame")
            good, bad = ingest.decode_traces(self.spark.createDataFrame([(x,) for x in lines], "value binary"), provenance="native")
            batch = {"events": good}
        elif what == "otlp":
            if content_type.split(";")[0].strip() != "application/json":
                raise BadRequest(f"{content_type!r}: spans come as application/json")
            try:
                spans = [json.dumps(s) for r in json.loads(body)["resourceSpans"] for x in r["scopeSpans"] for s in x["spans"]]
            except (ValueError, KeyError, TypeError) as e:
                raise BadRequest(f"malformed spans: {e}") from e
            batch, bad = {"events": ingest.otlp_events(self.spark.createDataFrame([(s,) for s in spans], "span string"))}, None
        elif what == "errors":
            good, bad = ingest.decode_errors(raw, provenance="native")
            batch = {"errors": good}
        elif what == "snapshots":
            good, bad = ingest.decode_snapshots(raw, provenance="native")
            batch = {"snapshots": good}
        else:
            raise NotFound(what)
        if body.strip() and bad is not None and not bad.isEmpty():
            raise BadRequest(f"malformed {what} payload")
        accepted = sum(df.count() for df in batch.values())
        if not accepted:
            return {"accepted": 0, "written": 0}
        with self.writing:
            written = self.store.write(**batch)
        self.feed.publish(self.feed.notices(batch))
        return {"accepted": accepted, "written": written}

    def respond(self, method: str, target: str, body: bytes = b"", content_type: str = "") -> tuple[int, object]:
        u = urlsplit(target)
        parts, p = [unquote(x) for x in u.path.strip("/").split("/")], dict(parse_qsl(u.query))
        try:
            if method == "GET" and parts == ["healthz"]:
                return 200, {"status": "ok"}
            if method == "POST" and len(parts) == 2 and parts[0] == "ingest":
                return 200, self.ingest(parts[1], body, content_type)
            if method == "GET" and parts[0] == "api":
                rest = parts[1:]
                if "/".join(rest) in self.routes:
                    return 200, self.routes["/".join(rest)](p)
                if rest[:1] == ["activations"] and len(rest) > 2:
                    return 200, self.activation("/".join(rest[1:-1]), self._int({"seq": rest[-1]}, "seq"))
                if rest[:1] == ["traces"] and len(rest) == 2:
                    return 200, self.trace(rest[1])
            raise NotFound(u.path)
        except NotFound as e:
            return 404, {"type": "about:blank", "title": "not found", "status": 404, "detail": str(e)}
        except BadRequest as e:
            return 400, {"type": "about:blank", "title": "bad request", "status": 400, "detail": str(e)}


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> http.server.ThreadingHTTPServer:
    """A server that is not started yet: call ``serve_forever`` on it."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            if method == "GET" and urlsplit(self.path).path == "/api/stream":
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                frames = service.feed.subscribe().frames()
                try:
                    for f in frames:
                        self.wfile.write(f.encode())
                        self.wfile.flush()
                except OSError:  # the reader has gone
                    frames.close()
                return
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = service.respond(method, self.path, body, self.headers.get("Content-Type") or "")
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *_) -> None:
            pass

    return http.server.ThreadingHTTPServer((host, port), Handler)
