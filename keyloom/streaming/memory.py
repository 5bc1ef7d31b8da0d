"""Bounded state of one key: working memory, replay cache, and versioned JSON blobs for both."""

from __future__ import annotations

import base64
import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable

STATE_VERSION = 1
HARD_CAP = 1 << 20
SOFT_SHARE = 0.75
RING_ITEMS = 64
CACHE_ENTRIES = 64
CACHE_BYTES = 100 << 10
CACHE_TTL_MS = 6 * 3600_000
#: Steps from one version of a state blob to the next, applied on first read.
MIGRATIONS: dict[int, Callable[[dict], dict]] = {}


class FutureVersion(RuntimeError):
    """A blob written by a later build must fail the query, not be half read."""


def migrate(blob: dict | None) -> dict | None:
    if blob is None:
        return None
    version = blob.get("v") or 1
    if version > STATE_VERSION:
        raise FutureVersion(f"state version {version} is later than {STATE_VERSION}")
    while version < STATE_VERSION:
        blob = MIGRATIONS[version](dict(blob))
        version += 1
    return blob | {"v": version}


class MemoryOverflow(ValueError):
    """A write that would exceed the cap even after compaction."""


class Memory:
    """Strings to bytes, least recently used first; scalars and rings; exact accounting by the bytes of values.

    A write that would exceed the cap compacts first and is then tried again on what is left. Three quarters of the cap
    are a soft cap: the first write beyond it compacts too, once in the life of this object.
    """

    def __init__(self, cap: int = HARD_CAP, protected: tuple[str, ...] = ()):
        self.cap, self.protected = cap, protected
        self.items: OrderedDict[str, bytes | list[bytes]] = OrderedDict()
        self.size = 0
        self.crossed_soft_cap = False

    @staticmethod
    def _cost(key: str, value: bytes | list[bytes]) -> int:
        return len(value) if isinstance(value, bytes) else sum(map(len, value))

    def _after(self, key: str, value: bytes | list[bytes]) -> int:
        return self.size + self._cost(key, value) - (self._cost(key, self.items[key]) if key in self.items else 0)

    def _write(self, key: str, made: Callable[[], bytes | list[bytes]]) -> None:
        """``made`` gives the new value from what is stored, again after a compaction."""
        value = made()
        if self._after(key, value) > self.cap:
            self.compact()
            value = made()
            if self._after(key, value) > self.cap:
                raise MemoryOverflow(f"{key!r}: working memory would hold {self._after(key, value)} of {self.cap} bytes")
        self._put(key, value)
        if self.size >= SOFT_SHARE * self.cap and not self.crossed_soft_cap:
            self.crossed_soft_cap = True
            self.compact()

    def _put(self, key: str, value: bytes | list[bytes]) -> None:
        old = self.items.pop(key, None)
        self.size += self._cost(key, value) - (self._cost(key, old) if old is not None else 0)
        self.items[key] = value

    def set(self, key: str, value: bytes) -> None:
        """A scalar, in place of whatever was there."""
        self._write(key, lambda: bytes(value))

    def get(self, key: str) -> bytes | None:
        value = self.items.get(key)
        if isinstance(value, list):
            raise TypeError(f"{key!r} is a ring")
        if value is not None:
            self.items.move_to_end(key)
        return value

    def append(self, key: str, item: bytes, max_items: int = RING_ITEMS) -> None:
        """To a ring, which keeps its last ``max_items``: none, if that is not positive."""
        if isinstance(self.items.get(key), bytes):
            raise TypeError(f"{key!r} is a scalar")
        self._write(key, lambda: [*self.items.get(key, []), bytes(item)][-max_items:] if max_items > 0 else [])

    def set_ring(self, key: str, items: list[bytes]) -> None:
        self._write(key, lambda: list(items))

    def ring(self, key: str) -> list[bytes]:
        value = self.items.get(key, [])
        if isinstance(value, bytes):
            raise TypeError(f"{key!r} is a scalar")
        if key in self.items:
            self.items.move_to_end(key)
        return list(value)

    def delete(self, key: str) -> bool:
        value = self.items.pop(key, None)
        if value is not None:
            self.size -= self._cost(key, value)
        return value is not None

    def compact(self, fraction: float = 0.5) -> list[str]:
        """Drop the least recently used unprotected keys until ``fraction`` of the cap is in use."""
        gone = []
        for key in list(self.items):
            if self.size <= self.cap * fraction:
                break
            if not key.startswith(self.protected) if self.protected else True:
                self.delete(key)
                gone.append(key)
        return gone

    def dump(self) -> dict:
        enc = lambda v: base64.b64encode(v).decode()
        return {"v": STATE_VERSION, "items": [[k, enc(v)] if isinstance(v, bytes) else [k, [enc(x) for x in v]] for k, v in self.items.items()]}

    @classmethod
    def load(cls, blob: dict | None, cap: int = HARD_CAP, protected: tuple[str, ...] = ()) -> Memory:
        out = cls(cap, protected)
        for k, v in (migrate(blob) or {}).get("items", []):
            out._put(k, base64.b64decode(v) if isinstance(v, str) else [base64.b64decode(x) for x in v])
        return out


def cache_key(model: str, messages: list, tools: list, params: dict, entity_key: str, seq: int) -> str:
    """A retried activation asks the same question: no step is part of the key."""
    body = {"entity_key": entity_key, "messages": messages, "model": model, "params": params, "seq": seq, "tools": tools}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


class ReplayCache:
    """Model responses by request: bounded in entries and bytes, least recently used go first. An entry of
    exactly the age limit is still live. A response that is too large leaves its digest, which is a miss."""

    def __init__(self, entries: int = CACHE_ENTRIES, size: int = CACHE_BYTES, ttl_ms: int = CACHE_TTL_MS):
        self.max_entries, self.max_bytes, self.ttl_ms = entries, size, ttl_ms
        self.rows: OrderedDict[str, dict] = OrderedDict()

    @property
    def size(self) -> int:
        return sum(len(r["response"] or "") + len(k) for k, r in self.rows.items())

    def get(self, key: str, now_ms: int) -> str | None:
        row = self.rows.get(key)
        if row is None:
            return None
        if now_ms - row["created"] > self.ttl_ms:
            del self.rows[key]
            return None
        self.rows.move_to_end(key)
        return row["response"]

    def put(self, key: str, response: str, now_ms: int) -> None:
        self.rows.pop(key, None)
        digest = hashlib.sha256(response.encode()).hexdigest()
        self.rows[key] = {"created": now_ms, "digest": digest, "response": response if len(response) + len(key) <= self.max_bytes else None}
        while len(self.rows) > self.max_entries or self.size > self.max_bytes:
            self.rows.popitem(last=False)

    def dump(self) -> dict:
        return {"v": STATE_VERSION, "rows": [[k, r] for k, r in self.rows.items()]}

    @classmethod
    def load(cls, blob: dict | None, **kw) -> ReplayCache:
        out = cls(**kw)
        out.rows = OrderedDict((k, r) for k, r in (migrate(blob) or {}).get("rows", []))
        return out
