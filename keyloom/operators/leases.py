"""Leases on names, shared by all executors through a folder that they see.

Each name has a folder of numbered entries, and the last one says how it stands. To change that, a worker reads entry ``n`` and
creates entry ``n + 1`` by a hard link, which succeeds for one of any number of workers and never overwrites. So

* two workers that ask for a name at once get one lease between them,
* a worker whose lease ran out can neither store an outcome nor give the name back once another has taken over,
* an entry's number is a *fence*: it grows with each lease, so whatever a tool writes to can refuse a lower one.

A lease ends by its time, an outcome is kept for a time of its own, and after that the name is as if never seen. Entries
are whole files written before they are linked; a reader never meets half of one. Older entries go when a new one stands.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .staging import mounted

LEASE_MS, KEEP_MS = 300_000, 24 * 3600_000


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


@dataclass(frozen=True)
class Standing:
    """How a name stands for the one who asked: ``granted`` (with the fence to prove it), ``held`` by another until ``until_ms``,
    or ``settled`` with an outcome, which may be None."""

    kind: str
    fence: int = 0
    until_ms: int = 0
    outcome: dict | None = None


class LeaseFolder:
    """Leases under a folder of a file system with hard links that all workers mount (``file:`` or a plain path)."""

    def __init__(self, folder: str, clock: Callable[[], int] = _now_ms):
        self.top = mounted(folder)
        self.clock = clock
        self.worker = uuid.uuid4().hex

    def _place(self, name: str) -> str:
        h = hashlib.sha256(name.encode()).hexdigest()
        return os.path.join(self.top, h[:2], h[2:])

    @staticmethod
    def _entries(place: str) -> list[int]:
        with contextlib.suppress(FileNotFoundError, NotADirectoryError):
            return sorted(int(x) for x in os.listdir(place) if x.isdigit())
        return []

    def _last(self, place: str) -> tuple[int, dict]:
        while True:
            found = self._entries(place)
            if not found:
                return 0, {"kind": "free"}
            with contextlib.suppress(FileNotFoundError):  # a newer entry has replaced it: look again
                with open(os.path.join(place, f"{found[-1]:09}"), encoding="utf-8") as f:
                    return found[-1], json.load(f)

    def _add(self, place: str, n: int, entry: dict) -> bool:
        """Make entry ``n`` the last one, unless another worker was first."""
        os.makedirs(place, exist_ok=True)
        draft = os.path.join(place, f".{uuid.uuid4().hex}")
        try:
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(entry, f, sort_keys=True, separators=(",", ":"))
                f.flush()
                os.fsync(f.fileno())
            os.link(draft, os.path.join(place, f"{n:09}"))
        except FileExistsError:
            return False
        except FileNotFoundError:  # the name was swept away meanwhile
            return False
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(draft)
        for old in self._entries(place):
            if old < n:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(os.path.join(place, f"{old:09}"))
        return True

    def ask(self, name: str, lease_ms: int = LEASE_MS) -> Standing:
        """Take the name if it is free or its lease or outcome has run out."""
        place = self._place(name)
        while True:
            n, last = self._last(place)
            now = self.clock()
            if last["kind"] != "free" and last["until_ms"] > now:
                return Standing("settled", n, last["until_ms"], last["outcome"]) if last["kind"] == "settled" else Standing("held", n, last["until_ms"])
            grants = last.get("grants", 0) + 1 if last["kind"] != "settled" else 1
            if self._add(place, n + 1, {"kind": "held", "by": self.worker, "until_ms": now + lease_ms, "grants": grants}):
                return Standing("granted", n + 1, now + lease_ms)

    def _mine(self, name: str, fence: int) -> tuple[str, dict | None]:
        place = self._place(name)
        n, last = self._last(place)
        own = n == fence and last["kind"] == "held" and last["by"] == self.worker and last["until_ms"] > self.clock()
        return place, last if own else None

    def settle(self, name: str, fence: int, outcome: dict | None, keep_ms: int = KEEP_MS) -> bool:
        """Store the outcome of a lease that still holds; false if it does not: then whoever took over decides."""
        place, last = self._mine(name, fence)
        return last is not None and self._add(place, fence + 1, {"kind": "settled", "outcome": outcome, "until_ms": self.clock() + keep_ms, "grants": last["grants"]})

    def give_back(self, name: str, fence: int) -> bool:
        """End a lease under which nothing has been done."""
        place, last = self._mine(name, fence)
        return last is not None and self._add(place, fence + 1, {"kind": "free", "grants": last["grants"] - 1})

    def grants(self, name: str) -> int:
        """How often the name has been granted since it was last unknown, without those given back."""
        return self._last(self._place(name))[1].get("grants", 0)

    def sweep(self) -> int:
        """Remove names whose outcome has run out; how many. A name that changes meanwhile is put back."""
        n = 0
        for place in self._places():
            last = self._last(place)[1]
            if last["kind"] != "settled" or last["until_ms"] > self.clock():
                continue
            aside = f"{place}.{uuid.uuid4().hex}"
            with contextlib.suppress(FileNotFoundError):
                os.rename(place, aside)
                if self._last(aside)[1] == last:
                    shutil.rmtree(aside)
                    n += 1
                else:
                    os.rename(aside, place)
        return n

    def _places(self) -> Iterator[str]:
        for a in sorted(os.listdir(self.top)) if os.path.isdir(self.top) else []:
            for b in sorted(os.listdir(os.path.join(self.top, a))):
                if "." not in b:
                    yield os.path.join(self.top, a, b)
