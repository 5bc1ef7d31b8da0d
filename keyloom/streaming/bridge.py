"""Runs an agent with a time limit and a grace period to stop in.

Agents run in one thread of the Python worker, which is kept from call to call. Past the limit the agent is asked to
stop: ``ctx.cancelled`` is set, and a coroutine is cancelled. One that has stopped by the end of the grace period leaves
the thread usable; otherwise the thread is left to itself and the next call gets a new one. Either way the call has
failed, and nothing that the agent staged counts.
"""

from __future__ import annotations

import asyncio
import contextlib
import inspect
import queue
import threading
import time
from collections.abc import Callable, Iterator


class ActivationTimeout(TimeoutError):
    pass


class _Thread:
    def __init__(self) -> None:
        self.jobs: queue.SimpleQueue = queue.SimpleQueue()
        self.thread = threading.Thread(target=self._work, daemon=True)
        self.thread.start()

    def _work(self) -> None:
        while True:
            job = self.jobs.get()
            if job is None:
                return
            call, stop, done = job
            try:
                done.put((True, _finish(call(), stop)))
            except BaseException as e:  # noqa: BLE001  it is raised again where the call was made
                done.put((False, e))


def _finish(result, stop: dict):
    """The result itself; of a coroutine, what it returns."""
    if not inspect.isawaitable(result):
        return result

    async def main():
        task = asyncio.ensure_future(result)
        loop = asyncio.get_running_loop()
        stop["cancel"] = lambda: loop.call_soon_threadsafe(task.cancel)
        return await task

    return asyncio.run(main())


_idle: list[_Thread] = []
_own = threading.local()
PATIENCE = 0.005  # seconds that an agent may take before its turn may pass to another


@contextlib.contextmanager
def taking(turn: threading.Lock) -> Iterator[None]:
    """This thread takes turns with others that were given the same lock: it holds it, but while its agent waits."""
    with turn:
        _own.turn = turn
        try:
            yield
        finally:
            _own.turn = None


def _result(thread: _Thread, done: queue.SimpleQueue, seconds: float) -> tuple:
    turn = getattr(_own, "turn", None)
    if turn is None or seconds <= PATIENCE:
        return done.get(timeout=seconds)
    clock = time.pthread_getcpuclockid(thread.thread.ident)
    spent = time.clock_gettime(clock)
    try:
        return done.get(timeout=PATIENCE)
    except queue.Empty:
        if time.clock_gettime(clock) - spent > PATIENCE / 5:  # it computes, and would only share the processor
            return done.get(timeout=seconds - PATIENCE)
    turn.release()
    try:
        return done.get(timeout=seconds - PATIENCE)
    finally:
        turn.acquire()


def run(call: Callable[[], object], timeout_ms: int | None, grace_ms: int, cancelled: threading.Event) -> object:
    """What ``call`` returns, or ActivationTimeout. Without a limit it runs where it is called."""
    if timeout_ms is None:
        return _finish(call(), {})
    thread = _idle.pop() if _idle else _Thread()
    stop: dict = {}
    done: queue.SimpleQueue = queue.SimpleQueue()
    thread.jobs.put((call, stop, done))
    try:
        ok, value = _result(thread, done, timeout_ms / 1000)
    except queue.Empty:
        cancelled.set()
        if "cancel" in stop:
            stop["cancel"]()
        try:
            _result(thread, done, grace_ms / 1000)
            _idle.append(thread)
        except queue.Empty:
            thread.jobs.put(None)
        raise ActivationTimeout(f"no result after {timeout_ms} ms") from None
    _idle.append(thread)
    if ok:
        return value
    raise value
