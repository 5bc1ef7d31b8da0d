"""Faults for tests: a commit or a timeout fails once, as a lost worker would make it, and the retry must give the same."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator

from . import kernel, processor


class ChaosFailure(BaseException):
    """Not an Exception: a fault of the machine must not be taken for one of the agent."""


@contextlib.contextmanager
def fail_first(step: str, matches: Callable[[list[dict]], bool] = lambda rows: True) -> Iterator[list]:
    """The first call of ``kernel.<step>`` (``on_envelope``, ``on_hitl``, ``on_flush``, ``on_ttl``) whose records match
    does all its work on a copy of the state and is then lost. Yields the list of records that were lost."""
    plain, lost = getattr(kernel, step), []

    def faulty(config, key, state, *args):
        if lost:
            return plain(config, key, state, *args)
        trial = kernel.KeyState.load(state.dump())
        rows = plain(config, key, trial, *args)
        if matches(rows):
            lost.append(rows)
            raise ChaosFailure(step)
        state.__dict__.update(trial.__dict__)
        return rows

    setattr(kernel, step, faulty)
    try:
        yield lost
    finally:
        setattr(kernel, step, plain)


class FaultyProcessor(processor.AgentProcessor):
    """The streaming operator, lost once after it has written all its state for a key and before the batch is committed.

    ``matches`` picks the call by its records. That it has happened is kept in a file, so the query that is started again from
    its checkpoint, on whatever worker, goes on undisturbed.
    """

    def __init__(self, config: kernel.Config, folder: str, matches: Callable[[list[dict]], bool], streams: tuple[str, ...] | None = None):
        super().__init__(config, streams)
        self.folder, self.matches = folder, matches

    def _store(self, key, state, stored, ordinal, armed, rows, now_ms, watermark_ms):
        out = super()._store(key, state, stored, ordinal, armed, rows, now_ms, watermark_ms)
        if self.matches(rows):
            with contextlib.suppress(FileExistsError):
                os.close(os.open(os.path.join(self.folder, "lost"), os.O_CREAT | os.O_EXCL))
                raise ChaosFailure(f"lost after the state of {key!r} was written")
        return out
