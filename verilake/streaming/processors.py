"""Stateful processors: event-time folds of a key's rows, with timers that end and clear the state.

Keys are dealt into buckets by a hash, and a bucket is what Spark groups by: its state is one list with a row for
each live key, read and written once a batch, and it has one timer, for the key that is due first. So calls of the
state store, timers and frames of pandas are counted by buckets and not by keys.

Rows of a key come in no order within a batch. What must be folded in order is gathered as columns of
numbers and sorted; the state of a key is a few numbers, or a list of bounded length.
Times are microseconds, timers milliseconds of event time: they fire when the watermark has passed them.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verilake.operators.challenge import MAX_FRAMES

SIGNALS = ("x1", "y1", "x2", "y2", "yaw", "pitch_signal", "ear", "mouth_width_ratio", "passive_score")
#: A frame as it is read, kept and given back: missing has bit i where signal i is null, which pandas can't tell from NaN.
FRAME = ", ".join(["missing: int", *[f"{c}: double" for c in SIGNALS]])
#: Rows given back at once.
ROWS = 10_000


def _millis(micros: int) -> int:
    """The first whole millisecond at or after a time."""
    return -(-int(micros) // 1000)


def _values(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows' values of these columns as plain Python's."""
    for some in rows:
        yield from zip(*[some[c].tolist() for c in columns])


class _Timed(StatefulProcessor):
    """A processor of a bucket's keys. Each live key has one state, whose last number is the millisecond at which it is due.

    Subclasses name the state, its columns and those of the result, take a key's new rows (gather, fold) and say what time does to it (expire).
    """

    NAME, STATE, MADE = "", "", ()

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getListState(self.NAME, f"key {self.kind}, {self.STATE}, due long")
        self.timer = handle.getValueState("timer", "at long")

    def _read(self) -> dict:
        return {key: state for key, *state in self.keys.get()}

    def _write(self, live: dict, watermark: int, old: int | None) -> None:
        """The bucket's state, and its timer in place of an old one; one that is due already fires with the next watermark."""
        if live:
            self.keys.put([(key, *state) for key, state in live.items()])
        else:
            self.keys.clear()
        new = max(min(state[-1] for state in live.values()), watermark + 1) if live else None
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        if new is None:
            self.timer.clear()
        else:
            self.timer.update((new,))

    def _frames(self, made: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while some := list(itertools.islice(made, ROWS)):
            yield pd.DataFrame(some, columns=list(self.MADE))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._frames(self._taken_in(rows, timerValues.getCurrentWatermarkInMs()))

    def _taken_in(self, rows, watermark: int) -> Iterator[tuple]:
        old, live = self.timer.get(), self._read()
        for own, found in self.gather(rows).items():
            state = yield from self.fold(own, found, live.get(own))
            if state is not None:
                live[own] = [*state[:-1], max(state[-1], watermark + 1)]
        self._write(live, watermark, old[0] if old else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._frames(self._timed_out(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def _timed_out(self, watermark: int, fired: int) -> Iterator[tuple]:
        live = self._read()
        for own in [k for k, state in live.items() if state[-1] < watermark or state[-1] <= fired]:
            state = yield from self.expire(own, live.pop(own), watermark)
            if state is not None:
                live[own] = [*state[:-1], max(state[-1], watermark + 1)]
        self._write(live, watermark, None)  # Spark deletes the timer that has fired

    def expire(self, key, state, watermark: int):
        """Time ends a key's state: what it yields; a new state, or None."""
        yield from ()

    def close(self) -> None:
        pass


class Windows(_Timed):
    """Windows of so many seconds anchored at their first event: each event's place in its window, and whether it is over the limit."""

    NAME, STATE, MADE = "window", "anchor long, nth long", ("key", "event_id", "nth", "repeat")

    def __init__(self, kind: str, seconds: float, limit: int):
        super().__init__(kind)
        self.micros, self.limit = round(seconds * 1_000_000), limit

    def gather(self, rows) -> dict:
        found = defaultdict(lambda: (array("q"), array("q")))
        for own, at, event in _values(rows, "key", "at", "event_id"):
            times, ids = found[own]
            times.append(at)
            ids.append(event)
        return found

    def fold(self, key, found, state):
        at, ids = found
        order = np.lexsort((np.frombuffer(ids, np.int64), np.frombuffer(at, np.int64))) if len(at) > 1 else (0,)
        anchor, nth, _ = state or (None, 0, None)
        for i in order:
            if anchor is None or at[i] - anchor >= self.micros:
                anchor, nth = at[i], 0
            nth += 1
            yield key, ids[i], nth, nth > self.limit
        return anchor, nth, _millis(anchor + self.micros)


class Tokens(_Timed):
    """Single-use tokens: rows with event_id -1 issue one, the first other row within its life takes it; ids aren't negative."""

    NAME, STATE, MADE = "life", "issued long, used boolean", ("token", "event_id", "at")

    def __init__(self, kind: str, seconds: float):
        super().__init__(kind)
        self.micros = round(seconds * 1_000_000)

    def gather(self, rows) -> dict:
        found = defaultdict(list)
        for own, at, event in _values(rows, "token", "at", "event_id"):
            found[own].append((at, event))
        return found

    def fold(self, key, found, state):
        issued, used, _ = state or (None, False, None)
        # An issue comes before a consumption at the same time.
        for at, event in sorted(found):
            if event < 0:
                issued, used = at, False
            elif issued is not None and not used and at - issued < self.micros:
                used = True
                yield key, event, at
        return None if issued is None else (issued, used, _millis(issued + self.micros))


class Sessions(_Timed):
    """Frames of a challenge up to MAX_FRAMES with a face, until it is idle or its time is over."""

    NAME, STATE, MADE = "session", "start long, last long, done boolean", ("challenge_id", "start", "frames")
    FIELDS = ("missing", *SIGNALS)

    def __init__(self, kind: str, idle: float, total: float):
        super().__init__(kind)
        self.idle, self.total = round(idle * 1_000_000), round(total * 1_000_000)

    def init(self, handle):
        super().init(handle)
        # The numbers of a live session's frames, one after the other.
        self.frames = handle.getListState("frames", f"key {self.kind}, numbers array<double>")

    def _read(self) -> dict:
        self.held = dict(self.frames.get())
        return super()._read()

    def _write(self, live, watermark, old):
        if self.held:
            self.frames.put(list(self.held.items()))
        else:
            self.frames.clear()
        super()._write(live, watermark, old)

    def gather(self, rows) -> dict:
        found = defaultdict(list)
        for own, at, idx, *frame in _values(rows, "challenge_id", "at", "idx", *self.FIELDS):
            found[own].append((at, idx, frame))
        return found

    def _taken(self, key) -> list[tuple]:
        """The frames held for a key, from now on not held."""
        numbers = self.held.pop(key, [])
        return [*zip(*[iter(numbers)] * len(self.FIELDS))]

    def fold(self, key, found, state):
        start, last, done, _ = state or (None, None, False, None)
        frames = self._taken(key)
        for at, _, frame in sorted(found, key=lambda r: r[:2]):
            if start is not None and (at - last >= self.idle or at - start >= self.total):
                if not done:
                    yield self._ended(key, start, frames)
                start = None
            if start is None:
                start, last, frames, done = at, None, [], False
            last = max(last or at, at)
            if not done and not int(frame[0]) & 1:
                frames.append(frame)
                if len(frames) == MAX_FRAMES:
                    yield self._ended(key, start, frames)
                    frames, done = [], True
        if frames:
            self.held[key] = [float(x) for f in frames for x in f]
        return start, last, done, _millis(min(last + self.idle, start + self.total))

    def expire(self, key, state, watermark):
        start, _, done, _ = state
        frames = self._taken(key)
        if not done:
            yield self._ended(key, start, frames)

    def _ended(self, key, start: int, frames: list) -> tuple:
        return key, start, [{"missing": int(f[0]), **dict(zip(SIGNALS, f[1:]))} for f in frames]


class Jobs(_Timed):
    """Life of a job: accepted, claimed, done or error; expired if it stays open for too long; gone when its result's time is over."""

    NAME, STATE, MADE = "job", "status string, opened long, since long", ("job_id", "status", "since")
    RANK = {"accepted": 0, "claimed": 1, "done": 2, "error": 2, "expired": 2}
    EVENTS = ("accepted", "claimed", "done", "error")

    def __init__(self, kind: str, stale: float, ttl: float):
        super().__init__(kind)
        self.stale, self.ttl = round(stale * 1_000_000), round(ttl * 1_000_000)

    def _passed(self, status, opened, since, at):
        """Moves that only time makes, up to a time: to expired, and out of the store."""
        moves = []
        if status in ("accepted", "claimed") and at - opened > self.stale:
            status, since = "expired", opened + self.stale
            moves.append((status, since))
        if status is not None and self.RANK[status] == 2 and at - since >= self.ttl:
            moves.append(("gone", since + self.ttl))
            status = None
        return status, since, moves

    def gather(self, rows) -> dict:
        found = defaultdict(list)
        for own, at, status in _values(rows, "job_id", "at", "status"):
            if status in self.EVENTS:
                found[own].append((at, self.RANK[status], status))
        return found

    def fold(self, key, found, state):
        status, opened, since, _ = state or (None, None, None, None)
        for at, rank, name in sorted(found):
            status, since, moves = self._passed(status, opened, since, at)
            yield from ((key, s, t) for s, t in moves)
            if status is None:
                opened = at
            if status is None or rank > self.RANK[status]:
                status, since = name, at
                yield key, status, since
        return self._kept(status, opened, since)

    def _kept(self, status, opened, since) -> tuple:
        # Stale is what waits for longer than the limit, so its timer is a microsecond later.
        due = since + self.ttl if self.RANK[status] == 2 else opened + self.stale + 1
        return status, opened, since, _millis(due)

    def expire(self, key, state, watermark):
        status, opened, since, _ = state
        status, since, moves = self._passed(status, opened, since, watermark * 1000)
        yield from ((key, s, t) for s, t in moves)
        return None if status is None else self._kept(status, opened, since)
