"""Keyed state of the streams: what a key has shown so far, and what of it changed.

The processors run in Python workers beside a RocksDB store; they see the rows of one key (or
of one part of the keys) at a time, keep one value for it, and import nothing of the session.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Where keyed state is kept; the default store of Spark has no timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BestOnce(StatefulProcessor):
    """Tells each id's best row once: ``hold`` milliseconds after its last one.

    Ids come in parts, the stream's keys: a part's ids are one value of the state, read and written
    once for each batch that has rows of it, and one timer is set for the first of them that is due.
    So the state is asked a few times for a part, not for an id. ``best`` gives what the largest of
    is the best. An id that has been told is remembered for another ``hold``, so that a straggler
    makes no second row; rows with a null in their id are left out (they only move the clock), so
    are rows older than the watermark. A row without a time counts as of now.
    """

    def __init__(self, columns: StructType, ids: tuple[str, ...], time: str, best: tuple[str, ...], hold: int) -> None:
        self.columns, self.hold = columns, hold
        at = {n: k for k, n in enumerate(columns.names)}
        self.ids, self.best, self.time = [at[c] for c in ids], [at[c] for c in best], at[time]

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.part = handle.getValueState("part", StructType([StructField("ids", BinaryType()), StructField("timer", LongType())]))

    def _load(self) -> tuple[dict, int | None]:
        """(id: (best row, time of the last row, whether it is told), time of the timer that is set)."""
        part = self.part.get()
        return ({}, None) if part is None else (pickle.loads(part[0]), part[1])

    def _due(self, last: int, told: bool) -> int:
        return last + (2 if told else 1) * self.hold

    def _save(self, seen: dict, timer: int | None) -> None:
        if not seen:
            self.part.clear()
            return
        first = min(self._due(last, told) for _, last, told in seen.values())
        if timer is None or first < timer:
            timer = first
            self.handle.registerTimer(timer)
        self.part.update((pickle.dumps(seen, pickle.HIGHEST_PROTOCOL), timer))

    def _rank(self, row: tuple) -> tuple:
        return tuple(row[c] for c in self.best)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        seen, timer = self._load()
        for r in rows:
            own = tuple(r[c] for c in self.ids)
            if None in own:
                continue
            kept, last, told = seen.get(own, (None, -1, False))
            if told:
                if now < self._due(last, told):
                    continue
                kept, last = None, -1  # its timer is due, but rows come first
            time = r[self.time]
            if time is not None and time < now:
                continue
            row = tuple(r)[: len(self.columns)]  # behind the columns comes the part
            if kept is None or self._rank(row) > self._rank(kept):
                kept = row
            seen[own] = (kept, max(last, now if time is None else time), False)
        self._save(seen, timer)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        seen, _ = self._load()
        make, left = Row(*self.columns.names), {}
        for own, (kept, last, told) in seen.items():
            if not told and self._due(last, told) <= now:
                told = True
                yield make(*kept)
            if self._due(last, told) > now:
                left[own] = (kept, last, told)
        self._save(left, None)

    def close(self) -> None:
        pass


class Differences(StatefulProcessor):
    """Keeps totals of each key and tells, whenever they change, the old ones (sign -1) and the new ones (sign 1).

    Of the row with the largest ``order`` the columns ``last`` are kept; ``sums`` are added up.
    """

    def __init__(self, state: StructType, out: StructType, order: tuple[str, ...], last: tuple[str, ...], sums: tuple[str, ...]) -> None:
        self.state, self.out, self.order, self.last, self.sums = state, out, order, last, sums

    def init(self, handle: Any) -> None:
        self.totals = handle.getValueState("totals", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        names = self.state.names
        kept = self.totals.get()
        before = None if kept is None else dict(zip(names, kept, strict=True))
        after = dict(before) if before else None
        for r in rows:
            if after is None:
                after = {n: r[n] for n in names}
                continue
            newer = tuple(r[c] for c in self.order) > tuple(after[c] for c in self.order)
            for n in self.sums:
                after[n] += r[n]
            if newer:
                after.update({n: r[n] for n in (*self.order, *self.last)})
        if after is None or after == before:
            return
        self.totals.update(tuple(after[n] for n in names))
        make = Row(*self.out.names)
        for sign, totals in ((-1, before), (1, after)):
            if totals is not None:
                given = dict(zip(("key_hash",), key, strict=True)) | totals | {"sign": sign}
                yield make(*[given[n] for n in self.out.names])

    def close(self) -> None:
        pass
