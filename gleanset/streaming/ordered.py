"""Rules that follow the events of a key in the order of event time.

Events wait in a list in the state until the watermark passes them; only then are
they sorted and handed to the rule. So what a rule says depends on event times
alone, not on files, batches or the order in which events arrive. A key has one
timer at a time: the earliest moment at which something is to be done.

A task holds a time and a number for each waiting event of one key, and the
events themselves by the slice. A rule that looks back no further than a span
gets keys of one stretch of time each (:func:`by_stretch`).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gleanset import fixed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALE_MINUTES = 5
NEVER = 1 << 62
# Events that a rule gets, and that are written to the state, at once.
SLICE = 10_000
# Microseconds of the event time that one key of by_stretch holds.
STRETCH = 6 * 3600 * 1_000_000


class InOrder(StatefulProcessor):
    """Hands the events (``at`` in microseconds, ``what``) of a key to :meth:`follow` once the watermark has passed them.

    ``MEMORY`` is the schema of what the rule remembers of a key, ``OUT`` that of
    its rows. Times of a key's waiting events, those of the allowed lateness, are
    held in one task while they are sorted, some 30 bytes an event.
    """

    MEMORY = ""
    OUT = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, what string")
        self.memory = handle.getValueState("memory", self.MEMORY)
        self.timer = handle.getValueState("timer", "at long")

    def follow(self, key: tuple, memory: tuple | None, events: list[tuple], upto: int, ahead: int) -> tuple[tuple | None, list[dict], int]:
        """The new memory (None: nothing to remember), rows to emit, and when to come again (microseconds, or NEVER).

        Events come in slices: the next one begins at ``ahead`` (NEVER: this is
        the last), and nothing else happens until ``upto``.
        """
        raise NotImplementedError

    def _held(self) -> tuple[np.ndarray, np.ndarray, list]:
        """The waiting events in the order of (at, what): times, places in the list of distinct ``what``, and that list."""
        times, codes, seen = array("q"), array("l"), {}
        for at, what in self.waiting.get() if self.waiting.exists() else ():
            times.append(at)
            codes.append(seen.setdefault(what, len(seen)))
        named = sorted(seen, key=lambda what: (what is not None, what or ""))
        places = np.empty(len(named), np.int64)
        places[[seen[what] for what in named]] = np.arange(len(named))
        at, place = np.frombuffer(times, np.int64), places[np.frombuffer(codes, np.int64)]
        order = np.lexsort((place, at))
        return at[order], place[order], named

    def _wake(self, at: int, watermark: int) -> None:
        """Let the key's only timer be at ``at`` microseconds, behind the watermark (milliseconds)."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at < NEVER:
            due = max(-(-at // 1000), watermark + 1)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = self.timer.get()[0] * 1000 if self.timer.exists() else NEVER
        for chunk in rows:
            micros = (chunk["at"] - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)
            self.waiting.appendList(list(zip(micros.tolist(), chunk["what"].tolist(), strict=True)))
            earliest = min(earliest, int(micros.min()))
        self._wake(earliest, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        at, place, named = self._held()

        def part(low: int, high: int) -> list[tuple]:
            return [(moment, named[p]) for moment, p in zip(at[low:high].tolist(), place[low:high].tolist(), strict=True)]

        ready = int(np.searchsorted(at, watermark * 1000, "right"))
        if ready:
            self.waiting.clear()
            for low in range(ready, len(at), SLICE):
                self.waiting.appendList(part(low, low + SLICE))
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        for low in range(0, max(ready, 1), SLICE):
            high = min(low + SLICE, ready)
            ahead = int(at[high]) if high < ready else NEVER
            memory, rows, due = self.follow(key, memory, part(low, high), min(watermark * 1000, ahead), ahead)
            if rows:
                yield pd.DataFrame(rows)
        if memory is not None:
            self.memory.update(memory)
        elif self.memory.exists():
            self.memory.clear()
        self._wake(min([due, *at[ready:ready + 1].tolist()]), watermark)

    def close(self) -> None:
        pass


def moment(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class Stays(InOrder):
    """Stays in processing of five minutes and more, once each."""

    MEMORY = "since long, fired boolean"
    OUT = "id long, status string, processing_since timestamp"

    def follow(self, key, memory, events, upto, ahead):
        limit = STALE_MINUTES * 60_000_000
        since, fired = memory or (None, False)
        rows = []

        def settle(until: int) -> None:
            nonlocal fired
            if since is not None and not fired and until - since >= limit:
                rows.append({"id": key[0], "status": "failed", "processing_since": moment(since)})
                fired = True

        for at, status in events:
            settle(at)
            if status != "processing":
                since, fired = None, False
            elif since is None:
                since, fired = at, False
        settle(upto)
        due = NEVER if since is None or fired else since + limit
        return None if since is None else (since, fired), rows, due


class Failures(InOrder):
    """Moments at which the trailing ten minutes hold five failures: a ring of the last five failure times.

    A key is a user's stretch of time. Failures before it are there to look back on.
    """

    MEMORY = "ring array<long>"
    OUT = "username string, attempted_at timestamp, fifth_last timestamp"

    def follow(self, key, memory, events, upto, ahead):
        username, start = key
        span = fixed.LOGIN_WINDOW_SECONDS * 1_000_000
        ring, rows = list(memory[0]) if memory else [], []
        for place, (at, _) in enumerate(events):
            ring = [*ring, at][-fixed.LOGIN_FAILURES:]
            last = at != (events[place + 1][0] if place + 1 < len(events) else ahead)
            if last and at >= start and len(ring) == fixed.LOGIN_FAILURES and ring[0] > at - span:
                rows.append({"username": username, "attempted_at": moment(at), "fifth_last": moment(ring[0])})
        if not ring or ring[-1] + span <= upto:
            return None, rows, NEVER
        return (ring,), rows, ring[-1] + span


def by_stretch(events: DataFrame, span: int) -> DataFrame:
    """Events (with ``at``) with the ``stretch`` they are in, its first microsecond, and once more in each that begins less than ``span`` microseconds later."""
    at = F.unix_micros("at")
    until = at + F.lit(span - 1)
    return events.withColumn("stretch", F.explode(F.sequence(*[t - F.pmod(t, F.lit(STRETCH)) for t in (at, until)], F.lit(STRETCH))))


def in_order(events: DataFrame, keys: list[str], rule: InOrder) -> DataFrame:
    """The rule's rows over a stream of (keys, at, what) with a watermark on ``at``."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.select(*keys, "at", "what").groupBy(*keys).transformWithStateInPandas(rule, rule.OUT, "Append", "EventTime")


def open_failures(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What :class:`Failures` would say of the failures that still wait in the state of a stream, as batch rows.

    A failure's fifth last one is the fourth before it, among those waiting and
    the ring of its stretch.
    """
    keys = ["key.username", "key.stretch"]
    state = spark.read.format("statestore")
    held = state.option("stateVarName", "waiting").load(checkpoint).select(*keys, F.col("list_element.at").alias("at"), F.lit(True).alias("open"))
    ring = spark.read.format("statestore").option("stateVarName", "memory").load(checkpoint).select(
        *keys, F.explode("value.ring").alias("at"), F.lit(False).alias("open"))
    order = Window.partitionBy("username", "stretch").orderBy("at")
    span = fixed.LOGIN_WINDOW_SECONDS * 1_000_000
    fifth = F.lag("at", fixed.LOGIN_FAILURES - 1).over(order)
    said = held.union(ring).withColumn("fifth", fifth).filter("open AND at >= stretch").groupBy("username", "at").agg(F.max("fifth").alias("fifth"))
    return said.filter(F.col("fifth") > F.col("at") - span).select(
        "username", F.timestamp_micros("at").alias("attempted_at"), F.timestamp_micros("fifth").alias("fifth_last"))


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions that were open when a stream of sessions ended, from its state."""
    held = spark.read.format("statestore").load(checkpoint).select("value.*")
    return held.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("events"))
