"""Streaming forms of the telemetry operators."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stackweave.operators import scans
from stackweave.operators.telemetry import HISTORY_SECONDS


def stream_event_totals(rows: DataFrame, observed: str = "observed", length: str = "1 second",
                        delay: str = "10 seconds") -> DataFrame:
    """Events and events per second of each window, once the watermark has passed it.

    A silent second has no window, which reads as rate 0.
    """
    return (rows.withWatermark(observed, delay).groupBy(F.window(observed, length).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("start"), "events",
                    (F.col("events") / (F.unix_micros("w.end") - F.unix_micros("w.start")) * 1e6).alias("rate")))


class SlidingWindow:
    """Count, sum and maximum of the values of the last `span`, as two stacks: an old one with the aggregate of each entry and
    all below it, a new one with its total. A value is pushed and popped once, and nothing is ever subtracted."""

    def __init__(self, span: int, old: list = (), new: list = ()) -> None:
        self.span = span
        self.old = [tuple(x) for x in old]  # (time, count, sum, max), the oldest last
        self.new = [tuple(x) for x in new]  # (time, value)
        self.total = (0, 0.0, None)
        for _, value in self.new:
            self.total = self._join(self.total, value)

    @staticmethod
    def _join(have: tuple, value: float | None) -> tuple:
        if value is None:
            return have
        count, total, top = have
        return count + 1, total + value, value if top is None else max(top, value)

    def push(self, time: int, value: float | None) -> None:
        self.new.append((time, value))
        self.total = self._join(self.total, value)

    def evict(self, now: int) -> None:
        """Forget what is older than `span` before `now`."""
        while self.old or self.new:
            if not self.old:
                have = (0, 0.0, None)
                for time, value in reversed(self.new):
                    have = self._join(have, value)
                    self.old.append((time, *have))
                self.new, self.total = [], (0, 0.0, None)
            if self.old[-1][0] >= now - self.span:
                return
            self.old.pop()

    def read(self) -> tuple[int, float | None, float | None]:
        """Points, mean and peak."""
        count, total, top = self.old[-1][1:] if self.old else (0, 0.0, None)
        more, rest, high = self.total
        tops = [x for x in (top, high) if x is not None]
        points = count + more
        return points, (total + rest) / points if points else None, max(tops) if tops else None


_ENTRY = "array<struct<time:bigint,points:bigint,total:double,peak:double>>"
_VALUE = "array<struct<time:bigint,value:double>>"
_WAITING = "array<struct<time:bigint,value:double,own:boolean>>"


def _number(value) -> float | None:
    return None if pd.isna(value) else float(value)


def _slide(span: int, names: list[str]):
    def slide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Hold rows until the watermark has passed them, then run them through the window in order of time."""
        name, minute = key[0], int(key[1])
        old, new, waiting = state.get if state.exists else ([], [], [])
        window = SlidingWindow(span, [tuple(x) for x in old], [tuple(x) for x in new])
        waiting = [(int(t), _number(v), bool(o)) for t, v, o in map(tuple, waiting)]
        if not state.hasTimedOut:
            for batch in batches:
                waiting += [(int(t), _number(v), bool(o)) for t, v, o in batch[["time", "value", "own"]].itertuples(index=False)]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda x: x[0])
        ready = bisect_right(waiting, passed, key=lambda x: x[0])
        out = []
        for time, rows in groupby(waiting[:ready], key=lambda x: x[0]):
            rows = list(rows)  # rows of one instant see each other
            for _, value, _ in rows:
                window.push(time, value)
            window.evict(time)
            found = window.read()
            out += [(name, time, value, *found) for _, value, own in rows if own]
        waiting = waiting[ready:]
        end = (minute + 1) * span
        if not waiting and passed >= end:
            if state.exists:
                state.remove()
        else:
            state.update((window.old, window.new, waiting))
            due = min(waiting[0][0], end) if waiting else end
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=names)
            frame[names[1]] = pd.to_datetime(frame[names[1]], unit="us", utc=True)
            yield frame

    return slide


def stream_rate_history(rows: DataFrame, key: str, rate: str, observed: str = "observed", delay: str = "10 seconds",
                        seconds: int = HISTORY_SECONDS) -> DataFrame:
    """Points, mean and peak of a key's rate over the last minute up to each observation, once the watermark has passed it.

    Rows go to their own and the next minute of their key, so a busy key is spread over its minutes, whose state ends with
    them. Null rates are no points; rows of one instant count for each other. Rows behind the watermark are late, and
    left out as in every windowed stream. Null keys or times have no history.
    """
    span = seconds * 1_000_000
    time = F.unix_micros(observed)
    minute = scans.whole(time, span)
    copies = (rows.withWatermark(observed, delay).filter(F.col(observed).isNotNull() & F.col(key).isNotNull())
              .select(F.col(key).cast("string").alias("name"), observed, time.alias("time"), F.col(rate).cast("double").alias("value"),
                      F.explode(F.array(F.struct(minute.alias("minute"), F.lit(True).alias("own")),
                                        F.struct((minute + 1).alias("minute"), F.lit(False).alias("own")))).alias("part"))
              .select("name", observed, "time", "value", "part.*"))
    names = [key, observed, rate, "points", "meanRate", "peakRate"]
    return copies.groupBy("name", "minute").applyInPandasWithState(
        _slide(span, names), f"`{key}` string, `{observed}` timestamp, `{rate}` double, points long, meanRate double, peakRate double",
        f"old {_ENTRY}, new {_VALUE}, waiting {_WAITING}", "append", GroupStateTimeout.EventTimeTimeout)


def _follow(expire_ms: int):
    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Keep a file's last counters; closed files go `expire_ms` after they closed."""
        file = key[0]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(file, "EXPIRED", 0, 0, 0, pd.NaT)],
                               columns=["file", "status", "buffered", "flushed", "rate", "observed"])
            return
        last = state.get if state.exists else None  # observed, rate, flushed
        out = []
        # Rows of a batch come in any order: time, then counters and status order them wholly.
        rows = pd.concat(list(batches)).sort_values(["observed", "flushed", "buffered", "status"])
        for observed, status, buffered, flushed in rows[["observed", "status", "buffered", "flushed"]].itertuples(index=False):
            rate = last[1] if last else 0
            if last:
                seconds = (observed - pd.Timestamp(last[0])).total_seconds()
                if seconds > 0:
                    rate = round(max(0, flushed - last[2]) / seconds)
            if status == "CLOSED":
                rate = 0
            if last is None or seconds >= 0:  # a row older than the batches before leaves the counters as they are
                last = (observed, rate, flushed)
            out.append((file, status, buffered, flushed, rate, observed))
        state.update(last)
        if out and out[-1][1] == "CLOSED":
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame(out, columns=["file", "status", "buffered", "flushed", "rate", "observed"])

    return follow


def file_status_stream(files: DataFrame, expire_seconds: int = 10) -> DataFrame:
    """Status, counters and rate per file as they change; an `EXPIRED` row ends a closed file."""
    return files.groupBy("file").applyInPandasWithState(
        _follow(expire_seconds * 1000),
        "file string, status string, buffered long, flushed long, rate long, observed timestamp",
        "observed timestamp, rate long, flushed long", "append", GroupStateTimeout.ProcessingTimeTimeout)
