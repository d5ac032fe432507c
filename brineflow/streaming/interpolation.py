"""Levels at fixed anchors from a stream of samples that come in any order within the watermark.

Each series is cut in buckets of time, and a bucket also gets the samples of the gap
limit before it, so that each bucket finds its brackets alone. Its state holds the
samples that the watermark has not passed, packed by the hour, and of those it has
passed the last one only: the open bracket. A timer at the first sample that waits
goes off when the watermark passes it; what waits up to there is then taken in order,
and each sample closes the anchors since the one before it. A bracket wider than the
gap limit gives no anchors. Once the watermark has passed a bucket, its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brineflow import config as C


def closed(before: tuple[int, float] | None, t: int, v: float, step_s: int, max_gap_s: int) -> list[tuple[int, float]]:
    """Anchors after ``before`` up to ``t`` and their levels."""
    if before is None or t - before[0] > max_gap_s:
        return [(t, v)] if t % step_s == 0 else []
    t0, v0 = before
    first = (t0 // step_s + 1) * step_s
    return [(a, v if a == t else v0 + (v - v0) * ((a - t0) / (t - t0))) for a in range(first, t + 1, step_s)]


def _frame(series: str | None, out: list[tuple[int, float]]) -> pd.DataFrame:
    return pd.DataFrame({"series": pd.Series([series] * len(out), dtype=object), "t": pd.Series([t for t, _ in out], dtype="int64"), "v": pd.Series([v for _, v in out], dtype="float64")})


#: Seconds of a bucket, and of the samples that are packed together in its state.
BUCKET_S = 2 * 86400
HOUR_S = 3600


class Brackets(StatefulProcessor):
    """``bucket_s``: the key's second part numbers the bucket, and earlier samples only open brackets."""

    def __init__(self, step_s: int, max_gap_s: int, bucket_s: int | None = None):
        self.step_s, self.max_gap_s, self.bucket_s = step_s, max_gap_s, bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # By the second at which the hour ends.
        self.waiting = handle.getMapState("waiting", "until bigint", "samples binary")
        self.last = handle.getValueState("last", "t bigint, v double")

    def _held(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {until: (np.frombuffer(b, "<i8", len(b) // 16), np.frombuffer(b, "<f8", len(b) // 16, len(b) // 2)) for (until,), (b,) in self.waiting.iterator()}

    def _hold(self, until: int, t: np.ndarray, v: np.ndarray) -> None:
        self.waiting.updateValue((until,), (t.astype("<i8").tobytes() + v.astype("<f8").tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = self.last.get()[0] if self.last.exists() else None
        parts = [(part["t"].to_numpy(np.int64), part["v"].to_numpy(np.float64)) for part in rows]
        t, v = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0))
        if passed is not None:
            t, v = t[t > passed], v[t > passed]
        held = self._held()
        end = (t // HOUR_S + 1) * HOUR_S
        order = np.argsort(end, kind="stable")
        t, v, end = t[order], v[order], end[order]
        for group in np.split(np.arange(len(t)), np.flatnonzero(np.diff(end)) + 1) if len(t) else []:
            until = int(end[group[0]])
            before = held.get(until, (np.empty(0, np.int64), np.empty(0)))
            now_t, now_v = np.concatenate([before[0], t[group]]), np.concatenate([before[1], v[group]])
            # Of one second the one that came last.
            at, place = np.unique(now_t[::-1], return_index=True)
            held[until] = at, now_v[::-1][place]
            self._hold(until, *held[until])
        self._await(key, held)
        yield _frame(None, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        last, out = tuple(self.last.get()) if self.last.exists() else None, []
        first = key[1] * self.bucket_s if self.bucket_s else None
        held, taken = self._held(), False
        for until in sorted(held):
            t, v = held[until]
            n = int(np.searchsorted(t, mark // 1000, "right"))
            for at, level in zip(t[:n].tolist(), v[:n].tolist(), strict=True):
                if first is None or at >= first:
                    out += closed(last, at, level, self.step_s, self.max_gap_s)
                last = (at, level)
            taken |= n > 0
            if n == len(t):
                self.waiting.removeKey((until,))
                del held[until]
            elif n:
                held[until] = t[n:], v[n:]
                self._hold(until, *held[until])
            if n < len(t):
                break
        if self.bucket_s and not held and (key[1] + 1) * self.bucket_s * 1000 <= mark:
            # What could still come for the bucket is late.
            self.last.clear()
        elif taken:
            self.last.update(last)
        self._await(key, held, mark)
        yield _frame(key[0], out)

    def _await(self, key, held: dict, mark: int | None = None) -> None:
        """One timer, at the first sample that waits, or at the bucket's end."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.handle.registerTimer(int(held[min(held)][0][0]) * 1000)
        elif self.bucket_s and (mark is None or (key[1] + 1) * self.bucket_s * 1000 > mark):
            self.handle.registerTimer((key[1] + 1) * self.bucket_s * 1000)

    def close(self) -> None:
        pass


def anchors(stream: DataFrame, step_s: int = 900, late: str = "3 days", max_gap_s: int = C.MAX_GAP_S) -> DataFrame:
    """``series, t, v`` at each anchor, once the watermark has passed the sample after it; null levels are left out.

    ``stream`` has ``series, ts, v``. Of samples of one second the one that comes last counts, as long as it waits. The
    session needs the RocksDB state store.
    """
    t = F.unix_seconds("ts")
    # A sample opens brackets of the bucket that the gap limit reaches into.
    buckets = F.sequence(F.floor(t / BUCKET_S), F.floor((t + max_gap_s) / BUCKET_S))
    rows = stream.where("v is not null").withWatermark("ts", late).select("series", F.explode(buckets).alias("bucket"), t.alias("t"), "v", "ts")
    return rows.groupBy("series", "bucket").transformWithStateInPandas(Brackets(step_s, max_gap_s, BUCKET_S), "series string, t bigint, v double", "append", "eventTime")
