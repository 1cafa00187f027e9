"""Window counts in logarithmic space: an exponential histogram per bin, fed in order of messages.

Buckets are (time of the newest one, size); of each size two at most, a third merges the two oldest of it. What has left the window is dropped lazily,
by time, so no clock need tick in quiet bins. A count over the last k messages adds buckets whose newest one is in range in full, and half of the first
that isn't: never too few, and at most one merged bucket too many.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Burst


class Histogram:
    """Counts ones among the last `window` times."""

    def __init__(self, window: int):
        if window <= 0:
            raise ValueError("the window must be positive")
        self.window = window
        self.buckets: list[list[int]] = []  # newest first

    def _expire(self, now: int) -> None:
        while self.buckets and self.buckets[-1][0] <= now - self.window:
            self.buckets.pop()

    def add(self, now: int) -> None:
        self._expire(now)
        self.buckets.insert(0, [now, 1])
        at = 0
        while at + 2 < len(self.buckets) and self.buckets[at][1] == self.buckets[at + 2][1]:
            older, oldest = self.buckets[at + 1], self.buckets.pop(at + 2)
            older[1] += oldest[1]
            at += 1

    def count(self, now: int, last: int | None = None) -> int:
        self._expire(now)
        last = self.window if last is None else last
        total = 0
        if last <= 0:
            return 0
        for time, size in self.buckets:
            if time <= now - last:
                return total + size // 2
            total += size
        return total


def bursts(events: DataFrame, times: Sequence[int], config: Burst, segment: int = 1 << 16) -> DataFrame:
    """events: seq, bin, n. times: rising (a range will do). Returns t, bin, recent_count, prev_count, ratio of the bins that burst by histogram counts.

    A bin is cut into segments of sequence numbers. Each begins with the window's length of messages before it, since what left the window doesn't count,
    so a segment's histogram keeps the same bounds, and no bin is a single task's work. A bin without events in the window isn't looked at."""

    def judged(bin_: int, h: Histogram, t: int) -> list[tuple]:
        recent = h.count(t, config.half)
        prev = max(0, h.count(t, 2 * config.half) - recent)
        ratio = (recent + config.epsilon) / (prev + config.epsilon)
        return [(t, bin_, recent, prev, ratio)] if recent >= config.min_count and ratio >= config.threshold else []

    class Lane:
        """The histogram of one bin in one segment, and the times that it is asked at."""

        def __init__(self, bin_: int, part: int):
            self.bin, self.part, self.h = bin_, part, Histogram(config.window)
            self.k, self.end = bisect_left(times, part * segment), bisect_left(times, (part + 1) * segment)

        def ask(self, before: int) -> list[tuple]:
            out = []
            while self.k < self.end and times[self.k] < before:
                if not self.h.buckets:  # nothing until the next event
                    self.k = bisect_left(times, before, self.k, self.end)
                    break
                out += judged(self.bin, self.h, times[self.k])
                self.k += 1
            return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, names = None, ["t", "bin", "recent_count", "prev_count", "ratio"]
        for frame in frames:
            out = []
            for seq, bin_, n, part in frame.itertuples(index=False):
                if lane is None or (bin_, part) != (lane.bin, lane.part):
                    out += lane.ask((lane.part + 1) * segment) if lane else []
                    lane = Lane(bin_, part)
                out += lane.ask(seq)
                for _ in range(n):
                    lane.h.add(seq)
            if out:
                yield pd.DataFrame(out, columns=names)
        out = lane.ask((lane.part + 1) * segment) if lane else []
        if out:
            yield pd.DataFrame(out, columns=names)

    segment = max(segment, config.window)
    part = F.floor(F.col("seq") / segment)
    late = F.pmod("seq", F.lit(segment)) >= segment - config.window
    rows = events.select("seq", "bin", "n", F.explode(F.when(late, F.array(part, part + 1)).otherwise(F.array(part))).alias("part"))
    return rows.repartition("bin", "part").sortWithinPartitions("bin", "part", "seq").mapInPandas(run, "t long, bin int, recent_count long, prev_count long, ratio double")
