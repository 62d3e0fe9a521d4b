"""What queries took: a ring of slow ones, and counts of latencies by bucket."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds in milliseconds; the last of eleven buckets is open.
BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000)


@dataclass
class QueryLog:
    """The latest ``most`` queries that took ``slow_ms`` or more, and a histogram a kind of query."""

    slow_ms: float = 100.0
    most: int = 128
    slow: deque = field(default_factory=deque)
    counts: dict[str, list[int]] = field(default_factory=dict)
    sums: dict[str, float] = field(default_factory=dict)

    def record(self, kind: str, ms: float, text: str = "") -> None:
        row = self.counts.setdefault(kind, [0] * (len(BOUNDS) + 1))
        row[bisect_left(BOUNDS, ms)] += 1
        self.sums[kind] = self.sums.get(kind, 0.0) + ms
        if ms >= self.slow_ms:
            self.slow.append({"kind": kind, "ms": ms, "text": text})
            while len(self.slow) > self.most:
                self.slow.popleft()

    def timed(self, kind: str, run: Callable[[], object], text: str = "") -> object:
        """Run and record; what fails is recorded too."""
        began = time.perf_counter()
        try:
            return run()
        finally:
            self.record(kind, (time.perf_counter() - began) * 1000, text)

    def histogram(self, kind: str) -> list[tuple[float | None, int]]:
        """(upper bound, queries up to it) in order, summed up; the last bound is None."""
        out, total = [], 0
        for bound, n in zip([*BOUNDS, None], self.counts.get(kind, [0] * (len(BOUNDS) + 1))):
            total += n
            out.append((bound, total))
        return out


def bucket(ms: Column) -> Column:
    """The number of a latency's bucket, 0 to 10."""
    out = F.lit(len(BOUNDS))
    for i in range(len(BOUNDS) - 1, -1, -1):
        out = F.when(ms <= BOUNDS[i], i).otherwise(out)
    return out


def histogram(latencies: DataFrame, ms: str, by: list[str]) -> DataFrame:
    """(by, bucket, n) of a table of latencies."""
    return latencies.groupBy(*by, bucket(F.col(ms)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
