"""Jobs on a session: priorities as scheduler pools, cancelling by tag, progress, and client-side paging state."""

from __future__ import annotations

import itertools
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Pools of a fair scheduler by priority.
POOLS = {"high": "high", "normal": "normal", "low": "low"}


@dataclass
class Job:
    tag: str
    future: Future
    cancelled: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """Runs functions of a session in threads, each under a pool and a tag of its own."""

    def __init__(self, spark: SparkSession, threads: int = 4):
        self.spark, self._pool, self._n = spark, ThreadPoolExecutor(threads), itertools.count()

    def submit(self, work: Callable[[SparkSession, threading.Event], object], *, priority: str = "normal") -> Job:
        """``work`` gets the session and an event that is set when it should stop."""
        tag, stop = f"job-{next(self._n)}-{id(self):x}", threading.Event()

        def run() -> object:
            sc = self.spark.sparkContext
            sc.setLocalProperty("spark.scheduler.pool", POOLS[priority])
            sc.addJobTag(tag)
            try:
                return None if stop.is_set() else work(self.spark, stop)
            finally:
                sc.removeJobTag(tag)
                sc.setLocalProperty("spark.scheduler.pool", None)

        return Job(tag, self._pool.submit(run), stop)

    def cancel(self, job: Job) -> None:
        """Stops a job: at once where it waits in Spark, at its next look at the event elsewhere."""
        job.cancelled.set()
        job.future.cancel()
        self.spark.sparkContext.cancelJobsWithTag(job.tag)

    def close(self) -> None:
        self._pool.shutdown(wait=True)


class Progress:
    """Hands on (phase, done, total) no more often than every ``every`` seconds, and always the last of a phase."""

    def __init__(self, tell: Callable[[str, int, int], None], every: float = 0.1, clock: Callable[[], float] = time.monotonic):
        self.tell, self.every, self.clock, self.last = tell, every, clock, float("-inf")

    def __call__(self, phase: str, done: int, total: int) -> None:
        now = self.clock()
        if done >= total or now - self.last >= self.every:
            self.last = now
            self.tell(phase, done, total)


@dataclass
class PagingState:
    """A client's view of a paged search: results of a superseded search are ignored."""

    page: int = 200
    generation: int = 0
    shown: int = 0
    more: bool = False

    def start(self) -> int:
        self.generation, self.shown, self.more = self.generation + 1, 0, False
        return self.generation

    def arrived(self, generation: int, rows: int) -> bool:
        """Whether the page belongs to the current search; another may follow only a full one."""
        if generation != self.generation:
            return False
        self.shown += rows
        self.more = rows >= self.page > 0
        return True

    def removed(self, selected: Sequence[int]) -> list[int]:
        """Valid rows of a selection, each once, in order; what is shown shrinks by them."""
        rows = sorted({r for r in selected if 0 <= r < self.shown})
        self.shown -= len(rows)
        return rows


def totals(parts: Sequence[dict[str, int]]) -> dict[str, int]:
    """Sums of the counters of several refreshed roots."""
    out: dict[str, int] = {}
    for p in parts:
        for k, v in p.items():
            out[k] = out.get(k, 0) + v
    return out
