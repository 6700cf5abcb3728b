"""What runs, while it runs: tasks of the active stages, told from time to time."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def told(line: str) -> None:
    print(line, file=sys.stderr, flush=True)


def standing(spark: SparkSession) -> str | None:
    """The active stages and how many of their tasks are done; None if nothing runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for i in sorted(tracker.getActiveStageIds()) if (s := tracker.getStageInfo(i)) is not None]
    return "; ".join(f"{s.name.split(' at ')[0]}: {s.numCompletedTasks} of {s.numTasks} tasks" for s in stages) or None


@contextmanager
def reported(spark: SparkSession, every: float = 10.0, tell: Callable[[str], None] = told) -> Iterator[None]:
    """Tell how far the steps inside are, every so many seconds; what stands as it stood is not told twice."""
    done = threading.Event()

    def watch() -> None:
        last = None
        while not done.wait(every):
            now = standing(spark)
            if now and now != last:
                tell(now)
            last = now

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
