"""Progress of running stages, as Spark's status tracker tells it."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two looks.
PAUSE = 0.2


@contextmanager
def progress(spark: SparkSession, report: Callable[[str, int, int], None]) -> Iterator[None]:
    """Calls report(phase, done, total) while the block runs: a phase is a stage, done and total are its tasks. It is called
    when a count changes, from a thread of its own. Stages that end between two looks aren't reported."""
    tracker, over = spark.sparkContext.statusTracker(), threading.Event()

    def watch() -> None:
        told: dict[int, int] = {}
        while not over.wait(PAUSE):
            for stage in tracker.getActiveStageIds():
                info = tracker.getStageInfo(stage)
                if info is not None and told.get(stage) != info.numCompletedTasks:
                    told[stage] = info.numCompletedTasks
                    report(f"stage {stage}", info.numCompletedTasks, info.numTasks)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
