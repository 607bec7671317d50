"""Independent Spark jobs at the same time, from one session, with a time limit."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass
class Outcome:
    """What a piece of work returned; ``late`` if the time limit stopped it or kept it from starting."""

    value: Any = None
    late: bool = False


def run_together(spark: SparkSession, work: Sequence[Callable[[], Any]], parallel: int = 4, timeout: float | None = None, name: str = "together") -> list[Outcome]:
    """Runs ``work`` on up to ``parallel`` threads and returns an outcome for each, in order.

    Threads inherit the caller's job properties; their jobs share a job group of their own and run in the scheduler pool
    ``name`` (which has an effect where the session's scheduler is fair). After ``timeout`` seconds
    the group's jobs are cancelled until all threads have come back, and what was running or waiting is
    late. An error in one piece cancels the rest and is raised.
    """
    sc = spark.sparkContext
    group = f"{name}-{uuid.uuid4().hex}"
    waiting: queue.SimpleQueue = queue.SimpleQueue()
    for k, f in enumerate(work):
        waiting.put((k, f))
    out = [Outcome(late=True) for _ in work]
    over, errors = threading.Event(), []

    def take() -> None:
        sc.setJobGroup(group, name, interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", name)
        while not over.is_set():
            try:
                k, f = waiting.get_nowait()
            except queue.Empty:
                return
            try:
                out[k] = Outcome(f())
            except Exception as e:
                if not over.is_set():  # else it was cancelled
                    errors.append(e)
                    over.set()

    threads = [InheritableThread(target=take, daemon=True) for _ in range(min(parallel, len(work)))]
    began = time.monotonic()
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        if timeout is not None and time.monotonic() - began > timeout:
            over.set()
        if over.is_set():
            sc.cancelJobGroup(group)  # again and again, as a thread may be between two jobs
        next(t for t in [*[t for t in threads if t.is_alive()], threads[0]]).join(0.1)
    if errors:
        raise errors[0]
    return out
