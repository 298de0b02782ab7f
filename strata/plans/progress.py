"""Progress and abort of what runs in a session, and smoothed throughput."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from strata.errors import Aborted


@dataclass(frozen=True)
class Progress:
    """Stages and tasks of the jobs begun so far."""

    stages: int
    tasks: int
    done: int
    failed: int


def smoothed(speed: float, new: float) -> float:
    """Throughput as a moving mean that forgets by 1/64 a step."""
    return speed * 63 / 64 + new / 64


@contextmanager
def watched(spark: SparkSession, report: Callable[[Progress], bool], every: float = 0.5):
    """Run the block's jobs as a group, calling report(progress) from time to time; where it returns False, they are cancelled and Aborted is raised.

    What was being written is removed by the writers themselves.
    """
    sc, group, stop, aborted = spark.sparkContext, uuid.uuid4().hex, threading.Event(), threading.Event()

    def look():
        tracker = sc.statusTracker()
        while not stop.wait(every):
            if aborted.is_set():  # jobs may have begun since
                sc.cancelJobGroup(group)
                continue
            infos = [i for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ()) if (i := tracker.getStageInfo(s))]
            if not report(Progress(len(infos), sum(i.numTasks for i in infos), sum(i.numCompletedTasks for i in infos), sum(i.numFailedTasks for i in infos))):
                aborted.set()
                sc.cancelJobGroup(group)

    sc.setJobGroup(group, "strata", interruptOnCancel=True)
    t = threading.Thread(target=look, daemon=True)
    t.start()
    try:
        yield
    except Exception:
        if aborted.is_set():
            raise Aborted("aborted") from None
        raise
    finally:
        stop.set()
        t.join()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)
