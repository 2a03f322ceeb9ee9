"""How far the jobs of a load are, polled from Spark's public status tracker."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    """Bytes of the source that were read, of how many, and tasks that ended, of those known so far."""

    read_bytes: int
    total_bytes: int
    tasks_done: int
    tasks_known: int

    def line(self) -> str:
        share = 100 * self.read_bytes / self.total_bytes if self.total_bytes else 100.0
        return f"read {self.read_bytes / 1e6:.1f} of {self.total_bytes / 1e6:.1f} MB ({share:.0f} %), {self.tasks_done} of {self.tasks_known} tasks"


def measured(spark: SparkSession, group: str, total_bytes: int) -> Progress:
    """The state of all jobs of a group; what is read is the share of ended tasks of the first stage, which scans."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [job for i in sorted(tracker.getJobIdsForGroup(group)) if (job := tracker.getJobInfo(i))]
    stages = {s: info for job in jobs for s in job.stageIds if (info := tracker.getStageInfo(s))}
    done, known = sum(s.numCompletedTasks for s in stages.values()), sum(s.numTasks for s in stages.values())
    scan = stages[min(stages)] if stages else None
    share = scan.numCompletedTasks / scan.numTasks if scan and scan.numTasks else 0.0
    return Progress(int(total_bytes * share), total_bytes, done, known)


@contextmanager
def watched(spark: SparkSession, report: Callable[[Progress], None] | None, total_bytes: int = 0, every: float = 0.5):
    """Report while the jobs started inside run, and once when they have succeeded.

    Reports never go back.  A failing report does not disturb the jobs.
    """
    if report is None:
        yield
        return
    context, group = spark.sparkContext, f"load-{uuid.uuid4().hex}"
    before = [context.getLocalProperty(n) for n in ("spark.jobGroup.id", "spark.job.description")]
    context.setJobGroup(group, "load")
    over, last = threading.Event(), [Progress(0, total_bytes, 0, 0)]

    def tell(now: Progress) -> None:
        old = last[0]
        last[0] = Progress(max(old.read_bytes, now.read_bytes), total_bytes, max(old.tasks_done, now.tasks_done), max(old.tasks_known, now.tasks_known))
        try:
            report(last[0])
        except Exception:  # noqa: BLE001  the load goes on without its reports
            over.set()

    def poll() -> None:
        while not over.wait(every):
            tell(measured(spark, group, total_bytes))

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    except BaseException:
        over.set()
        thread.join()
        raise
    else:
        over.set()
        thread.join()
        now = measured(spark, group, total_bytes)
        tell(Progress(total_bytes, total_bytes, now.tasks_done, now.tasks_known))
    finally:
        for name, value in zip(("spark.jobGroup.id", "spark.job.description"), before, strict=True):
            context.setLocalProperty(name, value)
