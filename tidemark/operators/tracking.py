"""A run that can be watched, measured and given up: its jobs carry a tag, its passes observe what flows through them, its tables go if it does not end well."""

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tidemark.sources.stored import scratch


class StageProgress(NamedTuple):
    job: int
    stage: int
    name: str
    fraction: float


class Run:
    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self._seen: dict[str, Observation] = {}
        self._marks: list[tuple[str, float]] = [("begin", time.monotonic())]

    def observed(self, df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
        """df, of which the named aggregates are known once it has been written: no job of their own, whatever is counted."""
        self._seen[name] = Observation(f"{self.tag}-{name}")
        return df.observe(self._seen[name], *[c.alias(k) for k, c in aggregates.items()])

    def mark(self, name: str) -> None:
        """The end of a pass."""
        self._marks.append((name, time.monotonic()))

    def metrics(self) -> dict[str, Any]:
        """All observed values, and the seconds of each pass. Waits for passes that have not run."""
        found = {k: v for o in self._seen.values() for k, v in o.get.items()}
        return found | {f"{name}_seconds": at - before for (_, before), (name, at) in zip(self._marks, self._marks[1:])}

    def progress(self) -> list[StageProgress]:
        """The part of its tasks that each stage of the run has done, of the jobs that Spark still remembers. May be called from any thread."""
        tracker, out = self.spark.sparkContext.statusTracker(), []
        for job in sorted(tracker.getJobIdsForGroup(self.tag)):
            info = tracker.getJobInfo(job)
            for stage in sorted(info.stageIds) if info else ():
                s = tracker.getStageInfo(stage)
                if s:
                    out.append(StageProgress(job, stage, s.name, s.numCompletedTasks / s.numTasks if s.numTasks else 1.0))
        return out

    def cancel(self) -> None:
        """Ends the run's jobs: whoever waits for one gets its error. May be called from any thread."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


@contextmanager
def tracked(spark: SparkSession, name: str = "run") -> Iterator[Run]:
    """A run of everything inside, in this thread. Its temporary tables are deleted on leaving, whether it ended well, failed or was cancelled: write what is to stay inside."""
    run, context = Run(spark, f"{name}-{uuid.uuid4().hex}"), spark.sparkContext
    context.addJobTag(run.tag)
    context.setJobGroup(run.tag, name)
    try:
        with scratch(spark):
            yield run
    finally:
        context.removeJobTag(run.tag)
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def summary(run: Run) -> dict[str, Any]:
    """What a detector's run (detect.events with `run`) amounts to, from its metrics."""
    m = run.metrics()
    scan, refine = m.get("scan_seconds", 0.0), m.get("refine_seconds", 0.0)
    samples, duration = m.get("samples", 0) or 0, m.get("duration_s") or 0.0
    return {
        "recordings": m.get("recordings", 0), "duration_s": duration, "samples_analysed": samples, "disturbed_share": (m.get("disturbed") or 0) / samples if samples else 0.0,
        "candidate_windows": m.get("windows", 0), "frames_refined": m.get("dense", 0), "refined_events": m.get("events", 0), "scan_seconds": scan, "refine_seconds": refine, "processing_seconds": scan + refine,
        "scan_speed_x_realtime": duration / scan if scan and duration else None,
    }
