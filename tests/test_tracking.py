"""Runs that are measured, watched and cancelled."""

import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, tracking
from tidemark.plans import catalog
from tidemark.sources.stored import shared_dir, stored
from tidemark.sources.tables import event_frames

SF = "/root/testdata/sf0.001"


def folders(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}


def test_metrics_are_the_counts(spark):
    before = folders(spark)
    with tracking.tracked(spark, "scan") as run:
        frames = event_frames(spark, SF)
        files = catalog.recordings(frames)
        found = detect.events(frames, files, "motion_scan", {"shortest_event_s": 6}, run=run)
        n_events = found.count()
        got = tracking.summary(run)
        assert all(0 <= s.fraction <= 1 for s in run.progress()) and any(s.fraction == 1 for s in run.progress())
        n, seconds = files.agg(F.count("*"), F.sum("n")).first()
        assert (got["recordings"], got["duration_s"], got["refined_events"]) == (n, seconds, n_events)
        # Every second frame is sampled, from the first on: an interval of two seconds at one frame a second.
        assert got["samples_analysed"] == files.agg(F.sum(F.ceil(F.col("n") / 2))).first()[0]
        assert 0 < got["candidate_windows"] <= got["frames_refined"] <= seconds and got["disturbed_share"] == 0
        assert got["scan_seconds"] > 0 and got["scan_speed_x_realtime"] == pytest.approx(seconds / got["scan_seconds"])
    assert folders(spark) == before


def test_cancelled_runs_leave_nothing(spark):
    before, began = folders(spark), time.time()
    seen = []

    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    with pytest.raises(Exception):
        with tracking.tracked(spark, "slow") as run:
            stored(spark.range(10), "first")

            def stop():
                while not any(s.fraction < 1 for s in run.progress()) and time.time() - began < 30:
                    time.sleep(0.2)
                seen.extend(run.progress())
                run.cancel()

            threading.Thread(target=stop).start()
            stored(spark.range(4).mapInArrow(slow, "id long"), "second")
    assert time.time() - began < 50 and folders(spark) == before
    assert any(s.fraction < 1 for s in seen)
    assert spark.range(3).count() == 3  # others are not touched
