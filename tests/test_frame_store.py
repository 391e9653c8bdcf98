"""Stored frames, scans over frames that cannot be read, scoring in stretches, timed flows by horizons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, pixels, prepare
from tidemark.operators.settings import FlowSettings, LiquidSettings, MotionSettings, ScanSettings, TimingSettings, overridden
from tidemark.sources.frame_store import written

SCHEMA = "stream_id long, frame_index long, height int, width int, pixels array<float>"


def films(spark, streams, draw, n=60):
    """streams: number -> (height, width); draw(stream, frame, height, width) -> levels, or None for one that cannot be read."""
    rows = []
    for s, (h, w) in streams.items():
        for i in range(n):
            got = draw(s, i, h, w)
            rows.append((s, i, h, w, None if got is None else np.asarray(got, float).ravel().tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def files_of(spark, streams, n=60, fps=1.0):
    return spark.createDataFrame([(s, fps, n, w, h) for s, (h, w) in streams.items()], "stream_id long, fps double, n long, width int, height int")


def noise(s, i, h, w):
    return 120 + np.random.default_rng(s * 1000 + i).integers(0, 5, (h, w)).astype(float)


def block(s, i, h, w, shown=range(20, 30)):
    frame = noise(s, i, h, w)
    if i in shown:
        frame[h // 4 : h // 2, w // 4 : w // 2] += 90
    return frame


def test_windows_read_only_the_stretches_they_touch(spark):
    streams = {s: (4, 6) for s in range(6)}
    store = written(films(spark, streams, noise, 100), span=10, stream_parts=3)
    wins = spark.createDataFrame([(1, 1, 12, 25), (1, 2, 24, 31), (4, 1, 95, 200), (5, 1, 50, 40)], "stream_id long, window_id int, w_first long, w_last long")
    found = store.near(wins)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.stream_id, r.window_id, r.frame_index) for r in found.collect()) == sorted((s, k, i) for s, k, a, b in [tuple(r) for r in wins.collect()] for i in range(100) if a <= i <= b)
    # Rows that leave the scan: those of touched stretches alone (streams of one part lie together).
    assert 0 < rows_scanned(found) <= 4 * 10 * len(streams) < 600
    assert store.until(25).agg(F.max("t_part")).first()[0] == 2


def rows_scanned(df):
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif name.startswith("Scan parquet"):
            rows += plan.metrics().apply("numOutputRows").value() if "pixels" in plan.schema().simpleString() else 0
        elif "QueryStage" in name:
            todo.append(plan.plan())
        else:
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows


def test_many_windows_prune_as_well(spark, monkeypatch):
    from tidemark.sources import frame_store

    monkeypatch.setattr(frame_store, "BROADCAST_ROWS", 0)
    store = written(films(spark, {1: (2, 2), 2: (2, 2)}, noise, 50), span=10, stream_parts=4)
    found = store.near(spark.createDataFrame([(1, 1, 12, 13), (2, 1, 40, 41)], "stream_id long, window_id int, w_first long, w_last long"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.stream_id, r.frame_index) for r in found.collect()) == [(1, 12), (1, 13), (2, 40), (2, 41)]


def test_events_with_unreadable_frames_and_mixed_sizes(spark):
    streams = {1: (36, 64), 2: (72, 128), 3: (36, 64)}

    def draw(s, i, h, w):
        return None if (s == 2 and i in (0, 3, 7, 24)) or (s == 3 and i < 30) else block(s, i, h, w)

    files = files_of(spark, streams)
    params = {"shortest_event_s": 6, "scan_width_px": 64}
    found = {(r.stream_id, r.start, r.end) for r in detect.events(films(spark, streams, draw), files, "motion_scan", params).collect()}
    # Thirty frames in a row end the scan of stream 3 before it begins.
    assert {s for s, *_ in found} == {1, 2} and all(start == 20 and 29 <= end <= 30 for _, start, end in found)
    store = written(films(spark, streams, draw), span=16)
    assert {(r.stream_id, r.start, r.end) for r in detect.events(store, files, "motion_scan", params).collect()} == found


def test_grid_is_that_of_a_walk(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, bool(rng.random() > p)) for s, p in enumerate([0.0, 0.1, 0.5, 0.9, 1.0, 0.0]) for i in range(200)]
    steps = [(s, 3 + s % 4, s * 2) for s in range(6)]
    got = prepare.on_grid(spark.createDataFrame(rows, "stream_id long, frame_index long, readable boolean"), spark.createDataFrame(steps, "stream_id long, step long, first long"))
    want = set()
    for s, step, first in steps:
        ok = {i: r for t, i, r in rows if t == s}
        i, failed = first, 0
        while i in ok:
            if ok[i]:
                want.add((s, i))
                i, failed = i + step, 0
                continue
            failed += 1
            if failed == 30:
                break
            i += 1
    assert {(r.stream_id, r.frame_index) for r in got.collect()} == want


def test_null_frames_do_not_end_a_trace(spark):
    frames = films(spark, {1: (8, 8)}, lambda s, i, h, w: None if i == 2 else noise(s, i, h, w), 5)
    assert [r.frame_index for r in pixels.motion_trace(prepare.prepared(frames)).orderBy("frame_index").collect()] == [0, 1, 3, 4]
    assert [r.frame_index for r in pixels.motion_trace(prepare.prepared(frames, mean=True)).orderBy("frame_index").collect()] == [0, 1, 3, 4]
    wrong = spark.createDataFrame([(1, 0, 2, 2, [1.0]), (1, 1, 0, 2, []), (1, 2, 1, 1, [1.0])], SCHEMA)
    assert [r.pixels for r in prepare.prepared(wrong).orderBy("frame_index").collect()] == [None, None, [1.0]]


@pytest.mark.parametrize("jumps", [(), (7,), (1, 2, 20, 41)])
def test_stretches_give_the_scores_of_the_walk(spark, jumps):
    def draw(s, i, h, w):
        level = sum(45 * (-1) ** k for k, j in enumerate(jumps) if i >= j + s)
        return np.clip(block(s, i, h, w) + level, 0, 255) if i not in (13, 30) else (None if i == 13 else np.zeros((h, w)))

    frames = films(spark, {0: (12, 16), 1: (20, 16)}, draw)
    ready = prepare.prepared(frames, None, 1.0, 3, mean=True).cache()
    whole = pixels.motion_trace(ready.drop("mean"))
    apart = pixels.motion_trace(ready)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, whole.select(*apart.columns).collect()))
    stretches = pixels.in_stretches(ready, MotionSettings(), ("stream_id",)).where("stream_id = 0").select("stretch").distinct().count()
    assert stretches >= 1 + len(jumps)


def bar(s, i, h, w, on):
    frame = noise(s, i, h, w)
    if on(i):
        frame[:, w // 2 - 1 : w // 2 + 2] += 90
    return frame


FLOW = {"guard_margin_px": 4, "activity_threshold": 0.5, "flow_start_persistence_s": 2.0, "flow_end_persistence_s": 4.0, "break_report_threshold_s": 2.0, "min_plausible_efflux_s": 5.0}


def test_flows_stop_reading_at_their_end(spark):
    streams = {1: (18, 32), 2: (18, 32), 3: (18, 32), 4: (18, 32)}
    shown = {1: range(8, 16), 2: range(8, 150), 3: range(0), 4: range(8, 400)}
    n = 200
    frames = films(spark, streams, lambda s, i, h, w: None if i == 5 else bar(s, i, h, w, lambda i: i in shown[s]), n)
    store, files = written(frames, span=16), files_of(spark, streams, n)
    found = {r.stream_id: r for r in detect.flow_runs(store, files, FLOW, (10, 0, 12, 18)).collect()}
    assert (found[1].start, found[1].end, found[1].end_confirmed) == (8, 15, True) and (found[2].start, found[2].end) == (8, 149)
    assert found[3].start is None and found[3].status == "failed" and found[4].end == n - 1 and not found[4].end_confirmed and found[4].status == "review"
    scored = {r.stream_id: r.k for r in detect.flow_runs(store, files, FLOW, (10, 0, 12, 18), samples_only=True).groupBy("stream_id").agg((F.max("seq") + 1).alias("k")).collect()}
    assert scored[1] <= 32 and scored[2] == n and scored[3] == scored[4] == n
    assert detect.flow_runs(frames.limit(0), files.limit(0), FLOW, (10, 0, 12, 18)).count() == 0


def test_flow_regions(spark):
    files = files_of(spark, {1: (480, 640), 2: (240, 320)})
    r = {x.stream_id: x for x in detect.flow_regions(files, FlowSettings(), click=(100, 50)).collect()}
    assert r[1].guard == [30, 1, 140, 276] and r[1].inner == [40, 40, 60, 216] and r[1].scale == 1.0
    assert r[2].guard == [30, 6, 140, 168] and r[2].inner == [40, 40, 60, 108]
    wide = detect.flow_regions(files, FlowSettings(), roi=(0, 0, 320, 240)).orderBy("stream_id").first()
    assert wide.scale == 240 / 360 and wide.inner[2] == 213
    for bad in ({"roi": (0, 0, 400, 100)}, {"click": (400, 10)}, {}):
        with pytest.raises(ValueError):
            detect.flow_regions(files, FlowSettings(), **bad)


def test_shaken_broken_and_unfinished_flows(spark):
    streams = {s: (18, 32) for s in range(5)}

    def draw(s, i, h, w):
        on = {0: lambda i: 8 <= i < 40, 1: lambda i: 8 <= i < 16 or 19 <= i < 27 or 30 <= i < 40, 2: lambda i: 8 <= i < 40, 3: lambda i: 8 <= i, 4: lambda i: False}[s]
        frame = bar(s, i, h, w, on)
        return np.clip(frame + (60 if i % 2 else -60), 0, 255) if s == 2 and 20 <= i < 26 else frame

    found = {r.stream_id: r for r in detect.flow_runs(films(spark, streams, draw), files_of(spark, streams), FLOW, (10, 0, 12, 18)).collect()}
    assert found[0].status == "confirmed" and (found[0].start, found[0].end, found[0].breaks) == (8, 39, 0)
    assert found[1].breaks == 2 and any("interruptions" in x for x in found[1].reasons)
    assert found[2].disturbed > 0 and any("movement around" in x for x in found[2].reasons) and found[2].confidence < found[0].confidence
    assert not found[3].end_confirmed and found[3].status == "review" and found[4].status == "failed"


def test_settings_are_checked():
    for make, good, bad in (
        (FlowSettings, {"activity_threshold": 0.5, "outlet_band_fraction": 1}, [{"activity_threshold": 0}, {"activity_threshold": 1}, {"flow_start_persistence_s": 0}, {"roi_height_fraction": 0}, {"min_abs_diff": 0}, {"fail_confidence": 0.8}, {"review_confidence": 1.2}]),
        (MotionSettings, {"least_blob": 0}, [{"least_difference": 0.5}, {"least_blob": 1}, {"idle_rate": 0}, {"active_rate": 1.5}, {"disturbed_area": 0}, {"disturbed_median": 0}, {"sigmas": 0}]),
        (LiquidSettings, {}, [{"outlet_band": 0}]),
        (TimingSettings, {"max_timing_error_s": 0.2}, [{"max_timing_error_s": 0}, {"max_timing_error_s": float("nan")}, {"max_timing_error_s": float("inf")}]),
        (ScanSettings, {"min_sample_interval_s": 5.0}, [{"min_sample_interval_s": 5.1}, {"exit_sigma": 6.5}]),
    ):
        make(**good)
        for x in bad:
            with pytest.raises(ValueError, match=next(iter(x))):
                make(**x)
    flow = overridden(FlowSettings(), {"min_abs_diff": "20", "roi": 1, "outlet": 2, "nothing": 3}, skip_none=False)
    assert flow.min_abs_diff == 20 and flow.scorer().least_difference == 20
    with pytest.raises(ValueError, match="min_abs_diff"):
        overridden(FlowSettings(), {"min_abs_diff": None}, skip_none=False)
