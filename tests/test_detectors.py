"""From frames to events, and the parts that lead there: preparation, settings, scans, exports, streams."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.oracle import compare
from tidemark.functions import clock, geometry
from tidemark.operators import detect, intervals, liquid, pixels, prepare, refine, report
from tidemark.operators.settings import RefineSettings, RunSettings, ScanSettings, overridden
from tidemark.plans import catalog, oracles
from tidemark.streaming.flows import flow_stream
from tidemark.streaming.scoring import liquid_stream, persistent_stream
from tidemark.sources.tables import event_frames, events_trace

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


def test_prepare_against_plain_means():
    rng = np.random.default_rng(1)
    frame = rng.integers(0, 256, (60, 80, 3)).astype(np.uint8)
    half = prepare.prepare(frame, (10, 20, 40, 30), 0.5, 0)
    crop = frame[20:50, 10:50].astype(float)
    means = crop.reshape(15, 2, 20, 2, 3).mean(axis=(1, 3))
    want = np.rint(np.rint(means) @ [0.114, 0.587, 0.299])
    assert half.shape == (15, 20) and np.abs(half - want).max() <= 1
    assert prepare.prepare(frame, None, 1.5, 0).shape == (60, 80)
    grey = frame[..., 0]
    third = prepare.prepare(grey, None, 1 / 3, 0)
    assert third.shape == (20, 27) and abs(third.mean() - grey.mean()) < 1
    flat = np.full((9, 9), 77, np.uint8)
    for k in (2, 3, 4, 5, 7, 9):
        assert (prepare.prepare(flat, None, 1, k) == 77).all()
    spot = np.zeros((9, 9), np.uint8)
    spot[4, 4] = 160
    assert prepare.prepare(spot, None, 1, 3)[3:6, 3:6].tolist() == [[10, 20, 10], [20, 40, 20], [10, 20, 10]]
    assert prepare.prepare(flat[:1], None, 0.01, 3).shape == (1, 1)


def test_prepared_frames(spark):
    raw = bytes(range(12)) * 1
    df = spark.createDataFrame([("a", 0, 2, 2, 3, bytearray(raw)), ("a", 1, 2, 2, 1, bytearray(b"\x01\x02\x03\x04")), ("a", 2, None, None, None, None)], "stream string, frame_index long, height int, width int, n_channels int, data binary")
    got = prepare.prepared(df).orderBy("frame_index").collect()
    assert got[1].pixels == [1, 2, 3, 4] and got[0].pixels == [round(0.114 * b + 0.587 * (b + 1) + 0.299 * (b + 2)) for b in (0, 3, 6, 9)] and got[2].pixels is None
    assert prepare.prepared(df.limit(0)).count() == 0


def test_planted_runs_are_found(spark):
    frames = event_frames(spark, SF)
    files = catalog.recordings(frames)
    found = detect.events(frames, files, "motion_scan", {"shortest_event_s": "6"}).collect()
    n = {r.stream_id: r.n for r in files.collect()}
    want = {(s, k) for s in n for k in range(8, n[s] - 1, 24)}
    assert {(r.stream_id, r.start) for r in found} == want
    assert all(r.label == "Motion" and abs(r.end - min(r.start + 7, n[r.stream_id] - 1)) < 0.6 and not r.truncated for r in found)
    one = detect.events(frames, files, "robot_activity", {"shortest_event_s": 6, "max_candidates": 1, "long_run_s": 3}).collect()
    assert len(one) == len(n) and {r.label for r in one} == {"Machine active (unusually long)"} and all(r.truncated for r in one if n[r.stream_id] > 34)
    still = frames.withColumn("pixels", F.transform("pixels", lambda x: F.lit(120.0).cast("float")))
    assert detect.events(still, files, "motion_scan").count() == 0
    assert detect.events(frames.limit(0), files.limit(0), "motion_scan").count() == 0
    # A region of interest beside the block sees nothing.
    assert detect.events(frames, files, "motion_scan", {"shortest_event_s": 6}, roi=(20, 0, 10, 18)).count() == 0


def test_each_window_has_a_fresh_scorer(spark):
    made = spark.sparkContext.accumulator(0)

    class Counting(pixels.MotionScorer):
        def __init__(self):
            super().__init__()
            made.add(1)

    frames = event_frames(spark, SF).where("stream_id < 3").withColumn("window_id", F.floor(F.col("frame_index") / 10).cast("int"))
    groups = frames.select("stream_id", "window_id").distinct().count()
    got = pixels.scored(frames, Counting, "score double, disturbed boolean", ("stream_id", "window_id")).collect()
    first = {(r.stream_id, r.window_id): min(x.frame_index for x in got if (x.stream_id, x.window_id) == (r.stream_id, r.window_id)) for r in got}
    assert made.value == groups and all(r.score == 0 for r in got if r.frame_index == first[r.stream_id, r.window_id])


def test_modes_and_settings():
    assert [m.name for m in detect.MODES] == ["robot_activity", "motion_scan"]
    with pytest.raises(ValueError, match="not available"):
        detect.detector("other")
    s = overridden(ScanSettings(), {"shortest_event_s": "3", "scan_width_px": "64", "unknown": 1, "roi": {}, "sensitivity": None})
    assert s.shortest_event_s == 3.0 and s.scan_width_px == 64 and s.sensitivity == 0.5
    for bad in ({"safety_factor": 1}, {"sensitivity": 2}, {"shortest_event_s": 0}, {"min_sample_interval_s": 9}, {"exit_sigma": 7}, {"max_candidates": 0}, {"scan_width_px": 10}, {"safety_factor": "x"}, {"shortest_event_s": "nan"}, {"shortest_event_s": float("inf")}):
        with pytest.raises(ValueError):
            overridden(ScanSettings(), bad)
    for make, bad in ((RefineSettings, {"pre_roll_s": -1}), (RefineSettings, {"review_confidence": 1.5}), (RunSettings, {"idle_pause_s": -1})):
        with pytest.raises(ValueError):
            overridden(make(), bad)
    with pytest.raises(ValueError):
        overridden(ScanSettings(), {"sensitivity": None}, skip_none=False)


def test_blobs_against_a_flood():
    rng = np.random.default_rng(2)
    for density in (0.1, 0.4, 0.6, 1.0, 0.0):
        mask = rng.random((23, 31)) < density
        label, seen, n = pixels.blob_labels(mask), np.zeros(mask.shape, bool), 0
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            n += 1
            part, todo = set(), [(y, x)]
            while todo:
                a, b = todo.pop()
                if not (0 <= a < 23 and 0 <= b < 31) or not mask[a, b] or seen[a, b]:
                    continue
                seen[a, b] = True
                part.add((a, b))
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            assert len({label[p] for p in part}) == 1 and (label == label[y, x]).sum() == len(part)
        assert len(set(label[mask])) == n and (label[~mask] == 0).all()
    assert pixels.blob_statistics(np.eye(4, dtype=bool), 0.1) == (0.25, 0.25, 1)


def test_peaks_of_intervals_that_touch(spark):
    trace = spark.createDataFrame([(1, float(t), float(s)) for t, s in enumerate([1, 9, 3, 8, 2, 7, 5])], "stream_id long, t double, score double")
    spans = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 4.0, 4.5), (1, 4.6, 4.8), (2, 0.0, 9.0)], "stream_id long, start double, end double")
    got = sorted(tuple(r) for r in intervals.with_peaks(spans, trace, ["stream_id"]).collect())
    assert got == [(1, 0.0, 1.0, 9.0), (1, 1.0, 3.0, 9.0), (1, 4.0, 4.5, 2.0), (1, 4.6, 4.8, 0.0), (2, 0.0, 9.0, 0.0)]


def test_windows_meet_their_samples(spark):
    rng = np.random.default_rng(3)
    samples = [(s, float(t), i) for s in range(3) for i, t in enumerate(np.sort(rng.random(200) * 5000))]
    wins = [(s, k, float(a), float(a + w)) for s in range(3) for k, (a, w) in enumerate(zip(rng.random(8) * 4000, rng.random(8) * 2000))]
    got = refine.inside(spark.createDataFrame(wins, "stream_id long, window_id int, w_start double, w_end double"), spark.createDataFrame(samples, "stream_id long, t double, seq long"), 300.0)
    assert sorted((r.stream_id, r.window_id, r.seq) for r in got.collect()) == sorted((s, k, i) for s, t, i in samples for v, k, a, b in wins if s == v and a <= t <= b)


def test_flows_on_a_stream_as_by_windows(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    samples = catalog.flow_samples(events_trace(spark, sf)).drop("score")
    for part in range(3):  # three triggers, so that the machine goes on from its state
        third = samples.withColumn("part", F.ntile(3).over(Window.partitionBy("stream_id").orderBy("t", "seq"))).where(F.col("part") == part + 1).drop("part")
        third.coalesce(1).sortWithinPartitions("t", "seq").write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    q = flow_stream(source, *catalog.FLOW.values(), catalog.BREAK).writeStream.format("memory").queryName("flows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = catalog.flows(events_trace(spark, sf)).where("end_confirmed")
    names = want.columns

    def rounded(rows):
        return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names) for r in rows)

    got = rounded(spark.table("flows").collect())
    assert len(got) > 10 and got == rounded(want.collect())


def test_recording_starts(spark):
    rows = ["2026-03-04T07:43:00", "2026-03-04 07:43:00", "2026-03-04 07:43", " 2026-03-04T07:43:00Z ", "2026-03-04T07:43:00.5+02:00", "20260304T074300", "2026-03-04", "2026-02-30", "2026-03-04T24:00:00", "now", "", None, "2026-03-04T07:43:00Zx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.c for r in df.select("i", clock.clock_text(clock.recording_start(F.col("t"))).alias("c")).orderBy("i").collect()]
    assert got == [*["2026-03-04 07:43:00"] * 6, "2026-03-04 00:00:00", *[""] * 6]
    later = df.where("i = 0").select(clock.clock_text(clock.wall_clock(clock.recording_start(F.col("t")), F.lit(61.5))), clock.clock_text(clock.wall_clock(clock.recording_start(F.col("t")), F.lit(-5.0)))).first()
    assert tuple(later) == ("2026-03-04 07:44:01", "2026-03-04 07:43:00")


def test_exports(spark, tmp_path):
    schema = "stream_id long, label string, start double, end double, confidence double, status string, notes array<string>"
    events = spark.createDataFrame([(1, "b", 3661.5, 3665.0, 0.5, "review", ["x", "y"]), (1, "a", 1.0, 2.0, 0.985, "confirmed", [])], schema)
    starts = spark.createDataFrame([(1, "2026-03-04 07:43:00"), (2, None)], "stream_id long, s string").select("stream_id", F.col("s").cast("timestamp_ntz").alias("recording_start"))
    rows = report.export_rows(events, starts, "motion_scan")
    docs = {r.stream_id: json.loads(r.json) for r in report.export_json(rows, starts).collect()}
    assert [r["event"] for r in docs[1]["rows"]] == ["a", "b"] and docs[1]["has_wall_clock"] and docs[1]["recording_start"] == "2026-03-04T07:43:00" and docs[1]["columns"] == list(report.COLUMNS)
    assert docs[1]["rows"][1] == {"event": "b", "start_video_time": "1:01:01.500", "end_video_time": "1:01:05.000", "duration_s": 3.5, "start_wall_clock": "2026-03-04 08:44:01", "end_wall_clock": "2026-03-04 08:44:05", "confidence_pct": 50, "status": "needs review", "detector": "motion_scan", "notes": "x | y"}
    assert docs[2]["rows"] == [] and docs[2]["recording_start"] is None and not docs[2]["has_wall_clock"]
    for name, df in (("some", rows), ("none", rows.limit(0))):
        report.write_csv(df.select(*report.COLUMNS).coalesce(1), f"{tmp_path}/{name}")
        text = b"".join(p.read_bytes() for p in (tmp_path / name).glob("*.csv")).decode()
        assert text.startswith(",".join(report.COLUMNS) + "\r\n") and text.count("\r\n") == 1 + df.count()
    for bad in ([(1, "a", 2.0, 1.0, 0.5, "review", [])], [(1, "a", 1.0, 2.0, 1.5, "review", [])]):
        with pytest.raises(Exception, match="(end before|between 0 and 1)"):
            report.sound(spark.createDataFrame(bad, schema)).collect()


def test_regions_from_json(spark):
    def read(text):
        return tuple(spark.createDataFrame([(text,)], "t string").select(geometry.roi_from_json(F.col("t")).alias("r")).first().r)

    assert read('{"x": 1, "y": "2", "width": 30.9, "height": 4, "more": 1}') == (1, 2, 30, 4)
    assert read('{"x": -1.5, "y": 0, "width": 3, "height": 4}')[0] == -1
    for bad in ('{"x": 1, "y": 2, "width": 3}', '{"x": "1.5", "y": 2, "width": 3, "height": 4}', '{"x": null, "y": 2, "width": 3, "height": 4}', "no"):
        with pytest.raises(Exception, match="not valid"):
            read(bad)


def test_scans_step_over_unreadable_frames(spark):
    rows = [(1, i, i not in (4, 5, 12)) for i in range(20)] + [(2, i, i < 6 or i > 40) for i in range(60)] + [(3, i, True) for i in range(7)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_index long, readable boolean")
    steps = spark.createDataFrame([(1, 4), (2, 5), (3, 3)], "stream_id long, step long")
    got = {}
    for r in prepare.sampled(frames, steps).orderBy("stream_id", "frame_index").collect():
        got.setdefault(r.stream_id, []).append(r.frame_index)
    assert got == {1: [0, 6, 10, 14, 18], 2: [0, 5], 3: [0, 3, 6]}
    shown = {(r.stream_id, r.frame_index): r.shown for r in prepare.next_readable(frames).collect()}
    assert shown[1, 4] == 6 and shown[1, 0] == 0 and shown[2, 6] is None and shown[2, 12] == 41


def test_streams_of_liquid_and_persistence(spark, tmp_path):
    frames = event_frames(spark, SF, bar=True).where("stream_id < 3")
    frames.coalesce(1).sortWithinPartitions("frame_index").write.parquet(f"{tmp_path}/frames")
    want = sorted(tuple(r) for r in liquid.liquid_trace(frames, (10, 0, 12, 18)).collect())
    trace = events_trace(spark, SF).withColumn("on", F.col("score") >= 30)
    trace.coalesce(1).sortWithinPartitions("t", "seq").write.parquet(f"{tmp_path}/trace")
    held = sorted((r.stream_id, r.t, r.seq, r.run_start, r.fires) for r in intervals.persistent(trace, ["stream_id"], "on", 12.0).collect())

    def run(name, path, schema, build):
        q = build(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((tuple(r) for r in spark.table(name).collect()), key=str)

    assert run("wet", f"{tmp_path}/frames", frames.schema, lambda s: liquid_stream(s, (10, 0, 12, 18))) == sorted(want, key=str)
    assert run("held", f"{tmp_path}/trace", trace.schema, lambda s: persistent_stream(s, "on", 12.0)) == sorted(held, key=str)


@pytest.fixture(scope="module")
def long_stream(spark, tmp_path_factory):
    """Events of a stream of 221 runs, more than a scan's default of candidates, and of a short one."""
    folder = str(tmp_path_factory.mktemp("long"))
    rows = spark.range(5300 + 40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") < 5300, 7).otherwise(8).cast("long").alias("user_id"))
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return folder, con


def test_motion_events_of_a_stream_of_many_runs(spark, long_stream):
    folder, con = long_stream
    compare(catalog.queries()["motion_events"](spark, folder), con, SQL["motion_events"])


def test_recorded_events_of_a_stream_of_many_runs(spark, long_stream):
    folder, con = long_stream
    compare(catalog.queries()["recorded_events"](spark, folder), con, SQL["recorded_events"])
