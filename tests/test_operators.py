"""Cases with known numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import review, sampling
from tidemark.operators import flow, intervals, liquid, pixels, report, timing
from tidemark.sources import probe
from tidemark.streaming.scoring import motion_stream


def trace(spark, scores, disturbed=()):
    rows = [(1, float(i), i, float(s), i in disturbed, 0.1, 0.05) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "stream_id long, t double, seq long, score double, disturbed boolean, enter double, exit double")


@pytest.mark.parametrize(
    "scores,disturbed,dense,want",
    [
        ([0.001] * 5 + [0.5] * 10 + [0.001] * 5, (), True, [(5, 14)]),
        ([0.001] * 5 + [0.5] * 10 + [0.001] * 5, (), False, [(4, 15)]),
        ([0, 0, 0, 0.5, 0.08, 0.5, 0.07, 0.5, 0, 0, 0], (), True, [(3, 7)]),
        ([0, 0, 0, 0.5, 0.5, 0.5, 0.5], (), True, [(3, 6)]),
        ([0, 0, 0.9, 0.9, 0], (2, 3), True, []),
    ],
)
def test_hysteresis(spark, scores, disturbed, dense, want):
    got = intervals.active_intervals(trace(spark, scores, disturbed), ["stream_id"], dense).select("start", "end").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("spans,gap,want", [([(0, 5), (6, 9)], 2, [(0, 9)]), ([(0, 5), (20, 25)], 2, [(0, 5), (20, 25)]), ([(0, 5), (7, 9)], 2, [(0, 9)]), ([(0, 10), (1, 2), (11, 12)], 2, [(0, 12)])])
def test_bridging(spark, spans, gap, want):
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in spans], "stream_id long, start double, end double")
    assert sorted(tuple(r)[1:] for r in intervals.bridged(df, ["stream_id"], gap).collect()) == want


@pytest.mark.parametrize("seconds,fps,want", [(0.5, 30, 15), (0.5, 60, 30), (0.5, 15, 8), (1, 25, 25), (0, 25, 0), (2, 29.97, 60)])
def test_seconds_to_frames(spark, seconds, fps, want):
    assert spark.range(1).select(sampling.seconds_to_frames(F.lit(float(seconds)), F.lit(float(fps)))).first()[0] == want


@pytest.mark.parametrize("seconds,want", [(59.9999, "0:01:00.000"), (59.9994, "0:00:59.999"), (-3.0, "0:00:00.000"), (3661.25, "1:01:01.250")])
def test_time_text(spark, seconds, want):
    assert spark.range(1).select(report.video_timestamp(F.lit(seconds))).first()[0] == want


def run_flow(spark, script, start, end):
    rows = []
    for n, kind in script:
        for _ in range(n):
            i = len(rows)
            on = kind == "L"
            rows.append((1, i / 25, i, 0.9 if on else 0.0, 0.9 if on else 0.0, None, 20.0, 1.0, kind == "D"))
    df = spark.createDataFrame(rows, "stream_id long, t double, seq long, activity double, outlet double, liquid boolean, contrast double, noise double, disturbed boolean")
    return flow.measurements(flow.phases(df, 0.3, start, end), 0.3, 0.3).first()


@pytest.mark.parametrize(
    "script,start,end,begin,finish,confirmed",
    [
        ([(10, "E"), (1, "L"), (10, "E")], 0.3, 0.5, None, None, False),
        ([(25, "E"), (50, "L")], 0.3, 0.5, 1.0, 74 / 25, False),
        ([(50, "D")], 0.2, 0.5, None, None, False),
        ([(100, "L"), (40, "E")], 0.2, 0.5, 0.0, 99 / 25, True),
        ([(100, "L"), (3, "E"), (25, "D"), (1, "E")], 0.2, 0.5, 0.0, 99 / 25, False),
        ([(100, "L"), (3, "E"), (25, "D"), (15, "E")], 0.2, 0.5, 0.0, 99 / 25, True),
    ],
)
def test_flow(spark, script, start, end, begin, finish, confirmed):
    got = run_flow(spark, script, start, end)
    assert (got.start, got.end_confirmed) == (begin, confirmed)
    assert got.end == (pytest.approx(finish) if finish else None)


def test_flow_breaks(spark):
    assert run_flow(spark, [(50, "L"), (10, "E"), (50, "L"), (40, "E")], 0.2, 1.0).breaks == 1


def test_timing(spark):
    rows = [(1, i, i * 40.0) for i in range(1000)] + [(2, i, i * 33.3 if i < 600 else 600 * 33.3 + (i - 600) * 200.0) for i in range(1000)] + [(3, i, i * 40.0) for i in range(21)]
    got = timing.verdicts(spark.createDataFrame(rows, "stream_id long, frame long, pts_ms double"))
    assert {r.stream_id: r.reason for r in got.collect()} == {1: "constant", 2: "rate_changes_between_windows", 3: "too_short_to_matter"}


def frames():
    rng = np.random.default_rng(1)
    base = np.full((240, 320), 120.0)
    out = []
    for i in range(6):
        f = base + rng.normal(0, 2.5, base.shape)
        if i == 4:
            f[90:150, 100:160] += 90
        if i == 5:
            f += 80
        out.append((1, i, 240, 320, [float(x) for x in np.clip(f, 0, 255).round().ravel()]))
    return out


SCHEMA = "stream_id long, frame_index long, height int, width int, pixels array<float>"


def test_motion_scores(spark, tmp_path):
    df = spark.createDataFrame(frames(), SCHEMA)
    got = sorted(tuple(r)[1:] for r in pixels.motion_trace(df).collect())
    assert all(s < 0.001 and not d for _, s, d in got[:4])
    assert got[4][1] == pytest.approx(0.047, abs=0.01) and got[5][2]
    df.repartition(1).sortWithinPartitions("frame_index").write.parquet(f"{tmp_path}/in")
    stream = motion_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("motion").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r)[1:] for r in spark.table("motion").collect()) == got


def test_liquid_scores(spark):
    inner, out = (10, 0, 20, 36), []
    for i in range(8):
        f = np.full((40, 40), 100.0)
        if i in (2, 3):
            f[0:36, 18:22] += 60  # a stream
        if i == 4:
            f[20:24, 18:21] += 60  # a drop
        if i == 5:
            f[10:14, 11:29] += 60  # too wide
        if i == 6:
            f[:, :10] += 60
            f[:, 30:36] += 60  # the surroundings
        if i == 7:
            f += 60
        out.append((1, i, 40, 40, [float(x) for x in f.ravel()]))
    got = [r.asDict() for r in sorted(liquid.liquid_trace(spark.createDataFrame(out, SCHEMA), inner).collect(), key=lambda r: r.frame_index)]
    assert [r["liquid"] for r in got[:6]] == [None, False, True, True, True, False]
    assert [r["activity"] for r in got[:6]] == [0, 0, 1, 1, pytest.approx(4 / 36), 0]
    assert [r["outlet"] for r in got[2:5]] == [1, 1, 0] and got[2]["contrast"] == pytest.approx(60)
    assert [r["disturbed"] for r in got] == [False] * 6 + [True, True]


def test_review_and_codec_edges(spark):
    rows = spark.createDataFrame([(59.96,), (3599.96,), (3661.4,), (-2.0,), (None,), (float("nan"),), (float("inf"),)], "s double")
    assert [r[0] for r in rows.select(review.tenths_text(F.col("s"))).collect()] == ["01:00.0", "1:00:00.0", "1:01:01.4", "00:00.0", *["--:--.-"] * 3]
    assert [r[0] for r in rows.select(review.seek_time(F.col("s"), F.lit(100.0))).collect()] == [59.96, 100, 100, 0, 0, 0, 0]
    codes = spark.createDataFrame([(0x34363248,), (0,), (-1,), (None,), (0x01020304,)], "c long")
    assert [r[0] for r in codes.select(probe.codec_text(F.col("c"))).collect()] == ["H264", *["unknown"] * 4]
    stamps = spark.createDataFrame([(1, i, 40.0 * i) for i in range(10)] + [(2, i, 0.0) for i in range(10)] + [(3, i, 40.0 * i) for i in range(5)], "stream_id long, frame long, pts_ms double")
    assert dict(probe.estimated_rates(stamps).collect()) == {1: 25.0, 2: None, 3: None}


def test_sizes_as_text_round_halves_to_even_below_a_gigabyte(spark):
    from tidemark.functions.clock import bytes_text

    mb = 1 << 20
    rows = [(mb // 4 * 5,), (mb // 4 * 7,), (mb * 1023 + mb // 4 * 3,), (mb * 1024,), (1320 * mb + 819 * 1024,), (0,), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "n long").coalesce(1).select(bytes_text(F.col("n")).alias("t")).collect()]
    assert got == ["1.2 MB", "1.8 MB", "1023.8 MB", "1.00 GB", "1.29 GB", "unknown", "unknown"]


def test_regions_are_read_from_a_text_once(spark):
    from tidemark.plans import catalog

    plan = catalog.inner_regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1 and plan.count("get_json_object") == 4
