"""Streams that are cut into pieces give the rows of whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import flow, intervals

KEY = ["stream_id"]
SCHEMA = "stream_id long, t double, seq long, score double, disturbed boolean"


def trace(seed, streams=(1, 2, 300, 4, 900)):
    """Scores that often stay between the levels or away from them for long, so that whole pieces decide nothing."""
    rng, rows = random.Random(seed), []
    for s, n in enumerate(streams):
        level, t = 50.0, 0.0
        for i in range(n):
            if rng.random() < 0.08:
                level = rng.choice([10.0, 50.0, 50.0, 90.0])
            t += rng.choice([0.0, 1.0, 1.0, 2.5])
            rows.append((s, t, i, level + rng.uniform(-5, 5), rng.random() < 0.1))
    return rows


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pieces_change_nothing(spark, seed):
    samples = spark.createDataFrame(trace(seed), SCHEMA).withColumns({"enter": F.lit(80.0), "exit": F.lit(20.0), "on": F.col("score") > 45})
    cut = intervals.cut(samples, KEY, 60)  # pieces of about 20 samples
    assert cut.groupBy("stream_id").agg(F.countDistinct("piece").alias("n")).agg(F.max("n")).first()[0] > 20
    for dense in (False, True):
        assert as_set(intervals.active_intervals(cut, KEY, dense)) == as_set(intervals.active_intervals(samples, KEY, dense))
    assert as_set(intervals.persistent(cut, KEY, "on", 6.0).drop("piece")) == as_set(intervals.persistent(samples, KEY, "on", 6.0))


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_flows_in_pieces(spark, seed):
    rng = random.Random(seed)
    rows = [(s, t, i, v, rng.choice([v, v / 2]), rng.choice([None, None, v > 40]), float(i % 4), 1.0, d) for s, t, i, v, d in trace(seed)]
    samples = spark.createDataFrame(rows, "stream_id long, t double, seq long, activity double, outlet double, liquid boolean, contrast double, noise double, disturbed boolean")
    for hold, end in ((3.0, 8.0), (1.0, 30.0)):
        got, want = (flow.phases(x, 40.0, hold, end) for x in (intervals.cut(samples, KEY, 40), samples))
        assert as_set(got.select(*want.columns)) == as_set(want)
        assert as_set(flow.breaks(got, 2.0)) == as_set(flow.breaks(want, 2.0))

        def rounded(df):
            return as_set(df.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in df.dtypes]))

        assert rounded(flow.measurements(got, 40.0, 2.0)) == rounded(flow.measurements(want, 40.0, 2.0))


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA).withColumns({"enter": F.lit(1.0), "exit": F.lit(0.5)})
    assert intervals.active_intervals(intervals.cut(none, KEY), KEY, True).count() == 0
    one = spark.createDataFrame([(1, 3.0, 0, 9.0, False)], SCHEMA).withColumns({"enter": F.lit(1.0), "exit": F.lit(0.5)})
    assert [tuple(r) for r in intervals.active_intervals(intervals.cut(one, KEY), KEY, False).collect()] == [(1, 3.0, 3.0)]


def test_no_window_sees_a_whole_stream(spark):
    samples = spark.createDataFrame(trace(1), SCHEMA).withColumns({"enter": F.lit(80.0), "exit": F.lit(20.0), "on": F.lit(True)})
    cut = intervals.cut(samples, KEY, 30)
    for found in (intervals.active_intervals(cut, KEY, True), intervals.persistent(cut, KEY, "on", 1.0)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:  # over pieces, or over the few rows of a piece's end
                assert "piece#" in line.rsplit("], [", 2)[-2] or "piece#" in line.rsplit("[", 1)[-1], line
