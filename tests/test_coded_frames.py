"""Frames as codes, drawn where they are scored; scorers side by side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import liquid, pixels, prepare
from tidemark.operators.liquid import LiquidScorer
from tidemark.operators.pixels import MotionScorer
from tidemark.operators.settings import LiquidSettings, MotionSettings
from tidemark.sources.tables import Drawing, event_codes, event_frames

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("bar", "times"), [(False, 1), (True, 1), (False, 2)])
def test_codes_are_drawn_as_expressions_draw_them(spark, bar, times):
    want = {(r.stream_id, r.frame_index): r.pixels for r in event_frames(spark, SF, bar=bar, times=times).where("frame_index < 14").collect()}
    rows = event_codes(spark, SF, times=times).where("frame_index < 14").toArrow().combine_chunks().to_batches()[0]
    (at, got), *more = prepare.stacks(rows, prepare.Look(decode=Drawing(bar)))
    assert not more and len(at) == rows.num_rows == len(want)
    keys = list(zip(rows.column("stream_id").to_pylist(), rows.column("frame_index").to_pylist()))
    assert all(got[k].ravel().tolist() == want[keys[i]] for k, i in enumerate(at))


def films(rng, n, length, h, w):
    """Frames with noise, blocks, bars, jumps of light and stills."""
    out = rng.integers(110, 118, (n, length, h, w)).astype(np.float32)
    for s in range(n):
        for _ in range(6):
            i, y, x = rng.integers(length), rng.integers(h - 2), rng.integers(w - 2)
            out[s, i : i + rng.integers(1, 9), y : y + rng.integers(1, h), x : x + rng.integers(1, w // 2)] += rng.integers(20, 120)
        out[s, rng.integers(length) :] += rng.choice([0, 10, 30, 60])
        out[s, rng.integers(length)] += rng.choice([0, 40])
    out[0] = 115
    return np.clip(out, 0, 255)


@pytest.mark.parametrize(
    "make",
    [
        MotionScorer, lambda: MotionScorer(MotionSettings(opening=0, disturbed_area=0.2, brightness_jump=8.0)), lambda: LiquidScorer((3, 2, 8, 9)),
        lambda: LiquidScorer((0, 0, 16, 12), LiquidSettings(opening=3)), lambda: LiquidScorer((1, 1, 9, 9), LiquidSettings(opening=0, disturbed_outside=0.05)),
    ],
)
def test_scorers_side_by_side_score_as_alone(make):
    film = films(np.random.default_rng(4), 40, 50, 12, 16)
    alone = []
    for frames in film:
        scorer = make()
        alone.append([tuple(scorer.score(f)) for f in frames])
    # In two parts: the second takes the scorers over from the first.
    first = [make() for _ in film]
    got, side = [[] for _ in film], None
    for part in (range(20), range(20, 50)):
        if side:
            first = [side.leave(i) for i in range(len(film))]
        side = type(first[0]).together(first, film.shape[2:])
        for k in part:
            for s, row in enumerate(zip(*side.score(film[:, k]))):
                got[s].append(row)
    assert got == alone
    assert len({row for rows in alone for row in rows}) > 20


def test_groups_that_lie_in_several_pieces_go_on(spark, monkeypatch):
    film = films(np.random.default_rng(8), 5, 40, 12, 16)
    rows = [(s, i, 12, 16, None if (s, i) in ((1, 7), (2, 0)) or (s == 3 and 2 < i < 34) else film[s, i].ravel().tolist()) for s in range(5) for i in range(40)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_index long, height int, width int, pixels array<float>").coalesce(1)
    want = []
    for s in range(5):
        scorer, failed = MotionScorer(), 0
        for i in range(40):
            if failed >= 30 or rows[s * 40 + i][4] is None:
                failed += 1 if failed < 30 else 0
                continue
            failed = 0
            want.append((s, i, *scorer.score(film[s, i])))
    assert sorted(tuple(r) for r in pixels.motion_trace(frames).collect()) == want
    batch = frames.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(prepare, "MOST_PIXELS", 12 * 16 * 7)
    assert [p.num_rows for p in prepare.pieces(batch)][:2] == [7, 7] and sum(p.num_rows for p in prepare.pieces(batch)) == 200
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(tuple(r) for r in pixels.motion_trace(frames).collect()) == want
        alone = sorted(tuple(r) for r in liquid.liquid_trace(frames, (3, 2, 8, 9)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert alone == sorted(tuple(r) for r in liquid.liquid_trace(frames, (3, 2, 8, 9)).collect())
    assert frames.where(F.col("pixels").isNull()).count() > 30
