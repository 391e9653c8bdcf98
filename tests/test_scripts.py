"""Scripted flows, sample by sample, through windows, through pieces and through the machine of streams; and scripted time stamps."""

import pytest

from tidemark.operators import flow, intervals, timing
from tidemark.streaming.flows import FlowMachine

FPS = 25
L, E, D, LOW = (0.6, 0.6, False, 40.0), (0.0, 0.0, False, 0.0), (0.0, 0.9, True, 0.0), (0.8, 0.0, False, 40.0)
#: Samples, seconds of persistence at start and end; expected start and end (frames; None: none), whether the end is confirmed, and breaks.
SCRIPTS = {
    "one bright frame": ([E] * 10 + [L] + [E] * 10, 0.3, 0.5, None, None, False, 0),
    "first frame of the run": ([E] * 25 + [L] * 50, 0.3, 0.5, 25, 74, False, 0),
    "flicker": (([L] * 5 + [E] * 10) * 5, 0.5, 0.5, None, None, False, 0),
    "liquid below the outlet alone": ([LOW] * 50, 0.2, 0.5, None, None, False, 0),
    "disturbed frames start nothing": ([D] * 50, 0.2, 0.5, None, None, False, 0),
    "a short gap": ([L] * 50 + [E] * 3 + [L] * 50, 0.3, 0.5, 0, 102, False, 0),
    "last drops": ([L] * 100 + ([L] + [E] * 7) * 6 + [E] * 40, 0.2, 0.5, 0, 140, True, 5),
    "the end is the last activity": ([L] * 100 + [E] * 40, 0.2, 0.5, 0, 99, True, 0),
    "disturbance is no absence": ([L] * 100 + [E] * 3 + [D] * 25 + [E], 0.2, 0.5, 0, 99, False, 0),
    "absence after disturbance": ([L] * 100 + [E] * 3 + [D] * 25 + [E] * 15, 0.2, 0.5, 0, 99, True, 0),
    "disturbance between drops": ([L] * 100 + [E] * 6 + [D] * 10 + [L] + [E] * 40, 0.2, 0.5, 0, 116, True, 0),
    "the film ends": ([L] * 100, 0.2, 0.5, 0, 99, False, 0),
    "ten seconds": ([E] * 25 + [L] * 250 + [E] * 40, 0.2, 0.5, 25, 274, True, 0),
    "one break": ([L] * 50 + [E] * 10 + [L] * 50 + [E] * 40, 0.2, 1.0, 0, 109, True, 1),
}
SCHEMA = "stream_id long, t double, seq long, activity double, outlet double, liquid boolean, contrast double, noise double, disturbed boolean"
NAMES = list(SCRIPTS)


def rows(names):
    return [(NAMES.index(k), i / FPS, i, a, o, None, c, 3.0, d) for k in names for i, (a, o, d, c) in enumerate(SCRIPTS[k][0])]


@pytest.mark.parametrize("holds", sorted({(s, e) for _, s, e, *_ in SCRIPTS.values()}))
@pytest.mark.parametrize("pieces", [None, 12])
def test_scripted_flows(spark, holds, pieces):
    own = [k for k in NAMES if SCRIPTS[k][1:3] == holds]
    samples = spark.createDataFrame(rows(own), SCHEMA)
    samples = intervals.cut(samples, ["stream_id"], pieces) if pieces else samples
    got = {NAMES[r.stream_id]: r for r in flow.measurements(flow.phases(samples, 0.12, *holds), 0.12, 0.2).collect()}
    for k in own:
        _, _, _, start, end, confirmed, breaks = SCRIPTS[k]
        want = (None if start is None else start / FPS, None if end is None else end / FPS, confirmed, breaks)
        assert (got[k].start, got[k].end, got[k].end_confirmed, got[k].breaks) == want, k
    if "disturbed frames start nothing" in own:
        assert got["disturbed frames start nothing"].disturbed == 50


@pytest.mark.parametrize("name", NAMES)
def test_scripted_flows_of_a_stream(name):
    script, start_hold, end_hold, start, end, confirmed, breaks = SCRIPTS[name]
    machine = FlowMachine(0.12, start_hold, end_hold, 0.2)
    for i, (a, o, d, c) in enumerate(script):
        machine.step(i / FPS, a, o, None, c, 3.0, d)
    row = machine.row()
    assert (row[0], row[1], row[2], row[-1]) == (None if start is None else start / FPS, None if end is None else end / FPS, confirmed, breaks)


def test_persistence_is_in_seconds_not_frames(spark):
    found = []
    for fps in (15, 25, 60):
        n = 4 * fps
        samples = [(1, i / fps, i, *((0.6, 0.6) if i < 3 * fps else (0.0, 0.0)), None, 1.0, 1.0, False) for i in range(n)]
        r = flow.measurements(flow.phases(spark.createDataFrame(samples, SCHEMA), 0.12, 0.2, 0.5), 0.12, 0.2).first()
        found.append(r.end - r.start)
        assert r.end_confirmed
    assert max(found) - min(found) < 0.11


def track(*parts):
    """Stamps from (gap, times)."""
    out = [0.0]
    for gap, n in parts:
        for _ in range(n):
            out.append(out[-1] + gap)
    return out


def alternating(a, b, n):
    return track(*[(a if i % 2 else b, 1) for i in range(n)])


CADENCES = {
    "constant": (track((40.0, 399)), "constant"),
    "whole milliseconds": (alternating(33.0, 34.0, 399), "constant"),
    "a dropped frame": (track((40.0, 105), (80.0, 1), (40.0, 293)), "constant"),
    "irregular window": (track((33.3, 380), (200.0, 19)), "irregular_within_window"),
    "another rate": (track((33.3, 225), (200.0, 174)), "rate_changes_between_windows"),
    "a modest change": (track((33.3, 200), (40.0, 199)), "rate_changes_between_windows"),
    "no stamps": ([0.0] * 400, "no_usable_timestamps"),
    "stamps at the start only": (track((40.0, 39), (0.0, 960)), "unrepresentative_sample"),
    "very short": (track((40.0, 14)), "too_short_to_matter"),
    "one short window": (track((40.0, 30)), "constant"),
    "drift": (track((33.3, 130), (600.0, 1), (33.3, 268)), "timing_drift"),
    "a small slip": (track((33.3, 130), (53.3, 1), (33.3, 268)), "constant"),
    "a late start": ([5000.0 + x for x in track((40.0, 399))], "constant"),
    "shape before drift": (track((33.3, 130), (600.0, 1), (33.3, 100), (200.0, 168)), "rate_changes_between_windows"),
}


def test_cadences(spark):
    stamps = [(i, k, float(v)) for i, (x, _) in enumerate(CADENCES.values()) for k, v in enumerate(x)]
    df = spark.createDataFrame(stamps, "stream_id long, frame long, pts_ms double")
    names = list(CADENCES)
    assert {names[r.stream_id]: r.reason for r in timing.verdicts(df).collect()} == {k: want for k, (_, want) in CADENCES.items()}
    wide = {names[r.stream_id]: r.reason for r in timing.verdicts(df, 1000.0).collect()}
    assert wide["drift"] == "constant" and wide["shape before drift"] == "rate_changes_between_windows"
