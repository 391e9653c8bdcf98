"""Detectors from frames to events: a sampled coarse pass, candidates, a dense second pass around each one, events.

A detector says which scorer a pass takes, what events are called and what is derived from them; the two passes are the same for all.
"""

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geometry, sampling, stats
from tidemark.operators import flow, intervals, liquid, pixels, prepare, refine, report
from tidemark.operators.settings import FlowSettings, RefineSettings, RunSettings, ScanSettings, overridden
from tidemark.operators.tracking import Run
from tidemark.sources.frame_store import FrameStore, written
from tidemark.sources.stored import stored

KEY = ["stream_id"]
#: Most streams whose plans are broadcast to their frames.
BROADCAST_STREAMS = 100_000
BLUR = 3
#: Width to which the crop of a flow is brought down.
FLOW_WIDTH = 240
TRACE = "score double, disturbed boolean"


@dataclass(frozen=True)
class Detector:
    name: str
    display_name: str
    description: str
    #: Makes the settings of runs' names into the label of an event (start, end).
    label: Callable[[RunSettings], Column]
    #: What makes a scorer: an object with score(frame) -> (score, disturbed); each pass and window gets a new one.
    scorer: Callable[[], Any] = pixels.MotionScorer
    #: Whether pauses between events are events too.
    pauses: bool = False
    #: Whether the scorer starts anew at jumps in brightness, so that one recording is scored in stretches (see pixels.in_stretches).
    by_jumps: bool = True


def _run_label(settings: RunSettings) -> Column:
    long = (F.lit(settings.long_run_s) > 0) & (F.col("end") - F.col("start") > settings.long_run_s)
    return F.when(long, "Machine active (unusually long)").otherwise("Machine active")


#: Fixed names of the modes, in the order in which they are offered.
MODES = (
    Detector("robot_activity", "Robot / machine activity", "Finds the periods in which a machine worked, and the quiet spells between them.", _run_label, pauses=True),
    Detector("motion_scan", "Generic motion / change scan", "Reports every period in which the picture changed.", lambda settings: F.lit("Motion")),
)


def detector(mode: str) -> Detector:
    for found in MODES:
        if found.name == mode:
            return found
    raise ValueError(f"that analysis mode is not available: {mode!r} is none of {', '.join(m.name for m in MODES)}")


def _with_streams(frames: DataFrame, streams: DataFrame, n: int) -> DataFrame:
    return frames.join(F.broadcast(streams) if n <= BROADCAST_STREAMS else streams, "stream_id")


def _as_store(frames: DataFrame | FrameStore) -> FrameStore:
    return frames if isinstance(frames, FrameStore) else written(frames)


def _scale(roi: tuple[int, int, int, int] | None, target: int) -> Column:
    """Of each file by its own width, or by that of the region."""
    wide = F.lit(roi[2]) if roi else F.coalesce(F.col("width"), F.lit(1))
    return F.least(F.lit(1.0), F.lit(target) / F.greatest(wide, F.lit(1)))


def _watched(run: Run | None, df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
    return run.observed(df, name, **aggregates) if run else df


def coarse_trace(store: FrameStore, plan: DataFrame, n: int, how: Detector, roi: tuple[int, int, int, int] | None, run: Run | None = None) -> DataFrame:
    """(stream_id, t, seq, score, disturbed) of the sampled frames; plan (stored): stream_id, step, fps, scale."""
    seen = prepare.on_grid(store.frames().drop("s_part", "t_part"), plan.select("stream_id", "step"))
    seen = _with_streams(seen.drop("readable"), plan.select("stream_id", "scale"), n)
    # Looked at twice: for the jumps, and for the scores.
    if store.decode:
        look = prepare.Look(roi, "scale", BLUR, store.decode)
        found = pixels.motion_trace(seen, look=look, means=stored(prepare.means(seen, look), "means")) if how.by_jumps else pixels.scored(seen, how.scorer, TRACE, look=look)
    else:
        ready = prepare.prepared(seen, roi, "scale", BLUR, mean=how.by_jumps)
        found = pixels.motion_trace(stored(ready, "prepared")) if how.by_jumps else pixels.scored(ready, how.scorer, TRACE)
    found = _with_streams(found, plan.select("stream_id", "fps"), n)
    found = found.select("stream_id", (F.col("frame_index") / F.col("fps")).alias("t"), F.col("frame_index").alias("seq"), "score", "disturbed")
    return stored(_watched(run, found, "scan", samples=F.count("*"), disturbed=F.count_if("disturbed")), "coarse-trace")


def fine_trace(store: FrameStore, wins: DataFrame, how: Detector, roi: tuple[int, int, int, int] | None) -> DataFrame:
    """(stream_id, window_id, t, seq, score, disturbed) of the frames of windows (stored: stream_id, window_id, w_start, w_end, fps, fine_step, fine_scale), from that of the window's start on. Only stretches that a window touches are read."""
    spans = wins.select("stream_id", "window_id", "fps", "fine_step", "fine_scale", F.floor(F.col("w_start") * F.col("fps")).alias("w_first"), F.floor(F.col("w_end") * F.col("fps")).alias("w_last"))
    keys = ("stream_id", "window_id")
    near = store.near(spans.select(*keys, "w_first", "w_last", "fine_scale"), "fine_scale").drop("w_first")
    seen = prepare.on_grid(near, spans.select(*keys, F.col("fine_step").alias("step"), F.col("w_first").alias("first")), keys)
    if store.decode:
        found = pixels.scored(seen, how.scorer, TRACE, keys, look=prepare.Look(roi, "fine_scale", BLUR, store.decode))
    else:
        found = pixels.scored(prepare.prepared(seen.drop("readable"), roi, "fine_scale", BLUR), how.scorer, TRACE, keys)
    n = spans.count()
    rates = spans.select(*keys, "fps")
    found = found.join(F.broadcast(rates) if n <= BROADCAST_STREAMS else rates, [*keys])
    return found.select(*keys, (F.col("frame_index") / F.col("fps")).alias("t"), F.col("frame_index").alias("seq"), "score", "disturbed")


def events(frames: DataFrame | FrameStore, files: DataFrame, mode: str, params: dict[str, Any] | None = None, roi: tuple[int, int, int, int] | None = None, run: Run | None = None, every: bool = False) -> DataFrame:
    """frames (stream_id, frame_index, height, width, pixels or data; or a store of them) of files (stream_id, fps, n frames, width) -> stream_id, label, start, end (seconds), confidence, status, notes, truncated.

    Each file is scaled by its own width. A frame without pixels cannot be read: the scan steps over it by one, and 30 in a row end it. truncated says that a stream had more candidates than were looked at;
    with `every`, all candidates are looked at, however many there are. A run (see tracking) gets the counts and times of the passes."""
    how, params, store = detector(mode), params or {}, _as_store(frames)
    scan, fine, runs = (overridden(s, params) for s in (ScanSettings(), RefineSettings(), RunSettings()))

    plan = files.withColumn("interval", sampling.sample_interval(F.lit(scan.shortest_event_s), F.lit(scan.safety_factor), scan.min_sample_interval_s, scan.max_sample_interval_s, F.col("fps")))
    plan = plan.select("stream_id", "fps", "n", "interval", sampling.step_frames(F.col("interval"), F.col("fps")).alias("step"), _scale(roi, scan.scan_width_px).alias("scale"), _scale(roi, fine.refine_width_px).alias("fine_scale"))
    plan = plan.withColumn("fine_step", sampling.step_frames(F.lit(fine.dense_step_s), F.col("fps")))
    plan = stored(_watched(run, plan, "plan", recordings=F.count("*"), duration_s=F.sum(F.col("n") / F.col("fps"))), "plans")
    n = plan.count()
    if run:
        run.mark("plan")
    trace = coarse_trace(store, plan, n, how, roi, run)

    levels = stats.with_thresholds(stats.with_noise(trace, KEY), scan.enter_sigma, scan.exit_sigma, scan.min_changed_area_ratio, scan.sensitivity)
    found = intervals.active_intervals(levels, KEY, dense=False)
    found = intervals.long_enough(intervals.bridged(found, KEY, scan.bridge_gap_s), scan.min_candidate_duration_s)
    top = found.withColumn("truncated", F.lit(False)) if every else intervals.strongest(intervals.with_peaks(found, trace, KEY), KEY, scan.max_candidates)
    # The second pass looks back by a coarse interval at least, or a start could lie outside.
    ends = plan.select("stream_id", F.lit(0.0).alias("first"), (F.col("n") / F.col("fps")).alias("last"), F.greatest(F.lit(fine.pre_roll_s), "interval").alias("pre"), F.greatest(F.lit(fine.post_roll_s), "interval").alias("post"), "fps", "fine_step", "fine_scale")
    wins = refine.windows_within(top, ends, F.col("pre"), F.col("post"), "truncated", "fps", "fine_step", "fine_scale")
    wins = stored(_watched(run, wins, "windows", windows=F.count("*")), "windows")
    if run:
        run.mark("scan")

    again = _watched(run, fine_trace(store, wins, how, roi), "refine", dense=F.count("*"))
    merged = refine.merged(refine.refined(wins, again, 0.0015, fine.merge_gap_s, fine.min_event_duration_s))

    out = report.with_status(merged, fine.review_confidence).withColumn("label", how.label(runs))
    out = stored(_watched(run, out, "events", events=F.count("*")), "events")
    if run:
        run.mark("refine")
    columns = ["stream_id", "label", "start", "end", "confidence", "status", "notes"]
    if how.pauses and runs.idle_pause_s > 0:
        idle = intervals.pauses(out, KEY, runs.idle_pause_s).withColumns({"label": F.lit("Extended pause"), "status": F.when(F.col("confidence") >= fine.review_confidence, "confirmed").otherwise("review"), "notes": F.array().cast("array<string>")})
        out = out.select(*columns).unionByName(idle.select(*columns))
    cut = wins.groupBy("stream_id").agg(F.max("truncated").alias("truncated"))
    return report.sound(out.select(*columns)).join(cut, "stream_id", "left")


FLOW_SAMPLE = ["stream_id", "t", "seq", "activity", "outlet", "liquid", "contrast", "noise", "disturbed"]


def flow_regions(files: DataFrame, settings: FlowSettings, roi: tuple[int, int, int, int] | None = None, click: tuple[int, int] | None = None) -> DataFrame:
    """files (stream_id, width, height, ...) with where a flow is looked at: guard (the crop), inner (the region in the scaled crop), scale. The region is given, or lies below a click on the outlet."""
    sides = files.withColumns({"fw": F.col("width").cast("int"), "fh": F.col("height").cast("int")})
    if roi is None and click is None:
        raise ValueError("a timed flow needs a region, or a click on the outlet")
    if roi is None:
        sides = geometry.with_click_region(sides.withColumns({"px": F.lit(click[0]), "py": F.lit(click[1])}), settings.default_roi_width_px, settings.roi_height_fraction)
        sides = sides.withColumn("usable", F.col("px").between(0, F.col("fw") - 1) & F.col("py").between(0, F.col("fh") - 1))
    else:
        sides = sides.withColumns({k: F.lit(v) for k, v in zip("xywh", roi)}).withColumn("usable", F.lit(True))
    sides = sides.withColumn("usable", F.col("usable") & geometry.inside_frame())
    bad = sides.where(~F.coalesce("usable", F.lit(False))).select("stream_id").first()
    if bad:
        raise ValueError(f"the region does not lie in the frames of recording {bad[0]!r}")
    found = geometry.with_guard(sides, settings.guard_margin_px).withColumn("scale", F.least(F.lit(1.0), F.lit(FLOW_WIDTH) / F.col("g_w")))
    found = geometry.with_inner(found, F.col("scale"))
    return found.select(*files.columns, "scale", F.array("g_x", "g_y", "g_w", "g_h").alias("guard"), F.array("i_x", "i_y", "i_w", "i_h").alias("inner"))


def flow_runs(frames: DataFrame | FrameStore, files: DataFrame, params: dict[str, Any] | None = None, roi: tuple[int, int, int, int] | None = None, click: tuple[int, int] | None = None, samples_only: bool = False) -> DataFrame:
    """The timed flow of each recording: frames (stream_id, frame_index, height, width, pixels or data; or a store of them) of files (stream_id, fps, n frames, width, height), in a region of them or below a click.

    Recordings are read from their start by horizons, each twice the one before; a recording whose flow has ended, or that has no more frames, is not looked at again. So at most
    twice the frames up to the end of a flow, and those of one stretch of the store, are scored. With samples_only, the scored samples of each recording's last horizon."""
    settings, store = overridden(FlowSettings(), params or {}, skip_none=False), _as_store(frames)
    open_ = stored(flow_regions(files, settings, roi, click).select("stream_id", "fps", "n", "guard", "inner", "scale"), "flow-files")
    horizon, out = store.span, []
    while (n := open_.count()) or not out:
        seen = _with_streams(store.until(horizon).drop("s_part", "t_part"), open_.select("stream_id", "guard", "inner", "scale"), n).where(F.col("frame_index") < horizon)
        seen = prepare.on_grid(seen, open_.select("stream_id", F.lit(1).alias("step"))).drop("readable")
        if store.decode:
            found = liquid.liquid_trace(seen, "inner", settings.scorer(), prepare.Look("guard", "scale", BLUR, store.decode))
        else:
            found = liquid.liquid_trace(prepare.prepared(seen, "guard", "scale", BLUR), "inner", settings.scorer())
        samples = _with_streams(found, open_.select("stream_id", "fps"), n).withColumns({"t": F.col("frame_index") / F.col("fps"), "seq": F.col("frame_index")})
        samples = stored(samples.select("stream_id", "t", "seq", "activity", "outlet", "liquid", "contrast", "noise", "disturbed"), "flow-samples")
        threshold = settings.activity_threshold
        timed = stored(flow.measurements(flow.phases(samples, threshold, settings.flow_start_persistence_s, settings.flow_end_persistence_s), threshold, settings.break_report_threshold_s), "flows")
        ended = timed.where("end_confirmed").select("stream_id").unionByName(open_.where(F.col("n") <= horizon).select("stream_id")).distinct()
        out.append((samples if samples_only else timed).join(ended, "stream_id", "left_semi"))
        open_ = stored(open_.join(ended, "stream_id", "left_anti"), "flow-files")
        horizon *= 2
    timed = out[0]
    for more in out[1:]:
        timed = timed.unionByName(more)
    if samples_only:
        return timed
    return flow.with_reasons(flow.judged(timed, settings.min_plausible_efflux_s, settings.fail_confidence, settings.review_confidence), settings.min_plausible_efflux_s)
