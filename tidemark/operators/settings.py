"""Settings of scans, scorers, flows and verdicts: names and defaults as one table each, the range of a value beside it, one check for all.

A range is written as in mathematics: a closed end belongs to it, an open one does not. What two values must hold between them is listed after the fields."""

from dataclasses import MISSING, dataclass, field, fields, replace
from math import inf, isfinite
from typing import Any


@dataclass(frozen=True)
class Range:
    low: float = -inf
    high: float = inf
    #: "[]", "[)", "(]" or "()".
    ends: str = "[]"

    def has(self, x: float) -> bool:
        return (x > self.low or (self.ends[0] == "[" and x == self.low)) and (x < self.high or (self.ends[1] == "]" and x == self.high))

    def __str__(self) -> str:
        return f"{self.ends[0]}{self.low:g}, {self.high:g}{self.ends[1]}"


POSITIVE, NOT_NEGATIVE, SHARE, PART = Range(0, ends="(]"), Range(0), Range(0, 1), Range(0, 1, "(]")


def ranged(default: Any, range_: Range) -> Any:
    return field(default=default, metadata={"range": range_})


class Checked:
    """Numbers are finite and within their ranges; ORDERED names pairs of which the first is at most the second."""

    ORDERED: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        for f in fields(self):
            value, range_ = getattr(self, f.name), f.metadata.get("range", Range())
            if isinstance(value, (int, float)) and not isinstance(value, bool) and not (isfinite(value) and range_.has(value)):
                raise ValueError(f"{f.name} = {value} lies outside {range_}")
        for small, large in self.ORDERED:
            if getattr(self, small) > getattr(self, large):
                raise ValueError(f"{small} = {getattr(self, small)} exceeds {large} = {getattr(self, large)}")


# Names and defaults below are fixed values.


@dataclass(frozen=True)
class ScanSettings(Checked):
    """The coarse pass; seconds and pixels. Under two samples in the shortest event, one could fall between them."""

    shortest_event_s: float = ranged(15.0, POSITIVE)
    safety_factor: float = ranged(3.0, Range(2))
    min_sample_interval_s: float = ranged(0.10, POSITIVE)
    max_sample_interval_s: float = ranged(5.00, POSITIVE)
    scan_width_px: int = ranged(320, Range(64))
    min_changed_area_ratio: float = 0.004
    enter_sigma: float = 6.0
    exit_sigma: float = 3.0
    sensitivity: float = ranged(0.5, SHARE)
    min_candidate_duration_s: float = 1.0
    bridge_gap_s: float = 2.0
    max_candidates: int = ranged(200, Range(1))

    ORDERED = (("min_sample_interval_s", "max_sample_interval_s"), ("exit_sigma", "enter_sigma"))


@dataclass(frozen=True)
class RefineSettings(Checked):
    """The dense second pass."""

    pre_roll_s: float = ranged(5.0, NOT_NEGATIVE)
    post_roll_s: float = ranged(5.0, NOT_NEGATIVE)
    dense_step_s: float = ranged(0.0, NOT_NEGATIVE)
    refine_width_px: int = ranged(640, Range(64))
    min_event_duration_s: float = ranged(1.0, NOT_NEGATIVE)
    merge_gap_s: float = ranged(1.5, NOT_NEGATIVE)
    review_confidence: float = ranged(0.60, SHARE)


@dataclass(frozen=True)
class RunSettings(Checked):
    """How runs of a machine are named, and which pauses are reported; 0 turns either off."""

    idle_pause_s: float = ranged(300.0, NOT_NEGATIVE)
    long_run_s: float = ranged(0.0, NOT_NEGATIVE)


@dataclass(frozen=True)
class MotionSettings(Checked):
    """The motion scorer; grey levels and shares of the frame."""

    least_difference: float = ranged(10.0, Range(1))
    sigmas: float = ranged(4.0, POSITIVE)
    least_blob: float = ranged(0.0005, Range(0, 1, "[)"))
    opening: int = 3
    idle_rate: float = ranged(0.05, PART)
    active_rate: float = ranged(0.0005, PART)
    disturbed_area: float = ranged(0.55, PART)
    brightness_jump: float = 28.0
    disturbed_median: float = ranged(18.0, POSITIVE)


@dataclass(frozen=True)
class LiquidSettings(Checked):
    """The liquid scorer."""

    least_difference: float = ranged(12.0, Range(1))
    sigmas: float = 4.0
    opening: int = 2
    outlet_band: float = ranged(0.22, PART)
    least_stream_height: float = 0.25
    most_width: float = 0.55
    least_drop_area: int = 8
    least_drop_height: int = 2
    idle_rate: float = 0.02
    disturbed_outside: float = 0.35
    disturbed_median: float = 18.0


@dataclass(frozen=True)
class FlowSettings(Checked):
    """One timed flow: its region, what counts as liquid, how long it must show or be gone, and what a time is worth. These are the names under which parameters come."""

    default_roi_width_px: int = 60
    roi_height_fraction: float = ranged(0.45, PART)
    outlet_band_fraction: float = ranged(0.22, PART)
    min_abs_diff: int = ranged(12, Range(1))
    noise_sigma_multiplier: float = 4.0
    open_kernel_px: int = 2
    min_stream_height_fraction: float = 0.25
    max_stream_width_fraction: float = 0.55
    min_drop_area_px: int = 8
    activity_threshold: float = ranged(0.12, Range(0, 1, "()"))
    flow_start_persistence_s: float = ranged(0.30, POSITIVE)
    flow_end_persistence_s: float = ranged(0.50, POSITIVE)
    break_report_threshold_s: float = 0.20
    disturbance_area_ratio: float = 0.35
    guard_margin_px: int = 40
    disturbance_median_diff: float = 18.0
    min_plausible_efflux_s: float = 2.0
    review_confidence: float = ranged(0.70, SHARE)
    fail_confidence: float = ranged(0.40, SHARE)

    ORDERED = (("fail_confidence", "review_confidence"),)

    def scorer(self) -> LiquidSettings:
        return LiquidSettings(
            least_difference=self.min_abs_diff, sigmas=self.noise_sigma_multiplier, opening=self.open_kernel_px, outlet_band=self.outlet_band_fraction, least_stream_height=self.min_stream_height_fraction,
            most_width=self.max_stream_width_fraction, least_drop_area=self.min_drop_area_px, disturbed_outside=self.disturbance_area_ratio, disturbed_median=self.disturbance_median_diff,
        )


@dataclass(frozen=True)
class TimingSettings(Checked):
    """How far stamps may drift from one frame rate; seconds."""

    max_timing_error_s: float = ranged(0.05, POSITIVE)


def _coerced(name: str, current: Any, value: Any) -> Any:
    try:
        got = type(current)(value)
    except (TypeError, ValueError, OverflowError) as e:
        raise ValueError(f"{name} cannot be {value!r}") from e
    if isinstance(got, float) and not isfinite(got):
        raise ValueError(f"{name} cannot be {value!r}")
    return got


def overridden(settings: Any, params: dict[str, Any], ignore: frozenset[str] = frozenset({"roi", "outlet"}), skip_none: bool = True) -> Any:
    """settings with the parameters that it knows, each turned into the type of the default; others are ignored. A None is skipped, or, for timed flows (skip_none False), an error."""
    known = {f.name for f in fields(settings) if f.default is not MISSING} - ignore
    return replace(settings, **{k: _coerced(k, getattr(settings, k), v) for k, v in params.items() if k in known and not (skip_none and v is None)})
