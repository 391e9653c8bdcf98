"""Time and frame algebra as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: unreadable frames in a row that end a scan, and frames that a look at one place tries.
MOST_FAILURES = 30


def seconds_to_frames(seconds: Column, fps: Column, least: int = 0) -> Column:
    """Half-even; a negative time is an error."""
    frames = F.bround(seconds * fps).cast("long")
    return F.when(seconds < 0, F.raise_error(F.lit("negative time"))).otherwise(F.greatest(F.lit(least).cast("long"), frames)).cast("long")


def frames_to_seconds(frame: Column, fps: Column) -> Column:
    return frame / fps


def frame_index_at(t: Column, fps: Column, frame_count: Column) -> Column:
    """floor(t * fps), kept literally: it is not the inverse of frames_to_seconds for every index."""
    return F.least(F.floor(F.greatest(F.lit(0.0), t) * fps), frame_count - 1)


def last_index(end: Column, duration: Column, fps: Column, frame_count: Column) -> Column:
    """The last frame of a scan that ends at `end`: bounded by the frame count, else by the duration, else only by what can be read (2 ** 30)."""
    by_count = F.least(F.floor(F.greatest(F.lit(0.0), end) * fps), frame_count - 1)
    by_time = F.floor(F.greatest(F.lit(0.0), F.least(end, duration)) * fps)
    return F.when(frame_count > 0, by_count).when(duration.isNotNull(), by_time).when(end > 0, F.floor(end * fps)).otherwise(1 << 30).cast("long")


def valid_fps(fps: Column) -> Column:
    return F.coalesce(~F.isnan(fps) & fps.between(0.5, 1000.0), F.lit(False))


def sample_interval(shortest: Column, safety: Column, least: float, most: float, fps: Column) -> Column:
    """The interval at which an event of the shortest length has `safety` samples, within bounds and not below one frame."""
    wanted = F.greatest(F.lit(least), F.least(F.lit(most), shortest / safety))
    return F.when(safety < 2, F.raise_error(F.lit("safety below 2")).cast("double")).otherwise(F.greatest(wanted, 1 / fps))


def step_frames(interval: Column, fps: Column) -> Column:
    return seconds_to_frames(interval, fps, 1)


def estimated_samples(start: Column, end: Column, step: Column, fps: Column) -> Column:
    return (F.floor((end - start) / (step / fps)) + 1).cast("long")


def scale_for_width(source: Column, target: Column) -> Column:
    """Never above 1."""
    return F.least(F.lit(1.0), target / source)
