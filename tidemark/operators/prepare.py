"""Frames made ready for scoring: crop, area downscale, luma, blur, in the order that moves fewest bytes."""

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sampling import MOST_FAILURES
from tidemark.sources.stored import stored

#: Most groups whose own rows are broadcast to their frames.
BROADCAST_GROUPS = 100_000
#: Fixed weights of blue, green and red, and small blur kernels.
LUMA = np.array([0.114, 0.587, 0.299], np.float32)
KERNELS = {3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


@lru_cache
def shares(n: int, m: int) -> np.ndarray:
    """What each of n cells gives to each of m cells over the same length; rows sum to 1."""
    edge = np.arange(m + 1) * (n / m)
    cells = np.arange(n)
    overlap = np.minimum(edge[1:, None], cells + 1) - np.maximum(edge[:-1, None], cells)
    return (np.maximum(overlap, 0) * (m / n)).astype(np.float32)


@lru_cache
def kernel(size: int) -> np.ndarray:
    size += size % 2 == 0
    if size in KERNELS:
        return np.array(KERNELS[size], np.float32)
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return (k / k.sum()).astype(np.float32)


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.float32)


def prepare(frame: np.ndarray, roi: tuple[int, int, int, int] | None, scale: float, blur: int) -> np.ndarray:
    """frame: height by width, or height by width by 3 (blue, green, red), 0 to 255. Grey levels of the region, rounded after each step; a scale of 1 or more leaves the size."""
    return prepare_all(frame[None], roi, scale, blur)[0]


def prepare_all(frames: np.ndarray, roi: tuple[int, int, int, int] | None, scale: float, blur: int) -> np.ndarray:
    """As prepare, of frames of one size, stacked."""
    if roi:
        x, y, w, h = roi
        frames = frames[:, y : y + h, x : x + w]
    frames = frames.astype(np.float32)
    if scale < 1:
        h, w = (max(1, round(n * scale)) for n in frames.shape[1:3])
        frames = np.stack([_reduced(f, h, w) for f in frames])
    if frames.ndim == 4:
        frames = whole(frames @ LUMA)
    if blur >= 3:
        k = kernel(blur)
        r = len(k) // 2
        for axis in (1, 2):
            # Mirrored at the border, the border itself not repeated.
            pad = [(r, r) if a == axis else (0, 0) for a in (0, 1, 2)]
            n = frames.shape[axis]
            p = np.pad(frames, pad, mode="reflect" if n > r else "symmetric")
            frames = sum(w * (p[:, i : i + n] if axis == 1 else p[:, :, i : i + n]) for i, w in enumerate(k))
        frames = whole(frames)
    return frames


def _reduced(frame: np.ndarray, h: int, w: int) -> np.ndarray:
    frame = np.tensordot(shares(frame.shape[0], h), frame, axes=(1, 0))
    return whole(np.moveaxis(np.tensordot(frame, shares(frame.shape[1], w), axes=(1, 1)), -1, 1) if frame.ndim == 3 else frame @ shares(frame.shape[1], w).T)


class Look(NamedTuple):
    """How frames are made ready where they are scored: see prepared. Frames that come as codes (a column `code`; null: cannot be read) are drawn there by decode(codes, height, width), which gives grey levels of frames of one
    size, stacked; so only codes are exchanged and stored."""

    roi: tuple[int, int, int, int] | str | None = None
    scale: float | str = 1.0
    blur: int = 0
    decode: Callable[[pa.Array, int, int], np.ndarray] | None = None

    def columns(self, names: list[str]) -> list[str]:
        """The columns of frames that it needs."""
        levels = ["code"] if self.decode else ["n_channels", "data"] if "data" in names else ["pixels"]
        return ["height", "width", *levels, *(x for x in (self.roi, self.scale) if isinstance(x, str))]


#: Pixels that are made ready at once, and frames of few pixels (small enough for a core's cache).
MOST_PIXELS, CACHED_PIXELS = 1 << 22, 1 << 17


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut into rows of at most MOST_PIXELS, or of one frame."""
    size = [(h or 0) * (w or 0) for h, w in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist())]
    first = held = 0
    for i, n in enumerate(size):
        if held + n > MOST_PIXELS and i > first:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(size):
        yield batch.slice(first)


def stacks(batch: pa.RecordBatch, look: Look) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, frames made ready) of the frames of a batch that can be read, by their size and look: row numbers, and grey levels by row, height and width."""
    n, raw = batch.num_rows, "data" in batch.schema.names
    levels = batch.column("code" if look.decode else "data" if raw else "pixels")
    channels = batch.column("n_channels").to_pylist() if raw and not look.decode else [1] * n
    rois, scales = (batch.column(x).to_pylist() if isinstance(x, str) else [x] * n for x in (look.roi, look.scale))
    alike: dict = {}
    for i, (h, w, c, r, x, ok) in enumerate(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), channels, rois, scales, levels.is_valid().to_pylist())):
        if ok and None not in (h, w, c) and h * w * c > 0:
            alike.setdefault((h, w, c, tuple(r) if r else None, x), []).append(i)
    if not look.decode and not raw:
        values, offset = levels.values.to_numpy(zero_copy_only=False), levels.offsets.to_numpy()
    for (h, w, c, r, x), rows in alike.items():
        if look.decode:
            rows = np.array(rows)
            few = max(1, CACHED_PIXELS // (h * w))
            parts = [prepare_all(look.decode(levels.take(pa.array(rows[k : k + few])), h, w), r, x, look.blur) for k in range(0, len(rows), few)]
            yield rows, np.ascontiguousarray(np.concatenate(parts), np.float32)
            continue
        flat = {i: np.frombuffer(levels[i].as_py(), np.uint8) if raw else values[offset[i] : offset[i + 1]] for i in rows}
        rows = np.array([i for i in rows if len(flat[i]) == h * w * c], np.int64)
        if not len(rows):
            continue
        few, parts = max(1, CACHED_PIXELS // (h * w)), []
        for k in range(0, len(rows), few):
            some = np.stack([flat[i] for i in rows[k : k + few]])
            parts.append(prepare_all(some.reshape(-1, h, w, c)[..., :3] if c > 1 else some.reshape(-1, h, w), r, x, look.blur))
        yield rows, np.ascontiguousarray(np.concatenate(parts), np.float32)


def prepared(frames: DataFrame, roi: tuple[int, int, int, int] | str | None = None, scale: float | str = 1.0, blur: int = 0, mean: bool = False) -> DataFrame:
    """frames with their grey levels as scorers take them: height, width and pixels array<float> new, and if asked for the mean level; other columns kept. frames have height, width, and either pixels array<float> (grey) or
    n_channels and data (bytes by row, blue, green and red in turn, a fourth ignored; or grey). `roi` and `scale` are those of all frames, or names of columns, which go (an array x, y, w, h; a number). A null frame stays null, and so does one whose bytes do not fit its size."""
    look = Look(roi, scale, blur)
    used = look.columns(frames.columns)
    kept = [c for c in frames.columns if c not in used and c not in ("pixels", "n_channels", "data")]
    names = [*kept, "height", "width", "pixels", *(("mean",) if mean else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole_batch in batches for x in pieces(whole_batch)):
            n = batch.num_rows
            heights, widths, values, means = [None] * n, [None] * n, [None] * n, [None] * n
            for rows, got in stacks(batch, look):
                h, w = got.shape[1:]
                flat = got.reshape(len(rows), -1)
                for i, v in zip(rows.tolist(), flat):
                    heights[i], widths[i], values[i] = h, w, v
                if mean:
                    for i, m in zip(rows.tolist(), flat.mean(axis=1).tolist()):
                        means[i] = m
            new = [pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.array(values, pa.list_(pa.float32())), *([pa.array(means, pa.float64())] if mean else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names)

    types = {"height": "int", "width": "int", "pixels": "array<float>", "mean": "double"}
    schema = frames.select(*kept, *(F.lit(None).cast(types[c]).alias(c) for c in names[len(kept) :])).schema
    return frames.select(*kept, *used).mapInArrow(run, schema)


def means(frames: DataFrame, look: Look, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """(keys, frame_index, mean): the mean grey level of each frame as the look makes it ready; null for one that cannot be read."""
    names = [*keys, "frame_index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole_batch in batches for x in pieces(whole_batch)):
            found = np.full(batch.num_rows, np.nan)
            for rows, got in stacks(batch, look):
                found[rows] = got.reshape(len(rows), -1).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.float64(), from_pandas=True)], [*names, "mean"])

    return frames.select(*names, *look.columns(frames.columns)).mapInArrow(run, frames.select(*names, F.lit(None).cast("double").alias("mean")).schema)


def sampled(frames: DataFrame, steps: DataFrame, most_failures: int = MOST_FAILURES, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Which frames a scan reads: (keys, frame_index) of frames (keys, frame_index, readable) for steps (keys, step, and first, where the scan does not start at frame 0).

    The scan steps on by `step` after a readable frame, but by one after an unreadable one, so that its phase moves; that many unreadable ones in a row, or a missing frame, end it.
    A task walks its groups in order and holds three numbers."""

    def run(batches):
        group, target, failed, expected = None, 0, 0, 0
        for pdf in batches:
            taken = []
            for own, i, ok, step, first in zip(zip(*(pdf[k] for k in keys)), pdf["frame_index"], pdf["readable"], pdf["step"], pdf["first"]):
                if own != group:
                    group, target, failed, expected = own, first, 0, first
                if i < first:
                    continue
                if i != expected:
                    target = -1
                expected += 1
                if i != target:
                    continue
                if ok:
                    taken.append((*own, i))
                    target, failed = i + step, 0
                else:
                    failed += 1
                    target = i + 1 if failed < most_failures else -1
            yield pd.DataFrame(taken, columns=[*keys, "frame_index"])

    first = F.col("first") if "first" in steps.columns else F.lit(0)
    rows = frames.select(*keys, "frame_index", "readable").join(steps.select(*keys, "step", first.cast("long").alias("first")), [*keys])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "frame_index").mapInPandas(run, f"{types}, frame_index long")


def on_grid(frames: DataFrame, steps: DataFrame, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """The frames (with readable) that the scans of `steps` read, see sampled. Where all frames of a group are readable, its frames follow from the step; only numbers of the other groups' frames are walked."""
    first = F.coalesce("first", F.lit(0)) if "first" in steps.columns else F.lit(0)
    numbers = frames.select(*keys, "frame_index", "readable")
    odd = stored(numbers.where(~F.col("readable")).select(*keys).distinct(), "unreadable")
    n_odd, n = odd.count(), steps.count()
    small = F.broadcast(steps) if n <= BROADCAST_GROUPS else steps
    since = F.col("frame_index") - first
    even = frames.join(small, [*keys]).where((since >= 0) & (since % F.col("step") == 0)).select(*frames.columns)
    if not n_odd:
        return even
    odd = F.broadcast(odd) if n_odd <= BROADCAST_GROUPS else odd
    walked = sampled(numbers.join(odd, [*keys], "left_semi"), steps, keys=keys)
    return even.join(odd, [*keys], "left_anti").unionByName(frames.join(walked, [*keys, "frame_index"], "left_semi"))


def next_readable(frames: DataFrame, most_reads: int = MOST_FAILURES) -> DataFrame:
    """frames (stream_id, frame_index, readable) with `shown`: the first readable frame within so many from each one on; null if there is none."""
    ahead = Window.partitionBy("stream_id").orderBy("frame_index").rangeBetween(0, most_reads - 1)
    return frames.withColumn("shown", F.min(F.when(F.col("readable"), F.col("frame_index"))).over(ahead))
