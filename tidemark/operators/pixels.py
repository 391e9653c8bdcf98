"""Stateful scoring of grey frames: the one part that window functions cannot express.

Frames are dealt out by stream and sorted; a task walks its frames in Arrow batches and holds one background a time.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sampling import MOST_FAILURES
from tidemark.operators.prepare import Look, pieces, stacks
from tidemark.operators.settings import MotionSettings


def opened(mask: np.ndarray) -> np.ndarray:
    """Erosion, then dilation, by a cross of 3 by 3; beyond the border everything is set, then nothing."""

    def shifted(m, fill):
        p = np.pad(m, 1, constant_values=fill)
        return np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    return shifted(shifted(mask, True).all(axis=0), False).any(axis=0)


def blob_labels(mask: np.ndarray) -> np.ndarray:
    """A number for each 8-connected part, 0 elsewhere. Runs of set pixels are the nodes; runs of neighbouring rows that touch, also at corners, are joined."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1] - 1
    if not len(row):
        return np.zeros(mask.shape, int)
    wide = w + 3
    low = np.searchsorted(row * wide + end, (row + 1) * wide + start - 1)
    n = np.maximum(np.searchsorted(row * wide + start, (row + 1) * wide + end + 1, "right") - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(row))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    out = np.zeros(mask.size, int)
    size = end - start + 1
    out[np.repeat(row * w + start - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(label + 1, size)
    return out.reshape(mask.shape)


def blob_areas(mask: np.ndarray) -> np.ndarray:
    """Areas of the 8-connected parts."""
    areas = np.bincount(blob_labels(mask).ravel())[1:]
    return areas[areas > 0]


def blob_statistics(mask: np.ndarray, least_ratio: float) -> tuple[float, float, int]:
    """Of the parts that have at least that share of the pixels: their share, the largest one's, and their number."""
    areas = blob_areas(mask)
    kept = areas[areas >= max(1, int(least_ratio * mask.size))]
    return float(kept.sum() / mask.size), float(kept.max(initial=0) / mask.size), len(kept)


class MotionScorer:
    def __init__(self, settings: MotionSettings = MotionSettings()):
        self.settings, self.background, self.mean = settings, None, None

    def score(self, frame: np.ndarray) -> tuple[float, bool]:
        """The share of the frame that moves, and whether the scene was disturbed as a whole."""
        s, now = self.settings, frame.astype(np.float32)
        mean = float(now.mean())
        if self.background is None:
            self.background, self.mean = now.copy(), mean
            return 0.0, False
        diff = np.abs(now - self.background)
        shift, jump = float(np.median(diff)), abs(mean - (self.mean or mean))
        self.mean = mean
        if shift >= s.disturbed_median or jump >= s.brightness_jump:
            self.background = now.copy()
            return 0.0, True
        rest = diff - shift
        sigma = 1.4826 * float(np.median(np.abs(rest))) or 1.0
        mask = rest > max(s.least_difference, s.sigmas * sigma)
        if s.opening >= 2:
            mask = opened(mask)
        moved, _, _ = blob_statistics(mask, s.least_blob)
        if moved >= s.disturbed_area:
            self.background = now.copy()
            return 0.0, True
        rate = s.active_rate if moved > 0 else s.idle_rate
        self.background += rate * (now - self.background)
        return moved, False


class MotionScorers:
    """Scorers that take one frame each at a time, all with the same settings and frames of one size: the scores of MotionScorer, worked out together. The first ones of them may go on alone."""

    def __init__(self, scorers: list[MotionScorer], shape: tuple[int, int]):
        self.settings, self.scorers, self.shape = scorers[0].settings, scorers, shape
        self.background = np.zeros((len(scorers), shape[0] * shape[1]), np.float32)
        self.mean, self.begun = np.zeros(len(scorers)), np.zeros(len(scorers), bool)
        for i, x in enumerate(scorers):
            if x.background is not None:
                self.background[i], self.mean[i], self.begun[i] = x.background.ravel(), x.mean, True

    def score(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and disturbances of one frame more of the first len(frames) scorers."""
        s, n = self.settings, len(frames)
        now, background = frames.reshape(n, -1), self.background[:n]
        mean = now.mean(axis=1).astype(np.float64)
        diff = np.abs(now - background)
        shift = np.median(diff, axis=1)
        before = np.where(self.mean[:n] == 0, mean, self.mean[:n])
        self.mean[:n] = mean
        fresh = ~self.begun[:n]
        disturbed = ~fresh & ((shift >= s.disturbed_median) | (np.abs(mean - before) >= s.brightness_jump))
        rest = diff - shift[:, None]
        sigma = 1.4826 * np.median(np.abs(rest), axis=1).astype(np.float64)
        least = np.maximum(s.least_difference, s.sigmas * np.where(sigma == 0, 1.0, sigma)).astype(np.float32)
        mask = ((rest > least[:, None]) & ~(fresh | disturbed)[:, None]).reshape(n, *self.shape)
        moved, at = np.zeros(n), np.flatnonzero(mask.any(axis=(1, 2)))
        if len(at):
            some = mask[at]
            some = opened_all(some) if s.opening >= 2 else some
            moved[at] = blob_shares(some, s.least_blob)
        shaken = moved >= s.disturbed_area
        disturbed |= shaken & ~fresh
        moved[shaken] = 0.0
        anew = fresh | disturbed
        rate = np.where(moved > 0, s.active_rate, s.idle_rate).astype(np.float32)
        background += rate[:, None] * (now - background)
        background[anew] = now[anew]
        self.begun[:n] = True
        return moved, disturbed

    def leave(self, i: int) -> MotionScorer:
        """The scorer that goes on where this one stands."""
        self.scorers[i].background, self.scorers[i].mean = self.background[i].reshape(self.shape).copy(), float(self.mean[i])
        return self.scorers[i]


MotionScorer.together = MotionScorers


def opened_all(masks: np.ndarray) -> np.ndarray:
    """As opened, of stacked masks."""

    def shifted(m, fill, meet):
        p = np.pad(m, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
        out = meet(p[:, 1:-1, 1:-1], p[:, :-2, 1:-1])
        for x in (p[:, 2:, 1:-1], p[:, 1:-1, :-2], p[:, 1:-1, 2:]):
            meet(out, x, out=out)
        return out

    return shifted(shifted(masks, True, np.logical_and), False, np.logical_or)


def stacked_labels(masks: np.ndarray) -> np.ndarray:
    """blob_labels of stacked masks, with numbers of their own in each: the masks stand below each other, apart by an empty row."""
    n, h, w = masks.shape
    tall = np.zeros((n, h + 1, w), bool)
    tall[:, :h] = masks
    return blob_labels(tall.reshape(-1, w)).reshape(n, h + 1, w)[:, :h]


def blob_shares(masks: np.ndarray, least_ratio: float) -> np.ndarray:
    """The first of blob_statistics, of stacked masks."""
    n, h, w = masks.shape
    label = stacked_labels(masks)
    which = np.nonzero(masks)[0]
    if not len(which):
        return np.zeros(n)
    part, first, area = np.unique(label[masks], return_index=True, return_counts=True)
    good = area >= max(1, int(least_ratio * h * w))
    return np.bincount(which[first[good]], area[good], n) / (h * w)


#: Arrow types of what scorers give.
TYPES = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def scored(frames: DataFrame, make: Callable[..., object], columns: str, keys: tuple[str, ...] = ("stream_id",), given: str | None = None, look: Look = Look()) -> DataFrame:
    """frames (keys, frame_index, height, width, pixels array<float>, or what `look` makes ready) -> keys, frame_index and what a scorer's score(frame) gives, named and typed by `columns`. Each group of the keys gets a
    scorer of its own, which `make` makes (from the group's value of the column `given`, if named). A frame without pixels is stepped over; MOST_FAILURES of them in a row end their group.

    Where the scorer's class has `together`, the groups of a batch are scored side by side, a frame of each at a time; else one after the other."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (group, scorer, frames failed) of the group at the end of the piece before
        for batch in batches:
            for piece in pieces(batch):
                got, last = part(piece, last)
                yield got

    def part(piece: pa.RecordBatch, last):
        own = list(zip(*(piece.column(k).to_pylist() for k in keys)))
        found = list(stacks(piece, look))
        stack, place = np.full(len(own), -1), np.zeros(len(own), np.int64)
        for k, (rows, _) in enumerate(found):
            stack[rows], place[rows] = k, np.arange(len(rows))
        makes = piece.column(given).to_pylist() if given else None
        first = [i for i in range(len(own)) if not i or own[i] != own[i - 1]]
        groups: dict = {}
        out = [np.zeros(len(own), object) for _ in names]
        taken = []
        for a, b in zip(first, [*first[1:], len(own)]):
            scorer, failed = last[1:] if last and last[0] == own[a] else (make(makes[a]) if given else make(), 0)
            at = np.arange(a, b)
            if failed or (stack[a:b] < 0).any():
                at, failed = readable(stack[a:b] >= 0, failed)
                at = at + a
            if len(at):
                kind = stack[at[0]]
                if (stack[at] != kind).any():
                    raise ValueError(f"frames of {own[a]!r} are not of one size")
                groups.setdefault((kind, str(makes[a]) if given else None), []).append((scorer, at))
                taken.append(at)
            last = (own[a], scorer, failed)
        for (kind, _), many in groups.items():
            levels = found[kind][1]
            many.sort(key=lambda x: -len(x[1]))
            if not hasattr(many[0][0], "together"):
                for scorer, at in many:
                    for i in at:
                        for column, v in zip(out, scorer.score(levels[place[i]])):
                            column[i] = v
                continue
            side = type(many[0][0]).together([x for x, _ in many], levels.shape[1:])
            size = np.array([len(at) for _, at in many])
            for k in range(size[0]):
                rows = np.array([at[k] for _, at in many[: np.searchsorted(-size, -k)]])
                for column, v in zip(out, side.score(levels[place[rows]])):
                    column[rows] = v
            for i, (scorer, _) in enumerate(many):
                if scorer is last[1]:
                    side.leave(i)
        rows = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        at = pa.array(rows, pa.int64())
        new = [pa.array(column[rows].tolist(), TYPES[kind]) for column, kind in zip(out, kinds)]
        return pa.RecordBatch.from_arrays([*(piece.column(k).take(at) for k in keys), piece.column("frame_index").take(at).cast(pa.int64()), *new], [*keys, "frame_index", *names]), last

    more = [given] if given else []
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since rows say little of the work there is to them
    rows = frames.select(*keys, "frame_index", *look.columns(frames.columns), *more).repartition(n, *keys).sortWithinPartitions(*keys, "frame_index")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema)
    return rows.mapInArrow(run, f"{types}, frame_index long, {columns}")


def readable(ok: np.ndarray, failed: int) -> tuple[np.ndarray, int]:
    """Which of a group's next frames are scored, by whether they can be read and how many failed before; and how many have failed then."""
    at = []
    for i, good in enumerate(ok.tolist()):
        if failed >= MOST_FAILURES:
            break
        failed = 0 if good else failed + 1
        if good:
            at.append(i)
    return np.array(at, np.int64), failed


def motion_trace(frames: DataFrame, settings: MotionSettings = MotionSettings(), keys: tuple[str, ...] = ("stream_id",), look: Look = Look(), means: DataFrame | None = None) -> DataFrame:
    """frames -> trace (keys, frame_index, score, disturbed). With the mean grey level of each frame (`mean`, see prepare.prepared; or apart in `means`, see prepare.means), every recording is cut where it can be, see in_stretches."""
    if "mean" not in frames.columns and means is None:
        return scored(frames, lambda: MotionScorer(settings), "score double, disturbed boolean", keys, look=look)
    found = scored(in_stretches(frames, settings, keys, means=means), lambda: MotionScorer(settings), "score double, disturbed boolean", (*keys, "stretch"), look=look)
    # The first frame of a stretch is the jump itself: a disturbed one.
    return found.select(*keys, "frame_index", "score", (F.col("disturbed") | (F.col("frame_index") == F.col("stretch"))).alias("disturbed"))


def in_stretches(frames: DataFrame, settings: MotionSettings, keys: tuple[str, ...], most: int = 1_000_000, means: DataFrame | None = None) -> DataFrame:
    """frames (with mean, or with `means` apart) with `stretch`, the frame at which scoring starts anew: whatever the background was, a jump in brightness replaces it, and the jump follows from two means alone, so that stretches between jumps
    are scored apart and give the scores of the whole walk. -1 before the first jump. `most` is how many frames' numbers are broadcast."""
    order = Window.partitionBy(*keys).orderBy("frame_index")
    before = F.lag("mean").over(order)
    # A mean of 0 counts as none.
    jump = F.coalesce((before != 0) & (F.abs(F.col("mean") - before) >= settings.brightness_jump), F.lit(False))
    means = (frames if means is None else means).where("mean is not null").select(*keys, "frame_index", "mean").withColumn("jump", jump)
    means = means.withColumn("stretch", F.last(F.when(F.col("jump"), F.col("frame_index")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    jumps = means.where("stretch is not null").select(*keys, "frame_index", "stretch")
    n = jumps.count()
    found = frames.join(F.broadcast(jumps) if n <= most else jumps, [*keys, "frame_index"], "left") if n else frames.withColumn("stretch", F.lit(None).cast("long"))
    return found.withColumn("stretch", F.coalesce("stretch", F.lit(-1).cast("long")))
