"""Stateful scoring of liquid in a region of grey frames: streams and drops by the shape of what moves."""

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from tidemark.operators.pixels import scored, stacked_labels
from tidemark.operators.prepare import Look
from tidemark.operators.settings import LiquidSettings


class Liquid(NamedTuple):
    """What one frame shows; liquid is None on the first frame, where only the activity can tell."""

    activity: float = 0.0
    outlet: float = 0.0
    liquid: bool | None = None
    contrast: float = 0.0
    noise: float = 0.0
    disturbed: bool = False


def opened_by_square(mask: np.ndarray, side: int) -> np.ndarray:
    """What squares of the given side fit into; the mask as it is for sides below 2 or above its own."""
    if side < 2 or side > min(mask.shape):
        return mask
    fits = np.lib.stride_tricks.sliding_window_view(mask, (side, side)).all(axis=(2, 3))
    out = np.zeros_like(mask)
    for i in range(side):
        for j in range(side):
            out[i : i + fits.shape[0], j : j + fits.shape[1]] |= fits
    return out


def liquid_pixels(mask: np.ndarray, settings: LiquidSettings) -> np.ndarray:
    """Pixels of the 8-connected parts that are narrow, and tall or of a drop's size."""
    return liquid_pixels_all(mask[None], settings)[0] if mask.any() else mask


class LiquidScorer:
    """Frames are the guard region; `inner` (x, y, w, h) is the region of interest in it, and what changes around it disturbs."""

    def __init__(self, inner: tuple[int, int, int, int], settings: LiquidSettings = LiquidSettings()):
        x, y, w, h = inner
        self.inner, self.settings, self.background = (slice(y, y + h), slice(x, x + w)), settings, None

    def score(self, frame: np.ndarray) -> Liquid:
        s, now = self.settings, frame.astype(np.float32)
        if self.background is None:
            self.background = now
            return Liquid()
        diff = np.abs(now - self.background)
        shift = float(np.median(diff))
        if shift >= s.disturbed_median:
            self.background = now
            return Liquid(disturbed=True)
        rest = diff - shift
        sigma = 1.4826 * float(np.median(np.abs(rest))) or 1.0
        mask = opened_by_square(rest > max(s.least_difference, s.sigmas * sigma), s.opening)
        around = np.ones_like(mask)
        around[self.inner] = False
        disturbed = bool(around.any()) and float(mask[around].mean()) >= s.disturbed_outside
        kept = liquid_pixels(mask[self.inner], s)
        wet = kept.any(axis=1)
        band = max(1, round(len(wet) * s.outlet_band))
        # The activity of a frame disturbed from outside stays.
        activity = float(wet.mean())
        if disturbed:
            self.background = now
        elif activity == 0:
            self.background = self.background + np.float32(s.idle_rate) * (now - self.background)
        contrast = float(rest[self.inner][kept].mean()) if kept.any() else 0.0
        return Liquid(activity, float(wet[:band].sum()) / band, bool(kept.any()), contrast, sigma, disturbed)


class LiquidScorers:
    """Scorers that take one frame each at a time, all with the same region, settings and frames of one size: what LiquidScorer finds, worked out together. The first ones of them may go on alone."""

    def __init__(self, scorers: list[LiquidScorer], shape: tuple[int, int]):
        self.settings, self.inner, self.scorers, self.shape = scorers[0].settings, scorers[0].inner, scorers, shape
        self.background, self.begun = np.zeros((len(scorers), shape[0] * shape[1]), np.float32), np.zeros(len(scorers), bool)
        for i, x in enumerate(scorers):
            if x.background is not None:
                self.background[i], self.begun[i] = x.background.ravel(), True
        self.around = np.ones(shape, bool)
        self.around[self.inner] = False

    def score(self, frames: np.ndarray) -> Liquid:
        """What one frame more of the first len(frames) scorers shows, as arrays."""
        s, n = self.settings, len(frames)
        now, background = frames.reshape(n, -1), self.background[:n]
        diff = np.abs(now - background)
        shift = np.median(diff, axis=1)
        fresh = ~self.begun[:n]
        off = ~fresh & (shift >= s.disturbed_median)
        rest = diff - shift[:, None]
        sigma = 1.4826 * np.median(np.abs(rest), axis=1).astype(np.float64)
        sigma = np.where(sigma == 0, 1.0, sigma)
        least = np.maximum(s.least_difference, s.sigmas * sigma).astype(np.float32)
        rest = rest.reshape(n, *self.shape)
        seen = ~(fresh | off)
        mask = opened_by_squares((rest > least[:, None, None]) & seen[:, None, None], s.opening)
        beside = seen & bool(self.around.any()) & (mask[:, self.around].sum(axis=1) / max(1, self.around.sum()) >= s.disturbed_outside)
        inner = (slice(None), *self.inner)
        kept = np.zeros(mask[inner].shape, bool)
        at = np.flatnonzero(mask[inner].any(axis=(1, 2)))
        if len(at):
            kept[at] = liquid_pixels_all(mask[inner][at], s)
        wet = kept.any(axis=2)
        band = max(1, round(wet.shape[1] * s.outlet_band))
        # The activity of a frame disturbed from outside stays.
        activity = wet.sum(axis=1) / wet.shape[1]
        found = wet.any(axis=1)
        contrast, inside = np.zeros(n), rest[inner]
        for i in np.flatnonzero(found):
            contrast[i] = inside[i][kept[i]].mean()
        calm = np.flatnonzero(seen & ~beside & (activity == 0))
        background[calm] = background[calm] + np.float32(s.idle_rate) * (now[calm] - background[calm])
        anew = fresh | off | beside
        background[anew] = now[anew]
        self.begun[:n] = True
        liquid = np.where(fresh, None, found)
        return Liquid(activity, wet[:, :band].sum(axis=1) / band, np.where(off, None, liquid), contrast, np.where(seen, sigma, 0.0), off | beside)

    def leave(self, i: int) -> LiquidScorer:
        """The scorer that goes on where this one stands."""
        self.scorers[i].background = self.background[i].reshape(self.shape).copy()
        return self.scorers[i]


LiquidScorer.together = LiquidScorers


def opened_by_squares(masks: np.ndarray, side: int) -> np.ndarray:
    """As opened_by_square, of stacked masks."""
    if side < 2 or side > min(masks.shape[1:]):
        return masks
    h, w = (n - side + 1 for n in masks.shape[1:])
    fits = np.ones((len(masks), h, w), bool)
    for i in range(side):
        for j in range(side):
            fits &= masks[:, i : i + h, j : j + w]
    out = np.zeros_like(masks)
    for i in range(side):
        for j in range(side):
            out[:, i : i + h, j : j + w] |= fits
    return out


def liquid_pixels_all(masks: np.ndarray, settings: LiquidSettings) -> np.ndarray:
    """As liquid_pixels, of stacked masks, none of them empty."""
    height, width = masks.shape[1:]
    which, rows, columns = np.nonzero(masks)
    _, part = np.unique(stacked_labels(masks)[which, rows, columns], return_inverse=True)
    area, n = np.bincount(part), part.max() + 1
    top, bottom, left, right = np.full(n, height), np.full(n, -1), np.full(n, width), np.full(n, -1)
    for edge, at, take in ((top, rows, np.minimum), (bottom, rows, np.maximum), (left, columns, np.minimum), (right, columns, np.maximum)):
        take.at(edge, part, at)
    tall, wide = bottom - top + 1, right - left + 1
    is_stream = tall >= settings.least_stream_height * height
    is_drop = (area >= settings.least_drop_area) & (tall >= settings.least_drop_height)
    good = ((wide <= settings.most_width * width) & (is_stream | is_drop))[part]
    out = np.zeros_like(masks)
    out[which[good], rows[good], columns[good]] = True
    return out


def liquid_trace(frames: DataFrame, inner: tuple[int, int, int, int] | str, settings: LiquidSettings = LiquidSettings(), look: Look = Look()) -> DataFrame:
    """frames (stream_id, frame_index, height, width, pixels array<float>) -> (stream_id, frame_index, activity, outlet, liquid, contrast, noise, disturbed), what flow.phases takes. `inner` is the region of all streams, or the column that has each one's."""
    columns = "activity double, outlet double, liquid boolean, contrast double, noise double, disturbed boolean"
    if isinstance(inner, str):
        return scored(frames, lambda own: LiquidScorer(tuple(own), settings), columns, given=inner, look=look)
    return scored(frames, lambda: LiquidScorer(inner, settings), columns, look=look)
