"""Scorers and the persistence rule on streams: one scorer, or one running condition, a stream, kept in state."""

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.liquid import LiquidScorer, LiquidSettings
from tidemark.operators.pixels import MotionScorer, MotionSettings


def scored_stream(frames: DataFrame, make: Callable[[], object], columns: str) -> DataFrame:
    """As pixels.scored, for frames that arrive in order of frame_index within a stream. Arrow batches are scored one by one as they come; a frame older than its stream's last one is an error."""
    names = [c.split()[0] for c in columns.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scorer, last = pickle.loads(state.get[0]) if state.exists else (make(), -1)
        for pdf in batches:
            pdf = pdf.sort_values("frame_index")
            if len(pdf) and pdf["frame_index"].iloc[0] < last:
                raise ValueError(f"frames of stream {key[0]} arrive out of order: {pdf['frame_index'].iloc[0]} after {last}")
            found = [tuple(scorer.score(np.asarray(p, np.float32).reshape(h, w))) for p, h, w in zip(pdf["pixels"], pdf["height"], pdf["width"])]
            last = int(pdf["frame_index"].max()) if len(pdf) else last
            yield pd.concat([pd.DataFrame({"stream_id": key[0], "frame_index": pdf["frame_index"].to_numpy()}), pd.DataFrame(found, columns=names, dtype=object)], axis=1)
        state.update((pickle.dumps((scorer, last)),))

    return frames.groupBy("stream_id").applyInPandasWithState(step, f"stream_id long, frame_index long, {columns}", "scorer binary", "append", GroupStateTimeout.NoTimeout)


def motion_stream(frames: DataFrame, settings: MotionSettings = MotionSettings()) -> DataFrame:
    return scored_stream(frames, lambda: MotionScorer(settings), "score double, disturbed boolean")


def liquid_stream(frames: DataFrame, inner: tuple[int, int, int, int], settings: LiquidSettings = LiquidSettings()) -> DataFrame:
    return scored_stream(frames, lambda: LiquidScorer(inner, settings), "activity double, outlet double, liquid boolean, contrast double, noise double, disturbed boolean")


def persistent_stream(samples: DataFrame, condition: str, required: float) -> DataFrame:
    """As intervals.persistent, for samples (stream_id, t, seq and a boolean) that arrive in order of t within a stream: stream_id, t, seq, run_start, fires."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, last = state.get if state.exists else (None, float("-inf"))
        for pdf in batches:
            pdf, starts = pdf.sort_values(["t", "seq"]), []
            if len(pdf) and pdf["t"].iloc[0] < last:
                raise ValueError(f"samples of stream {key[0]} arrive out of order: {pdf['t'].iloc[0]} after {last}")
            for t, on in zip(pdf["t"], pdf[condition]):
                begun = (t if begun is None else begun) if on else None
                starts.append(begun)
                last = float(t)
            start = pd.Series(starts, dtype=float)
            fires = (pdf["t"].reset_index(drop=True) - start >= required).fillna(False)
            yield pd.DataFrame({"stream_id": key[0], "t": pdf["t"].to_numpy(), "seq": pdf["seq"].to_numpy(), "run_start": start, "fires": fires.astype(bool)})
        state.update((begun, last))

    return samples.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, t double, seq long, run_start double, fires boolean", "begun double, last double", "append", GroupStateTimeout.NoTimeout)
