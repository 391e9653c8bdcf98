"""Timing of one flow a stream as its samples arrive: the rules of operators.flow, one sample after the other, with what they need in state."""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = "start double, end double, end_confirmed boolean, frames long, with_liquid long, disturbed long, timed long, timed_with_liquid long, start_margin double, contrast double, noise double, breaks long"


@dataclass
class Mean:
    total: float = 0.0
    n: int = 0

    def add(self, x: float) -> None:
        self.total, self.n = self.total + x, self.n + 1

    def value(self) -> float:
        return self.total / self.n if self.n else 0.0


class FlowMachine:
    def __init__(self, threshold: float, start_hold: float, end_hold: float, least_break: float):
        self.threshold, self.start_hold, self.end_hold, self.least_break = threshold, start_hold, end_hold, least_break
        self.start = self.end = self.at_outlet_from = self.absent_from = None
        self.done = False
        self.frames = self.with_liquid = self.disturbed = self.timed = self.trailing = self.timed_with_liquid = self.breaks = 0
        self.margin, self.contrast, self.noise = Mean(), Mean(), Mean()
        self.last = float("-inf")

    def step(self, t: float, activity: float, outlet: float, liquid: bool | None, contrast: float, noise: float, disturbed: bool) -> bool:
        """Takes a sample; True when it confirms the end. Samples after that change nothing."""
        if self.done:
            return False
        present = not disturbed and (activity >= self.threshold if liquid is None or pd.isna(liquid) else bool(liquid))
        at_outlet = not disturbed and outlet >= self.threshold
        self.frames, self.with_liquid, self.disturbed = self.frames + 1, self.with_liquid + present, self.disturbed + bool(disturbed)
        self.noise.add(noise)
        if present and contrast != 0:
            self.contrast.add(contrast)
        if self.start is None:
            self._before(t, outlet, at_outlet, disturbed)
        else:
            self._after(t, present, disturbed)
        return self.done

    def _before(self, t: float, outlet: float, at_outlet: bool, disturbed: bool) -> None:
        if at_outlet:
            self.margin.add(outlet)
        elif not disturbed:
            self.margin = Mean()
        self.at_outlet_from = (t if self.at_outlet_from is None else self.at_outlet_from) if at_outlet else None
        if at_outlet and t - self.at_outlet_from >= self.start_hold:
            self.start, self.end = self.at_outlet_from, t

    def _after(self, t: float, present: bool, disturbed: bool) -> None:
        if present:
            self.breaks += self.absent_from is not None and t - self.absent_from >= self.least_break
            self.end, self.trailing, self.timed_with_liquid = t, 0, self.timed_with_liquid + 1
        self.timed += not disturbed
        absent = not disturbed and not present
        self.trailing += absent
        self.absent_from = (t if self.absent_from is None else self.absent_from) if absent else None
        self.done = absent and t - self.absent_from >= self.end_hold

    def row(self) -> tuple:
        margin = self.margin.value() / self.threshold - 1 if self.start is not None and self.margin.n else 0.0
        return (self.start, self.end, self.done, self.frames, self.with_liquid, self.disturbed, self.timed - (self.trailing if self.done else 0), self.timed_with_liquid, margin, self.contrast.value(), self.noise.value(), self.breaks)


def flow_stream(samples: DataFrame, threshold: float, start_hold: float, end_hold: float, least_break: float) -> DataFrame:
    """One row a stream, as of flow.measurements, when the end of its flow is confirmed: samples (stream_id, t, seq, activity, outlet, liquid, contrast, noise, disturbed) in order of t within a stream."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else FlowMachine(threshold, start_hold, end_hold, least_break)
        found = []
        for pdf in batches:
            pdf = pdf.sort_values(["t", "seq"])
            if len(pdf) and pdf["t"].iloc[0] < machine.last:
                raise ValueError(f"samples of stream {key[0]} arrive out of order: {pdf['t'].iloc[0]} after {machine.last}")
            for values in zip(*(pdf[c] for c in ("t", "activity", "outlet", "liquid", "contrast", "noise", "disturbed"))):
                if machine.step(*values):
                    found.append((key[0], *machine.row()))
                machine.last = values[0]
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame(found, columns=["stream_id", *names])

    return samples.groupBy("stream_id").applyInPandasWithState(step, f"stream_id long, {COLUMNS}", "machine binary", "append", GroupStateTimeout.NoTimeout)
