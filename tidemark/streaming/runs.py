"""Runs of a condition on a stream, with typed state and timers in event time: a run ends when the condition does, or when its stream falls silent.

State is a row of numbers, not an object, so that it outlives changes of this code. It needs the RocksDB state store."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "stream_id long, start timestamp, end timestamp, ended_by string"
STATE = "begun long, last long"


class RunProcessor(StatefulProcessor):
    """Times are microseconds. State: when the run in progress began (null outside one), and the last sample."""

    def __init__(self, required: float, silence: float):
        self.required, self.silence = round(required * 1e6), round(silence * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun, last = self.state.get() if self.state.exists() else (None, None)
        ended = []
        for pdf in rows:
            pdf = pdf.sort_values("us", kind="stable")
            for us, on in zip(pdf["us"].tolist(), pdf["on"].tolist()):
                if last is not None and us < last:
                    raise ValueError(f"samples of stream {key[0]} arrive out of order")
                if last is not None and us - last > self.silence:  # the timer has not come yet
                    ended += self.ended(key, begun, last, "silence")
                    begun = None
                if on and begun is None:
                    begun = us
                elif not on and begun is not None:
                    ended += self.ended(key, begun, last, "condition")
                    begun = None
                last = us
        if last is not None:
            self.state.update((begun, last))
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(-(-(last + self.silence) // 1000))
        yield self.rows(ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begun, last = self.state.get() if self.state.exists() else (None, None)
        self.state.clear()
        yield self.rows(self.ended(key, begun, last, "silence"))

    def ended(self, key: tuple, begun: int | None, last: int | None, by: str) -> list[tuple]:
        return [(key[0], begun, last, by)] if begun is not None and last - begun >= self.required else []

    def rows(self, ended: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(ended, columns=["stream_id", "start", "end", "ended_by"])
        return found.assign(**{c: pd.to_datetime(found[c].astype("int64"), unit="us", utc=True) for c in ("start", "end")})

    def close(self) -> None:
        pass


def run_stream(samples: DataFrame, condition: str, required: float, silence: float, delay: str = "0 seconds") -> DataFrame:
    """samples (stream_id, at timestamp, and a boolean), in order of time within a stream -> runs that lasted `required` seconds at least: stream_id, start, end (of the last sample in it), ended_by (condition or silence).

    A stream without a sample for more than `silence` seconds of event time is over: its run ends, its state goes. `delay` is how late samples of other streams may be."""
    rows = samples.select("stream_id", "at", F.unix_micros("at").alias("us"), F.coalesce(F.col(condition), F.lit(False)).alias("on")).withWatermark("at", delay)
    return rows.groupBy("stream_id").transformWithStateInPandas(RunProcessor(required, silence), OUTPUT, "append", "EventTime")
