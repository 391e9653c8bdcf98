"""The frames at which events begin and end, from stored frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sampling import MOST_FAILURES, frame_index_at
from tidemark.sources.frame_store import FrameStore
from tidemark.sources.stored import stored

KEYS = ["stream_id", "number", "boundary"]


def boundary_frames(events: DataFrame, files: DataFrame, store: FrameStore, pixels: bool = True) -> DataFrame:
    """events (stream_id, number, start, end) of files (stream_id, fps, n) -> for each start and end the frame at that time (asked), or the first readable one of those after it that a look tries (shown, null if none),
    with its pixels if wanted. Only stretches of the store that hold such frames are read, and their pixels only where a frame is shown."""
    both = F.explode(F.array(*(F.struct(F.lit(name).alias("boundary"), F.col(name).alias("t")) for name in ("start", "end"))))
    at = events.select("stream_id", "number", both.alias("b")).select("stream_id", "number", "b.*").join(files.select("stream_id", "fps", "n"), "stream_id")
    at = at.select(*KEYS, frame_index_at(F.col("t"), F.col("fps"), F.col("n")).cast("long").alias("asked"))
    at = stored(at.withColumn("window_id", F.xxhash64(*KEYS)), "boundaries")
    looks = at.select("stream_id", "window_id", F.col("asked").alias("w_first"), (F.col("asked") + MOST_FAILURES - 1).alias("w_last"))
    found = store.near(looks).where("readable").groupBy("stream_id", "window_id").agg(F.min("frame_index").alias("shown"))
    found = at.join(found, ["stream_id", "window_id"], "left")
    if not pixels:
        return found.drop("window_id")
    found = stored(found, "shown")
    own = store.near(found.select("stream_id", "window_id", F.col("shown").alias("w_first"), F.col("shown").alias("w_last"))).drop("stream_id", "frame_index", "readable", "w_first")
    return found.join(own, "window_id", "left").drop("window_id")
