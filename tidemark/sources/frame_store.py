"""Frames stored by stretch of time, so that a pass reads the stretches it looks at and no others.

A store is a table of frames partitioned by (s_part, t_part): a hash of the stream, and its frame number by SPAN. Windows meet frames through these two columns, from which the scan leaves out, when it runs, all
partitions that no window touches (dynamic partition pruning)."""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.stored import new_path, stored

#: Frames of a stretch, and parts into which streams fall. Streams are as many as files; folders are STREAM_PARTS times the stretches of the longest recording.
SPAN, STREAM_PARTS = 4096, 16
#: Windows by stretch that are broadcast at most.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class FrameStore:
    spark: SparkSession
    path: str
    span: int = SPAN
    stream_parts: int = STREAM_PARTS
    #: Known to whoever wrote the store; a store that is opened by its path alone must have a frame.
    schema: StructType | None = None
    #: How frames that are stored as codes are drawn where they are scored (see prepare.Look).
    decode: Callable | None = None

    def frames(self) -> DataFrame:
        """stream_id, frame_index, height, width, pixels (or n_channels and data, or code), readable, s_part, t_part."""
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(self.path)

    def stream_part(self, stream: Column) -> Column:
        return F.pmod(F.xxhash64(stream), F.lit(self.stream_parts)).cast("int")

    def time_part(self, frame: Column) -> Column:
        return F.floor(frame / self.span).cast("int")

    def near(self, windows: DataFrame, *more: str) -> DataFrame:
        """The frames of windows (stream_id, window_id, w_first, w_last: frame numbers, ends included), with window_id, w_first and the named columns of the windows."""
        parts = F.sequence(self.time_part(F.col("w_first")), self.time_part(F.col("w_last")))
        wins = windows.where(F.col("w_first") <= F.col("w_last")).select("stream_id", "window_id", "w_first", "w_last", *more, self.stream_part(F.col("stream_id")).alias("s_part"), F.explode(parts).alias("t_part"))
        wins = stored(wins, "near")
        n = wins.count()
        frames = self.frames()
        if n > BROADCAST_ROWS:  # the touched partitions alone are few, and prune as well; the windows come by a shuffle
            touched = wins.where(F.col("w_first") <= F.col("w_last")).select("s_part", "t_part").distinct()
            frames = frames.join(F.broadcast(touched), ["s_part", "t_part"], "left_semi")
        else:
            wins = F.broadcast(wins.where(F.col("w_first") <= F.col("w_last")))
        found = frames.join(wins, ["s_part", "t_part", "stream_id"]).where(F.col("frame_index").between(F.col("w_first"), F.col("w_last")))
        return found.drop("s_part", "t_part", "w_last")

    def until(self, frame: int) -> DataFrame:
        """The stretches that begin before that frame number."""
        return self.frames().where(F.col("t_part") <= (max(0, frame - 1)) // self.span)


def written(frames: DataFrame, path: str | None = None, span: int = SPAN, stream_parts: int = STREAM_PARTS, decode: Callable | None = None) -> FrameStore:
    """Stores frames (stream_id, frame_index, height, width, and pixels, or n_channels and data, or code with what decodes it). A frame without pixels is kept as one that cannot be read."""
    spark = frames.sparkSession
    if path is None:
        path = new_path(spark, "frames")
    store = FrameStore(spark, path, span, stream_parts, decode=decode)
    rows = frames.withColumns({"readable": F.col("code" if decode else "data" if "data" in frames.columns else "pixels").isNotNull(), "s_part": store.stream_part(F.col("stream_id")), "t_part": store.time_part(F.col("frame_index"))})
    order = ["s_part", "t_part", "stream_id"]
    store = replace(store, schema=rows.schema)
    # By hash: a sort by ranges would first draw a sample, and so read all frames twice. A stretch of one stream lies in one file.
    rows.repartition(*order).sortWithinPartitions(*order, "frame_index").write.partitionBy("s_part", "t_part").parquet(path)
    return store
