"""What is known of a recording before it is scored: frame rate, codec, length; and records that lost their files or grew old."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sampling import valid_fps

#: Frames that are looked at for the rate, and the least of them with a usable stamp.
RATE_FRAMES, LEAST_STAMPS = 60, 5


def estimated_rates(stamps: DataFrame) -> DataFrame:
    """(stream_id, frame, pts_ms) -> stream_id, fps: from the positive stamps of the first frames; null where they are too few, do not grow or give an unlikely rate."""
    usable = (F.col("pts_ms") > 0) & ~F.isnan("pts_ms") & (F.col("pts_ms") != float("inf"))
    stamp = F.when(usable, F.struct("frame", "pts_ms"))
    ends = stamps.where(F.col("frame") < RATE_FRAMES).groupBy("stream_id").agg(F.count(stamp).alias("k"), F.min(stamp)["pts_ms"].alias("first"), F.max(stamp)["pts_ms"].alias("last"))
    rate = (F.col("k") - 1) / ((F.col("last") - F.col("first")) / 1000)
    return ends.select("stream_id", F.when((F.col("k") >= LEAST_STAMPS) & (F.col("last") > F.col("first")) & valid_fps(rate), rate).alias("fps"))


def codec_text(code: Column) -> Column:
    """The four bytes of a codec's code, lowest first, without those that do not print; `unknown` if nothing is left."""
    code = code.cast("long")
    text = F.concat(*[F.char(F.shiftright(code, n).bitwiseAND(F.lit(255))) for n in (0, 8, 16, 24)])
    text = F.trim(F.regexp_replace(text, r"[^\x20-\x7E\xA1-\xAC\xAE-\xFF]", ""))
    return F.when((code > 0) & (text != ""), text).otherwise("unknown")


def with_duration(files: DataFrame) -> DataFrame:
    """files (frame_count, fps, end_ms) with duration and duration_source: by frames, else by the last stamp, else unknown."""
    by_frames = F.when(F.col("frame_count") > 0, F.col("frame_count") / F.col("fps"))
    by_stamp = F.when((F.col("end_ms") > 0) & ~F.isnan("end_ms") & (F.col("end_ms") != float("inf")), F.col("end_ms") / 1000)
    source = F.when(by_frames.isNotNull(), "frame_count").when(by_stamp.isNotNull(), "timestamps").otherwise("unknown")
    return files.withColumns({"duration": F.coalesce(by_frames, by_stamp), "duration_source": source})


def orphans(files: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Files without a record."""
    return files.join(records.select(key), key, "left_anti")


def looked_up(keys: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """keys with their record's columns and `found`; a key without a record keeps its row."""
    return keys.join(records.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def expired(records: DataFrame, used_at: str, now: Column, hours: float) -> DataFrame:
    """Records that were last used before now - hours."""
    return records.where(F.col(used_at) < now - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours % 1 * 60))))
