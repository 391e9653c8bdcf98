"""Second pass: only the neighbourhood of each candidate is read again, densely."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.stats import clamp
from tidemark.operators import intervals
from tidemark.sources.stored import stored

KEYS = ["stream_id", "window_id"]


def windows_within(candidates: DataFrame, ends: DataFrame, pre: Column, post: Column, *more: str) -> DataFrame:
    """Candidates (stream_id, start, end), numbered by time, with the window around each, inside the stream; ends: (stream_id, first, last) and what pre and post are made of."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("start", "end"))
    rows = candidates.withColumn("window_id", rank).join(ends, "stream_id")
    return rows.select(*KEYS, F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.greatest("first", F.col("start") - pre).alias("w_start"), F.least("last", F.col("end") + post).alias("w_end"), *more)


def windows(candidates: DataFrame, trace: DataFrame, roll: float) -> DataFrame:
    ends = trace.groupBy("stream_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return windows_within(candidates, ends, F.lit(roll), F.lit(roll))


def inside(wins: DataFrame, samples: DataFrame, bucket: float = 600.0, first_frame: bool = False) -> DataFrame:
    """samples (stream_id, t, ...) with the window_id of each window they lie in. The join is on stream and stretch of time, so that a window meets the samples near it only.

    With first_frame, frames are taken from that of the window's start on, by whole frames (samples have frame_index and fps), and w_first is its index."""
    if first_frame:
        wins = wins.join(samples.select("stream_id", "fps").distinct(), "stream_id").withColumns({"w_first": F.floor(F.col("w_start") * F.col("fps")), "w_start": F.floor(F.col("w_start") * F.col("fps")) / F.col("fps")}).drop("fps")
    else:
        wins = wins.withColumn("w_first", F.lit(None).cast("long"))
    part = F.explode(F.sequence(F.floor(F.col("w_start") / bucket), F.floor(F.col("w_end") / bucket)))
    near = wins.select(*KEYS, "w_start", "w_end", "w_first", part.alias("_part"))
    rows = samples.withColumn("_part", F.floor(F.col("t") / bucket)).join(near, ["stream_id", "_part"])
    return rows.where(F.col("t").between(F.col("w_start"), F.col("w_end"))).drop("_part", "w_start", "w_end")


def refined(wins: DataFrame, dense: DataFrame, floor: float, gap: float, least: float) -> DataFrame:
    """Refined events of windows (stored), with their evidence, from dense samples (stream_id, window_id, t, seq, score, disturbed); windows of fewer than 3 samples keep their candidate at confidence .35.

    Samples inside windows are stored with their levels, so that both are worked out once."""
    order = Window.partitionBy(*KEYS).orderBy("t", "seq")
    dense = stats.with_thresholds(stats.with_noise(dense.select(*KEYS, "t", "seq", "score", "disturbed"), KEYS, 0.25), 4.0, 2.0, floor)
    dense = stored(dense.withColumn("step", F.col("t") - F.lag("t").over(order)).drop("base", "sigma"), "inside")
    # The upper of the two middle steps; one row a window.
    levels = dense.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("step")).alias("steps"), F.avg(F.col("disturbed").cast("double")).alias("disturbed_ratio"), F.max("score").alias("most"), (F.sum(F.bround(F.col("score") * 100).cast("long")) / 100.0 / F.count("score")).alias("average"),
        F.first("n").alias("n"), F.first("enter").alias("enter"),
    )
    levels = levels.withColumn("spacing", F.get("steps", F.floor(F.size("steps") / 2).cast("int"))).drop("steps")
    found = intervals.active_intervals(dense, KEYS, dense=True)
    found = intervals.long_enough(intervals.bridged(found, KEYS, gap), least)
    touching = found.join(wins, KEYS).where((F.col("start") <= F.col("c_end")) & (F.col("c_start") <= F.col("end"))).join(levels, KEYS)
    touching = touching.select(*KEYS, "start", "end", "w_start", "w_end", "enter", "spacing", "n", "disturbed_ratio")
    rows = touching.join(dense.select(*KEYS, "t", "score"), KEYS, "left")
    score = F.when(F.col("t").between(F.col("start"), F.col("end")), F.col("score"))
    evidence = rows.groupBy(*touching.columns).agg(
        F.coalesce(F.max(score), F.lit(0.0)).alias("peak"),
        F.coalesce(F.sum(F.bround(score * 100).cast("long")) / 100.0 / F.count(score), F.lit(0.0)).alias("mean"),
        F.count(score).alias("held"),
        F.count_if(score >= F.col("enter")).alias("active"),
    )
    near = F.coalesce("spacing", F.lit(0.0))
    evidence = evidence.withColumn("clipped_start", F.col("start") - F.col("w_start") <= near).withColumn("clipped_end", F.col("w_end") - F.col("end") <= near)
    strength = clamp((F.col("peak") - F.col("enter")) / F.greatest("enter", F.lit(1e-6)), 0.0, 1.0)
    share = F.col("active") / F.greatest("held", F.lit(1))
    sure = 0.45 + 0.30 * strength + 0.25 * share - F.when(F.col("clipped_start") | F.col("clipped_end"), 0.15).otherwise(0.0) - 0.30 * F.col("disturbed_ratio")
    evidence = evidence.where("n >= 3").withColumn("confidence", clamp(sure, 0.05, 0.99)).withColumnRenamed("n", "samples")
    few = wins.join(levels, KEYS, "left").where("coalesce(n, 0) < 3")
    columns = [*KEYS, "start", "end", "peak", "mean", "enter", "samples", "active", "disturbed_ratio", "clipped_start", "clipped_end", "confidence"]
    kept = few.selectExpr(*KEYS, "c_start as start", "c_end as end", "coalesce(most, 0D) as peak", "coalesce(average, 0D) as mean", "0D as enter", "coalesce(n, 0L) as samples", "0L as active", "coalesce(disturbed_ratio, 0D) as disturbed_ratio", "true as clipped_start", "true as clipped_end", "0.35D as confidence")
    return evidence.select(*columns).union(kept.select(*columns))


def merged(events: DataFrame) -> DataFrame:
    """Overlapping refined events of a stream as one. Means are folded in pairs, and the surer side's threshold stays (the earlier one's on ties)."""
    rows = intervals.with_islands(events, ["stream_id"], 0.0)
    part = F.struct("start", "end", "window_id", "peak", "mean", "enter", "samples", "active", "disturbed_ratio", "clipped_start", "clipped_end", "confidence")
    lists = rows.groupBy("stream_id", "island").agg(F.array_sort(F.collect_list(part)).alias("l"))

    def fold(a, b):
        return F.struct(
            a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"), a["window_id"].alias("window_id"), F.greatest(a["peak"], b["peak"]).alias("peak"), ((a["mean"] + b["mean"]) / 2).alias("mean"),
            F.when(b["confidence"] > a["confidence"], b["enter"]).otherwise(a["enter"]).alias("enter"), (a["samples"] + b["samples"]).alias("samples"), (a["active"] + b["active"]).alias("active"),
            F.greatest(a["disturbed_ratio"], b["disturbed_ratio"]).alias("disturbed_ratio"), a["clipped_start"].alias("clipped_start"), b["clipped_end"].alias("clipped_end"), F.greatest(a["confidence"], b["confidence"]).alias("confidence"),
        )

    one = F.aggregate(F.slice("l", F.lit(2), F.size("l")), F.col("l")[0], fold)
    return lists.select("stream_id", one.alias("e")).select("stream_id", *[F.col(f"e.{c}").alias(c) for c in ("start", "end", "peak", "mean", "enter", "samples", "active", "disturbed_ratio", "clipped_start", "clipped_end", "confidence")])
