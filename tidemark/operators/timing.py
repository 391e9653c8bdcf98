"""Whether one frame rate can describe a recording, from stamps at a few windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed limits of the verdict.
WINDOWS, WINDOW_FRAMES, LEAST_INTERVALS = 5, 40, 20
INTERVAL_TOLERANCE, MOST_IRREGULAR, DRIFT_TOLERANCE, BUDGET_MS = 0.5, 0.10, 0.15, 50.0


def window_starts(files: DataFrame) -> DataFrame:
    """(stream_id, n) -> stream_id, n, w_start: distinct starts, evenly spread over [0, n - WINDOW_FRAMES]."""
    last = F.greatest(F.lit(0), F.col("n") - WINDOW_FRAMES)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.bround(i * (last / (WINDOWS - 1))).cast("long")))
    return files.select("stream_id", "n", F.explode(starts).alias("w_start"))


def verified(windows: DataFrame) -> DataFrame:
    """windows (w_start, seek_ok, landed) of which the seek is known to have come near: accepted, finite, and within the window's frames."""
    near = ~F.isnan("landed") & (F.abs(F.col("landed") - F.col("w_start")) <= WINDOW_FRAMES)
    return windows.where(F.coalesce(F.col("seek_ok") & near, F.lit(False)))


def refusal_class(reason: Column) -> Column:
    """Which of the messages a refused recording gets: unverifiable, drift or variable rate; null for an accepted one."""
    return F.when(reason.isin("no_usable_timestamps", "unrepresentative_sample"), "unverifiable").when(reason == "timing_drift", "drift").when(~reason.isin("too_short_to_matter", "constant"), "variable_rate")


def intervals(stamps: DataFrame) -> DataFrame:
    """(stream_id, frame, pts_ms) -> the positive gaps inside each window: stream_id, n, w_start, gap; and the window's offset from frame / fps."""
    files = stamps.groupBy("stream_id").agg(F.count("*").alias("n"), F.min("pts_ms").alias("first"), F.max("pts_ms").alias("last"))
    starts = window_starts(files).join(files.select("stream_id", "first", "last"), "stream_id")
    # Stamps are cut once; a frame can be in several windows.
    rows = stamps.join(starts, "stream_id").where((F.col("frame") >= F.col("w_start")) & (F.col("frame") < F.col("w_start") + WINDOW_FRAMES))
    gap = F.col("pts_ms") - F.lag("pts_ms").over(Window.partitionBy("stream_id", "w_start").orderBy("frame"))
    offset = F.when(F.col("frame") == F.col("w_start"), F.col("pts_ms") - F.col("first") - F.col("frame") * ((F.col("last") - F.col("first")) / (F.col("n") - 1)))
    return rows.withColumns({"gap": gap, "offset": offset})


def verdicts(stamps: DataFrame, budget_ms: float = BUDGET_MS) -> DataFrame:
    """One row a stream: reliable, reason. Rules apply in order; the first that fits decides."""
    rows = intervals(stamps)
    keys = ["stream_id", "n", "w_start"]
    gaps = rows.where("gap > 0")
    medians = gaps.groupBy(*keys).agg(F.count("*").alias("k"), F.percentile("gap", 0.5).alias("median"))
    bad = gaps.join(medians, keys).groupBy(*keys).agg(F.count_if(F.abs(F.col("gap") - F.col("median")) > INTERVAL_TOLERANCE * F.col("median")).alias("irregular"))
    usable = medians.where(F.col("k") >= LEAST_INTERVALS).join(bad, keys)
    overall = usable.groupBy("stream_id").agg(F.percentile("median", 0.5).alias("overall"))
    usable = usable.join(overall, "stream_id").groupBy("stream_id", "overall").agg(F.count("*").alias("usable"), F.max("k").alias("most"), F.max(F.col("irregular") / F.col("k")).alias("irregular"), F.max(F.abs(F.col("median") - F.col("overall"))).alias("drift"))
    spread = rows.groupBy("stream_id", "n").agg(F.count("offset").alias("offsets"), (F.max("offset") - F.min("offset")).alias("spread"))
    all_ = spread.join(usable, "stream_id", "left")
    reason = (
        F.when(F.col("n") <= LEAST_INTERVALS + 1, "too_short_to_matter")
        .when(F.col("usable").isNull(), "no_usable_timestamps")
        .when((F.col("usable") < 2) & ((F.col("most") + 1) * 2 < F.col("n")), "unrepresentative_sample")
        .when(F.col("irregular") > MOST_IRREGULAR, "irregular_within_window")
        .when((F.col("overall") > 0) & (F.col("drift") > DRIFT_TOLERANCE * F.col("overall")), "rate_changes_between_windows")
        .when((F.col("offsets") >= 2) & (F.col("spread") > budget_ms), "timing_drift")
        .otherwise("constant")
    )
    return all_.select("stream_id", "n", F.coalesce("usable", F.lit(0)).cast("long").alias("usable"), reason.alias("reason")).withColumn("reliable", F.col("reason").isin("too_short_to_matter", "constant"))
