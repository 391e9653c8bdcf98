"""Robust statistics of traces, by stream."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes the median absolute deviation a standard deviation for normal noise.
MAD = 1.4826


def noise(trace: DataFrame, keys: list[str], baseline: float = 0.5) -> DataFrame:
    """keys, n, base (the baseline quantile, linear) and sigma, from the half of the samples at or below the base."""
    base = trace.groupBy(*keys).agg(F.count("score").alias("n"), F.percentile("score", baseline).alias("base"))
    quiet = trace.join(base, keys).where(F.col("score") <= F.col("base"))
    spread = quiet.groupBy(*keys).agg((MAD * F.percentile(F.abs(F.col("score") - F.col("base")), 0.5)).alias("sigma"))
    return base.join(spread, keys, "left").withColumn("sigma", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("sigma", F.lit(0.0))))


def with_noise(trace: DataFrame, keys: list[str], baseline: float = 0.5) -> DataFrame:
    """trace with n, base and sigma of its group, as of noise: by windows over the groups, which need no exchange of their own and no join where the trace lies by group anyway."""
    group = Window.partitionBy(*keys)
    rows = trace.withColumns({"n": F.count("score").over(group), "base": F.percentile("score", F.lit(baseline)).over(group)})
    quiet = F.when(F.col("score") <= F.col("base"), F.abs(F.col("score") - F.col("base")))
    rows = rows.withColumn("_mad", F.percentile(quiet, F.lit(0.5)).over(group))
    return rows.withColumn("sigma", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(MAD * F.col("_mad"), F.lit(0.0)))).drop("_mad")


def with_thresholds(stats: DataFrame, enter_sigmas: float, exit_sigmas: float, floor: float, sensitivity: float = 0.5) -> DataFrame:
    """stats with enter and exit levels that follow the noise; exit is never above enter."""
    gain = 2.0 ** (1 - 2 * sensitivity)
    enter = F.greatest(F.lit(floor), F.col("base") + enter_sigmas * gain * F.col("sigma"))
    leave = F.greatest(F.lit(floor / 2), F.col("base") + exit_sigmas * gain * F.col("sigma"))
    return stats.withColumn("enter", enter).withColumn("exit", F.least("enter", leave))


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    bad = (b == 0) | F.isnan(b) | b.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(default)).otherwise(a / b)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
