"""Intervals of a trace as gaps and islands; every operator works on all groups of `keys` at once.

Traces are walked by windows over each group. A group too long for one task is cut first (`cut`): its samples lie in pieces, ranges of the sort order, and the same windows stop at the pieces. What a piece does to the
state that comes in is a map of few cases (on, off or unchanged; a run that goes on or starts anew), so that the state at the start of each piece follows from one row a piece, and no window sees a whole group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stored import stored


def cut(samples: DataFrame, keys: list[str], pieces: int | None = None) -> DataFrame:
    """samples (keys, t, seq, ...) with `piece`, the number of the range of (keys, t, seq) they lie in; written, so that the ranges stay. Operators of this module and of flow take such samples as they take others."""
    order = [*keys, "t", "seq"]
    ranged = samples.repartitionByRange(pieces, *order) if pieces else samples.repartitionByRange(*order)
    return stored(ranged.withColumn("piece", F.spark_partition_id()), "pieces")


def groups_of(samples: DataFrame, keys: list[str]) -> list[str]:
    """What windows over samples are partitioned by: the keys, and the pieces of samples that are cut."""
    return [*keys, "piece"] if "piece" in samples.columns else keys


def before_pieces(samples: DataFrame, keys: list[str], ends: list[Column], states: dict[str, Column] | list[dict[str, Column]]) -> DataFrame:
    """samples (cut) with the named states in which their pieces start: `ends` are aggregates of each piece, `states` window functions of these over the pieces, in steps where one needs another.

    Only groups of several pieces have them; they are fewer rows than twice the pieces, and so are broadcast."""
    found = samples.groupBy(*keys, "piece").agg(*ends)
    found = found.join(found.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), keys, "left_semi")
    steps = states if isinstance(states, list) else [states]
    for step in steps:
        found = found.withColumns(step)
    return samples.join(F.broadcast(found.select(*keys, "piece", *steps[-1])), [*keys, "piece"], "left")


def earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)


def active_intervals(samples: DataFrame, keys: list[str], dense: bool) -> DataFrame:
    """Hysteresis over samples (keys, t, seq, score, disturbed, enter, exit): keys, start, end.

    Disturbed samples decide nothing, but they are the `previous sample` of others. Dense bounds lie on the first and last active sample; the
    conservative ones on the samples before and after. An interval that is open at the end closes at the last sample."""
    is_cut, group, mark = "piece" in samples.columns, groups_of(samples, keys), F.struct("t", "seq")
    order = Window.partitionBy(*group).orderBy("t", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    signal = F.when(~F.col("disturbed"), F.when(F.col("score") >= F.col("enter"), 1).when(F.col("score") < F.col("exit"), 0))
    rows = samples.withColumn("signal", signal).withColumns({"prev": F.lag("t").over(order), "known": F.last("signal", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    # The last start that the piece shows by itself, and its first signal, which is a start if it was off before.
    rows = rows.withColumns({"begun": F.max(F.when((F.col("signal") == 1) & (F.col("known") == 0), mark)).over(upto), "first": F.min(F.when(F.col("signal").isNotNull(), F.struct("t", "seq", "signal"))).over(upto)})
    if is_cut:
        rows = stored(rows, "walked")
        signalled = F.when(F.col("signal").isNotNull(), mark)
        ends = [F.max("t").alias("e_t"), F.max_by("signal", signalled).alias("e_on"), F.max("begun").alias("e_begun"), F.min(F.when(F.col("signal").isNotNull(), F.struct("t", "seq", "signal"))).alias("e_first")]
        was = F.coalesce(F.last("e_on", ignorenulls=True).over(earlier(keys)), F.lit(0))
        begun = F.coalesce("e_begun", F.when((F.col("e_first.signal") == 1) & (F.col("s_on") == 0), F.struct("e_first.t", "e_first.seq")))
        rows = before_pieces(rows, keys, ends, [{"s_on": was}, {"e_start": begun}, {"s_t": F.max("e_t").over(earlier(keys)), "s_start": F.last("e_start", ignorenulls=True).over(earlier(keys)), "s_on": F.col("s_on")}])
        last = rows.groupBy(*keys).agg(F.max("t").alias("last"))
    else:
        rows = rows.withColumns({"s_t": F.lit(None).cast("double"), "s_on": F.lit(0), "s_start": F.lit(None).cast(rows.schema["begun"].dataType), "last": F.max("t").over(Window.partitionBy(*keys))})
    rows = rows.where(~F.col("disturbed")).withColumns({"prev": F.coalesce("prev", "s_t", "t"), "was": F.coalesce("known", "s_on", F.lit(0))}).withColumn("on", F.coalesce("signal", "was"))
    opened = F.when((F.col("first.signal") == 1) & (F.coalesce("s_on", F.lit(0)) == 0), F.struct("first.t", "first.seq"))
    rows = rows.withColumn("island", F.coalesce("begun", opened, "s_start"))
    start = F.min(F.when((F.col("on") == 1) & (F.col("was") == 0), F.col("t" if dense else "prev")))
    end = F.min(F.when((F.col("on") == 0) & (F.col("was") == 1), F.col("prev" if dense else "t")))
    rows = rows.where((F.col("on") == 1) | (F.col("was") == 1))
    if is_cut:
        found = rows.groupBy(*keys, "island").agg(start.alias("start"), end.alias("end")).join(last, keys)
        return found.select(*keys, "start", F.coalesce("end", "last").alias("end"))
    found = rows.groupBy(*keys, "island").agg(start.alias("start"), F.coalesce(end, F.max("last")).alias("end"))
    return found.select(*keys, "start", "end")


def with_islands(intervals: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Numbers runs of intervals that start at most `gap` after the latest end so far."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    latest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") - latest > gap).cast("int"), F.lit(1))
    return intervals.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def bridged(intervals: DataFrame, keys: list[str], gap: float) -> DataFrame:
    found = with_islands(intervals, keys, gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.select(*keys, "start", "end")


def long_enough(intervals: DataFrame, least: float) -> DataFrame:
    return intervals.where(F.col("end") - F.col("start") >= least)


def with_peaks(intervals: DataFrame, trace: DataFrame, keys: list[str]) -> DataFrame:
    """The largest score inside each closed interval, disturbed samples included; 0 without samples. Intervals of a group may touch, but not overlap.

    Starts and samples are put in one order, so that a sample knows the interval that began last, and the one before, which may end where the other starts: no join of intervals with samples."""
    begun = intervals.select(*keys, F.col("start").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("score"), "start", "end")
    begun = begun.withColumn("before", F.lag(F.struct("start", "end")).over(Window.partitionBy(*keys).orderBy("start", "end")))
    none = [F.lit(None).cast("double").alias(c) for c in ("start", "end")]
    samples = trace.select(*keys, "t", F.lit(1).alias("kind"), "score", *none, F.lit(None).cast("struct<start:double,end:double>").alias("before"))
    upto = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("kind") == 0, F.struct(F.struct("start", "end").alias("last"), "before")), ignorenulls=True).over(upto)
    rows = begun.unionByName(samples).withColumn("own", own)
    at = F.explode(F.array("own.last", F.when(F.col("kind") == 1, F.col("own.before"))))
    rows = rows.select(*keys, "t", "score", at.alias("at")).where(F.col("t") <= F.col("at.end"))
    return rows.groupBy(*keys, F.col("at.start").alias("start"), F.col("at.end").alias("end")).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("peak"))


def strongest(intervals: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k intervals of highest peak in each group, earlier ones first among equals, and whether some were left out."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("peak").desc(), "start"))
    n = F.count("*").over(Window.partitionBy(*keys))
    return intervals.withColumn("rank", rank).withColumn("truncated", n > k).where(F.col("rank") <= k).drop("rank")


def pauses(events: DataFrame, keys: list[str], idle: float) -> DataFrame:
    """Gaps of at least `idle` between one event and the next: keys, start, end, confidence."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    rows = events.withColumn("next", F.lead("start").over(order)).withColumn("sure", F.least("confidence", F.lead("confidence").over(order)))
    rows = rows.where((F.lit(idle) > 0) & (F.col("next") - F.col("end") >= idle))
    return rows.select(*keys, F.col("end").alias("start"), F.col("next").alias("end"), F.greatest(F.lit(0.05), F.least(F.lit(0.95), "sure")).alias("confidence"))


def persistent(samples: DataFrame, keys: list[str], condition: str, required: float) -> DataFrame:
    """samples with run_start and fires: whether the condition has held for `required` since the run's first sample."""
    order = Window.partitionBy(*groups_of(samples, keys)).orderBy("t", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("_on", F.coalesce(F.col(condition), F.lit(False)))
    fresh = F.col("_on") & ~F.coalesce(F.lag("_on").over(order), F.lit(False))
    rows = rows.withColumn("_fresh", fresh).withColumn("_start", F.last(F.when(F.col("_fresh"), F.col("t")), ignorenulls=True).over(upto))
    start = F.col("_start")
    if "piece" in samples.columns:
        rows = stored(rows.withColumn("_off", F.max(~F.col("_on")).over(upto)), "runs")
        ends = [F.max("_off").alias("e_off"), F.max_by(F.when(F.col("_on"), F.col("_start")), F.struct("t", "seq")).alias("e_run")]
        pieces = Window.partitionBy(*keys).orderBy("piece")
        # A piece with an end of a run begins a stretch, whose first run goes on through pieces without one.
        stretch = F.sum(F.col("e_off").cast("int")).over(pieces.rowsBetween(Window.unboundedPreceding, 0))
        run = F.min("e_run").over(Window.partitionBy(*keys, "_stretch").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
        rows = before_pieces(rows, keys, ends, [{"_stretch": stretch}, {"_run": run}, {"_came": F.lag("_run").over(pieces)}])
        start = F.when(~F.col("_off") & F.col("_came").isNotNull(), F.col("_came")).otherwise(start)
    rows = rows.withColumn("run_start", F.when(F.col("_on"), start))
    rows = rows.withColumn("fires", F.coalesce(F.col("t") - F.col("run_start") >= required, F.lit(False)))
    return rows.select(*samples.columns, "run_start", "fires")
