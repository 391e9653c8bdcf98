"""Timing of one flow a stream: persistence rules as two passes of gaps and islands."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import clamp, safe_ratio
from tidemark.operators.intervals import before_pieces, earlier, groups_of, persistent
from tidemark.sources.stored import stored

KEY = ["stream_id"]
#: Most streams whose own rows are broadcast to their samples.
BROADCAST_STREAMS = 100_000


def _of_stream(rows: DataFrame, **found: Column) -> DataFrame:
    """rows with aggregates over their whole stream: by a window, or, for samples that are cut, by a small table."""
    if "piece" not in rows.columns:
        return rows.withColumns({name: c.over(Window.partitionBy("stream_id")) for name, c in found.items()})
    each = stored(rows.groupBy("stream_id").agg(*[c.alias(name) for name, c in found.items()]), "streams")
    return rows.join(F.broadcast(each) if each.count() <= BROADCAST_STREAMS else each, "stream_id")


def _counted(rows: DataFrame, name: str, what: Column, order: list[str]) -> DataFrame:
    """rows with the running sum of `what` in a stream, the row itself included."""
    upto = Window.partitionBy(*groups_of(rows, KEY)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_what", what).withColumn(name, F.sum("_what").over(upto))
    if "piece" in rows.columns:
        rows = before_pieces(rows, KEY, [F.sum("_what").alias("e_sum")], {"_sum": F.sum("e_sum").over(earlier(KEY))})
        rows = rows.withColumn(name, F.col(name) + F.coalesce("_sum", F.lit(0))).drop("_sum")
    return rows.drop("_what")


def phases(samples: DataFrame, threshold: float, start_hold: float, end_hold: float) -> DataFrame:
    """samples (stream_id, t, seq, activity, outlet, liquid, contrast, noise, disturbed) with pos, ok, present, absent, and the stream's c_pos, c_t, start (of the
    confirmed start) and e_pos (of the confirmed end): null where there is none. Rows after the end are gone."""
    rows = _counted(samples, "pos", F.lit(1), ["t", "seq"]).withColumn("ok", ~F.col("disturbed"))
    rows = rows.withColumns({"present": F.col("ok") & F.coalesce(F.col("liquid"), F.col("activity") >= threshold), "at_outlet": F.col("ok") & (F.col("outlet") >= threshold)})
    rows = persistent(rows, KEY, "at_outlet", start_hold).withColumnsRenamed({"run_start": "start_run", "fires": "start_fires"})
    rows = _of_stream(rows, c=F.min(F.when(F.col("start_fires"), F.struct("pos", "t", "start_run"))))
    rows = rows.withColumns({"c_pos": F.col("c.pos"), "c_t": F.col("c.t"), "start": F.col("c.start_run")}).drop("c")
    rows = rows.withColumn("absent", F.coalesce(F.col("pos") > F.col("c_pos"), F.lit(False)) & F.col("ok") & ~F.col("present"))
    rows = persistent(rows, KEY, "absent", end_hold).withColumnsRenamed({"run_start": "gap_start", "fires": "end_fires"})
    rows = _of_stream(rows, e_pos=F.min(F.when(F.col("end_fires"), F.col("pos"))))
    return rows.where(F.col("e_pos").isNull() | (F.col("pos") <= F.col("e_pos")))


def breaks(rows: DataFrame, least: float) -> DataFrame:
    """From phases(): gaps of at least `least` that ended with liquid: stream_id, start, end. A disturbed sample ends a gap unseen."""
    gap = F.when(F.col("absent"), F.col("gap_start"))
    rows = rows.withColumn("from", F.lag(gap).over(Window.partitionBy(*groups_of(rows, KEY)).orderBy("pos")))
    if "piece" in rows.columns:
        rows = before_pieces(rows, KEY, [F.max_by(gap, "pos").alias("e_gap"), F.min("pos").alias("e_pos1")], {"s_gap": F.lag("e_gap").over(Window.partitionBy("stream_id").orderBy("piece")), "s_pos": F.col("e_pos1")})
        rows = rows.withColumn("from", F.when(F.col("pos") == F.col("s_pos"), F.col("s_gap")).otherwise(F.col("from")))
    found = rows.where(F.col("present") & (F.col("t") - F.col("from") >= least))
    return found.select("stream_id", F.col("from").alias("start"), F.col("t").alias("end"))


def measurements(rows: DataFrame, threshold: float, least_break: float) -> DataFrame:
    """From phases(): one row a stream."""
    after = F.col("pos") > F.col("c_pos")
    # Only an undisturbed sample away from the outlet starts the margins anew.
    rows = _counted(rows, "margin_run", F.when(F.col("ok") & ~F.col("at_outlet"), 1).otherwise(0), ["pos"])
    rows = _of_stream(rows, c_run=F.max(F.when(F.col("pos") == F.col("c_pos"), F.col("margin_run"))), last_pos=F.max(F.coalesce(F.when(after & F.col("present"), F.col("pos")), F.col("c_pos"))))
    in_margin = F.col("at_outlet") & (F.col("margin_run") == F.col("c_run")) & (F.col("pos") <= F.col("c_pos"))
    trailing = F.count_if(F.col("absent") & (F.col("pos") > F.col("last_pos")))
    got = rows.groupBy("stream_id").agg(
        F.max("start").alias("start"),
        F.max(F.when(F.col("pos") == F.col("last_pos"), F.col("t"))).alias("end"),
        F.max("e_pos").isNotNull().alias("end_confirmed"),
        F.count("*").alias("frames"),
        F.count_if("present").alias("with_liquid"),
        F.count_if("disturbed").alias("disturbed"),
        (F.count_if(after & F.col("ok")) - F.when(F.max("e_pos").isNotNull(), trailing).otherwise(0)).alias("timed"),
        F.count_if(after & F.col("present")).alias("timed_with_liquid"),
        F.coalesce(F.avg(F.when(in_margin, F.col("outlet"))) / threshold - 1, F.lit(0.0)).alias("start_margin"),
        F.coalesce(F.avg(F.when(F.col("present") & (F.col("contrast") != 0), F.col("contrast"))), F.lit(0.0)).alias("contrast"),
        F.coalesce(F.avg("noise"), F.lit(0.0)).alias("noise"),
    )
    n = breaks(rows, least_break).groupBy("stream_id").agg(F.count("*").alias("breaks"))
    return got.join(n, "stream_id", "left").withColumn("breaks", F.coalesce("breaks", F.lit(0)).cast("long"))


#: Fixed texts: why a measured time has the confidence it has, in the order in which they are given.
NO_START, NO_END = "No liquid stream was detected at the outlet.", "Flow started but no end of flow could be determined."
UNCONFIRMED = "The video ended while liquid was still visible, so the efflux time is a lower bound rather than a measurement."
BROKEN = "The stream was only visible in %d%% of the timed interval, which makes the end of flow ambiguous."
INTERRUPTED = "%d interruptions of the stream were seen before the end."
SHAKEN = "%d%% of frames showed movement around the cup (camera or hand movement)."
FAINT = "The stream contrast against the background is low; consider improving lighting or the background behind the stream."
SHORT = "The measured interval (%.2f s) is very short for a Zahn cup test."
CLEAR = "Stream detected continuously with a clear start and a sustained end."


def with_reasons(flows: DataFrame, least_plausible: float) -> DataFrame:
    """judged() with reasons, an array of texts."""

    def percent(x):
        return F.bround(x * 100).cast("long")

    continuity = clamp(F.col("continuity"), 0.0, 1.0)
    disturbed = clamp(F.col("disturbed") / F.greatest(F.lit(1), "frames"), 0.0, 1.0)
    snr = clamp(safe_ratio(F.col("contrast"), F.greatest("noise", F.lit(1e-6))) / 8.0, 0.0, 1.0)
    found = F.array(
        F.when(~F.col("end_confirmed"), F.lit(UNCONFIRMED)),
        F.when(continuity < 0.6, F.format_string(BROKEN, percent(continuity))),
        F.when(F.col("breaks") > 1, F.format_string(INTERRUPTED, "breaks")),
        F.when(disturbed > 0.02, F.format_string(SHAKEN, percent(disturbed))),
        F.when(snr < 0.3, F.lit(FAINT)),
        F.when((F.col("efflux") > 0) & (F.col("efflux") < least_plausible), F.format_string(SHORT, F.bround("efflux", 2))),
    )
    found = F.filter(found, lambda x: x.isNotNull())
    reasons = F.when(F.col("start").isNull(), F.array(F.lit(NO_START))).when(F.col("end").isNull(), F.array(F.lit(NO_END))).when(F.size(found) == 0, F.array(F.lit(CLEAR))).otherwise(found)
    return flows.withColumn("reasons", reasons)


def judged(flows: DataFrame, least_plausible: float, fail: float = 0.40, review: float = 0.70) -> DataFrame:
    """measurements() with efflux, continuity, confidence and status."""
    rows = flows.withColumn("efflux", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))
    rows = rows.withColumn("continuity", F.when(F.col("timed") > 0, F.col("timed_with_liquid") / F.col("timed")).otherwise(0.0))
    snr = clamp(safe_ratio(F.col("contrast"), F.greatest("noise", F.lit(1e-6))) / 8.0, 0.0, 1.0)
    sure = 0.35 + 0.20 * clamp(F.col("start_margin"), 0.0, 1.0) + 0.20 * clamp(F.col("continuity"), 0.0, 1.0) + 0.15 * snr + F.when(F.col("breaks") <= 1, 0.10).otherwise(0.0) - 0.35 * clamp(F.col("disturbed") / F.greatest(F.lit(1), "frames"), 0.0, 1.0)
    sure = F.when(F.col("end_confirmed"), sure).otherwise(F.least(F.lit(0.50), sure))
    sure = F.when((F.col("efflux") > 0) & (F.col("efflux") < least_plausible), F.least(F.lit(0.45), sure)).otherwise(sure)
    rows = rows.withColumn("confidence", F.when(F.col("start").isNull() | F.col("end").isNull(), 0.0).otherwise(clamp(sure, 0.0, 0.98)))
    status = F.when(F.col("start").isNull() | F.col("end").isNull() | (F.col("confidence") < fail), "failed").when((F.col("confidence") < review) | ~F.col("end_confirmed"), "review").otherwise("confirmed")
    return rows.withColumn("status", status)
