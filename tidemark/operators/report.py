"""Events as a log: labels, formatted times, summaries, exports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import clock_text, wall_clock

#: Fixed values of the log: status and its label.
STATUS_LABELS = {"confirmed": "detected", "review": "needs review", "failed": "failed"}
CONFIRMED_FROM = 0.60


def video_timestamp(seconds: Column) -> Column:
    """H:MM:SS.mmm, rounded half-even to milliseconds first."""
    ms = F.bround(F.greatest(F.lit(0.0), seconds) * 1000).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def duration_text(seconds: Column) -> Column:
    """x.x s, M m SS.S s or H h MM m SS.S s."""
    tenths = F.bround(F.greatest(F.lit(0.0), seconds) * 10).cast("long")
    h, m, s = F.floor(tenths / 36000), F.floor(tenths / 600) % 60, tenths % 600 / 10.0
    return F.when(seconds < 60, F.format_string("%.1f s", s)).when(seconds < 3600, F.format_string("%d m %04.1f s", m, s)).otherwise(F.format_string("%d h %02d m %04.1f s", h, m, s))


def with_status(events: DataFrame, confirmed_from: float = CONFIRMED_FROM) -> DataFrame:
    """Status and notes of refined events."""
    notes = F.array(F.when(F.col("clipped_start"), F.lit("start may be earlier")), F.when(F.col("clipped_end"), F.lit("end may be later")), F.when(F.col("disturbed_ratio") > 0.05, F.lit("partly disturbed")))
    return events.withColumn("status", F.when(F.col("confidence") >= confirmed_from, "confirmed").otherwise("review")).withColumn("notes", F.filter(notes, lambda x: x.isNotNull()))


def log_rows(events: DataFrame) -> DataFrame:
    """One row an event, numbered by start within its stream."""
    label = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])[F.col("status")]
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("start", "end", "label"))
    return events.select("stream_id", number.alias("number"), "label", video_timestamp(F.col("start")).alias("start_text"), video_timestamp(F.col("end")).alias("end_text"), F.bround((F.col("end") - F.col("start")) * 1000).cast("long").alias("duration_ms"), F.bround(F.col("confidence") * 100).cast("int").alias("confidence_percent"), label.alias("status_text"), F.array_join("notes", " | ").alias("notes_text"))


#: Fixed columns of an exported log, in their order.
COLUMNS = ("event", "start_video_time", "end_video_time", "duration_s", "start_wall_clock", "end_wall_clock", "confidence_pct", "status", "detector", "notes")


def export_rows(events: DataFrame, starts: DataFrame, detector: str) -> DataFrame:
    """One row an event as exported: stream_id, number (its place by start) and COLUMNS. starts: (stream_id, recording_start), the start null or the row missing where it is unknown."""
    rows = events.join(starts, "stream_id", "left")
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("start", "end", "label"))
    label = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])[F.col("status")]
    return rows.select(
        "stream_id", number.alias("number"), F.col("label").alias("event"), video_timestamp(F.col("start")).alias("start_video_time"), video_timestamp(F.col("end")).alias("end_video_time"),
        F.bround(F.col("end") - F.col("start"), 3).alias("duration_s"), clock_text(wall_clock(F.col("recording_start"), F.col("start"))).alias("start_wall_clock"),
        clock_text(wall_clock(F.col("recording_start"), F.col("end"))).alias("end_wall_clock"), F.bround(F.col("confidence") * 100).cast("int").alias("confidence_pct"), label.alias("status"),
        F.lit(detector).alias("detector"), F.array_join("notes", " | ").alias("notes"),
    )


def export_json(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """From export_rows: stream_id and json, the log of one recording: its rows in order, has_wall_clock, recording_start (null if unknown) and columns. Recordings without events have empty rows."""
    logs = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("number", F.struct(*COLUMNS).alias("row")))).alias("found"))
    every = starts.join(logs, "stream_id", "full")
    document = F.struct(
        F.coalesce(F.transform("found", lambda x: x["row"]), F.array()).alias("rows"),
        F.col("recording_start").isNotNull().alias("has_wall_clock"),
        F.date_format("recording_start", "yyyy-MM-dd'T'HH:mm:ss").alias("recording_start"),
        F.array(*map(F.lit, COLUMNS)).alias("columns"),
    )
    return every.select("stream_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def sound(events: DataFrame) -> DataFrame:
    """events as they are; an end before its start, or a confidence outside 0 to 1, is an error."""
    return events.withColumns(
        {
            "end": F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit("an event cannot end before it starts")).cast("double")),
            "confidence": F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.raise_error(F.lit("confidence must be between 0 and 1")).cast("double")),
        }
    )


def boundary_events(events: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` events of each stream."""
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("start", "end"))
    return events.withColumn("number", number).where(F.col("number") <= most)


def summary(events: DataFrame) -> DataFrame:
    by = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUS_LABELS]
    active = F.sum(F.bround((F.col("end") - F.col("start")) * 1000).cast("long"))
    return events.groupBy("stream_id").agg(F.count("*").alias("n_events"), *by, active.alias("active_ms"))


def downsampled(trace: DataFrame, most: int) -> DataFrame:
    """At most `most` samples of each stream: all of them, or those numbered int(i * n / most)."""
    rows = trace.withColumn("k", F.row_number().over(Window.partitionBy("stream_id").orderBy("t", "seq")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("stream_id")))
    # k is int(i n / most) for some i exactly if the next multiple at or above k lies below k + 1.
    i = F.ceil(F.col("k") * most / F.col("n"))
    return rows.where((F.col("n") <= most) | ((i < most) & (F.floor(i * F.col("n") / most) == F.col("k")))).select("stream_id", "t", "score", "disturbed")


#: Fixed texts: what a run tells besides its events.
TRUNCATED = "More than %d candidate periods were found; only the strongest were analysed in detail. Consider lowering the sensitivity or selecting a region of interest."
NOTHING = "No activity above the detection threshold was found. If activity was expected, raise the sensitivity or narrow the region of interest."


def run_warnings(streams: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """streams (stream_id) with n_candidates, truncated and warnings, of all candidates that were found of which `most` a stream are looked at."""
    n = F.coalesce("n", F.lit(0)).cast("long")
    rows = streams.select("stream_id").join(candidates.groupBy("stream_id").agg(F.count("*").alias("n")), "stream_id", "left")
    found = F.array(F.when(n > most, F.lit(TRUNCATED % most)), F.when(n == 0, F.lit(NOTHING)))
    return rows.select("stream_id", n.alias("n_candidates"), (n > most).alias("truncated"), F.filter(found, lambda x: x.isNotNull()).alias("warnings"))


def safe_name(stem: Column, mode: str) -> Column:
    return F.concat(F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), 1, 60), F.lit(f"_{mode}_events.csv"))


def write_csv(log: DataFrame, path: str) -> None:
    """Parts of CSV with a header each and CRLF line ends."""
    log.write.option("header", True).option("lineSep", "\r\n").csv(path)
