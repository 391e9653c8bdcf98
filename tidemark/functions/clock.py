"""Recording starts typed by users, wall-clock times, and texts of lengths and sizes, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, then time after any one character, then an offset: what a typed recording start may look like. Only Z and numbers are offsets.
_START = r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?(Z|\+00:00|[+-]\d{2}(?::?\d{2})?)?)?$"


def recording_start(text: Column) -> Column:
    """The wall-clock time that a text names (its offset does not move it), as timestamp_ntz; null for what is no time."""
    text = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    part = [F.regexp_extract(text, _START, i) for i in range(8)]
    hour, minute, second = (F.when(p == "", "00").otherwise(p) for p in part[4:7])
    micros = F.rpad(F.substring(part[7], 1, 6), 6, "0")
    whole = F.concat(part[1], F.lit("-"), part[2], F.lit("-"), part[3], F.lit(" "), hour, F.lit(":"), minute, F.lit(":"), second, F.lit("."), micros)
    return F.when(part[0] != "", whole.try_cast("timestamp_ntz"))


def wall_clock(start: Column, offset: Column) -> Column:
    """start and max(0, offset) seconds later; null where the start is unknown."""
    return F.timestamp_add("MICROSECOND", F.bround(F.greatest(F.lit(0.0), offset) * 1_000_000).cast("long"), start)


def clock_text(time: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss; empty for an unknown time."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def scan_clock(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def player_duration(seconds: Column) -> Column:
    """M:SS or H:MM:SS, with the seconds to one digit in brackets; `unknown` for null."""
    s = F.floor(seconds).cast("long")
    stem = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
    return F.when(seconds.isNull(), "unknown").otherwise(F.concat(stem, F.format_string(" (%.1f s)", seconds)))


def bytes_text(size: Column) -> Column:
    """MB to one digit, half-even, from 1024 MB on GB to two, half up; `unknown` for null and 0. Rounded before they are printed: a format rounds all halves up."""
    mb = size / F.lit(1024.0 * 1024.0)
    gb = F.floor(mb / 1024 * 100 + 0.5) / 100
    return F.when(F.coalesce(size, F.lit(0)) == 0, "unknown").when(mb >= 1024, F.format_string("%.2f GB", gb)).otherwise(F.format_string("%.1f MB", F.bround(mb, 1)))


def display_name(path: Column) -> Column:
    """The last part of a path, without what does not print, of 120 characters at most; `video` if nothing is left."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")
    name = F.substring(name, 1, 120)
    return F.when(F.coalesce(name, F.lit("")) == "", "video").otherwise(name)


#: Fixed texts: what the end of a run is called.
FLOW_DONE = {"confirmed": "Efflux time measured: %s s", "review": "A time was measured but needs review"}
FLOW_FAILED, NO_EVENTS, SOME_EVENTS = "No reliable efflux time could be measured", "Analysis complete - no events detected", "Analysis complete - %d event(s) detected"


def completion_message(timed: Column, status: Column, efflux_text: Column, n_events: Column) -> Column:
    """The line at the end of a run: of a timed flow (by status), or of a search for events (by their number)."""
    flow = F.when(status == "confirmed", F.format_string(FLOW_DONE["confirmed"], efflux_text)).when(status == "review", FLOW_DONE["review"]).otherwise(FLOW_FAILED)
    return F.when(timed, flow).when(n_events == 0, NO_EVENTS).otherwise(F.format_string(SOME_EVENTS, n_events))
