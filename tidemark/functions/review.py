"""Column expressions of a reviewer's player: elapsed times, seek targets, places on a timeline, sizes of an enlarged region."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lead-in before a boundary, in seconds, and the text of an unknown time.
LEAD_IN, UNKNOWN = 1.0, "--:--.-"


def finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def tenths_text(seconds: Column) -> Column:
    """MM:SS.t, or H:MM:SS.t; halves of a tenth go up, and negative times are 0."""
    tenths = F.floor(F.greatest(F.lit(0.0), seconds) * 10 + 0.5)
    h, m = F.floor(tenths / 36000), F.floor(tenths / 600) % 60
    rest = F.format_string("%02d:%02d.%d", m, F.floor(tenths / 10) % 60, tenths % 10)
    return F.when(~finite(seconds), UNKNOWN).when(h > 0, F.concat(h.cast("string"), F.lit(":"), rest)).otherwise(rest)


def seek_time(t: Column, duration: Column) -> Column:
    """t within [0, duration]; an unusable t is 0, an unusable duration no bound."""
    end = F.when(finite(duration) & (duration > 0), duration).otherwise(float("inf"))
    return F.least(F.greatest(F.when(finite(t), t).otherwise(0.0), F.lit(0.0)), end)


def boundary_seek(boundary: Column, duration: Column, lead_in: float = LEAD_IN) -> Column:
    """Where to start to see a boundary come; null for an unusable one."""
    return F.when(finite(boundary), seek_time(boundary - lead_in, duration))


def timeline_percent(t: Column, duration: Column) -> Column:
    usable = finite(t) & finite(duration) & (duration > 0)
    return F.when(usable, F.least(F.lit(100.0), F.greatest(F.lit(0.0), t / duration * 100)))


def enlarged_side(side: Column, other: Column, longest: int) -> Column:
    """The side of a region that is enlarged until its longer side is `longest`; null for empty regions."""
    return F.when((side > 0) & (other > 0), F.greatest(F.lit(1), F.floor(side * (longest / F.greatest(side, other)) + 0.5).cast("int")))
