"""Regions of interest (x, y, w, h in pixels of a frame fw by fh) as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SIDE = 4


def inside_frame() -> Column:
    """Whether the region x, y, w, h is large enough and lies in the frame fw by fh."""
    c = F.col
    return (c("w") >= LEAST_SIDE) & (c("h") >= LEAST_SIDE) & (c("x") >= 0) & (c("y") >= 0) & (c("x") + c("w") <= c("fw")) & (c("y") + c("h") <= c("fh"))


def with_geometry(rois: DataFrame, scale: float) -> DataFrame:
    """rois with validity, the part inside the frame, and the region scaled (half-even, sides of 1 at least)."""
    c = F.col
    x0, y0 = F.greatest(F.lit(0), "x"), F.greatest(F.lit(0), "y")
    x1, y1 = F.least(c("fw"), c("x") + c("w")), F.least(c("fh"), c("y") + c("h"))
    scaled = {f"s_{k}": F.bround(c(k) * scale).cast("int") for k in ("x", "y")} | {f"s_{k}": F.greatest(F.lit(1), F.bround(c(k) * scale).cast("int")) for k in ("w", "h")}
    clipped = {"c_x": x0, "c_y": y0, "c_w": F.greatest(F.lit(0), x1 - x0), "c_h": F.greatest(F.lit(0), y1 - y0)}
    return rois.withColumns({"valid": inside_frame(), **clipped, **scaled})


def with_guard(rois: DataFrame, margin: int) -> DataFrame:
    """rois with the guard region: larger by margin to the left, right and top, by half of it below, inside the frame."""
    c = F.col
    x0, y0 = F.greatest(F.lit(0), c("x") - margin), F.greatest(F.lit(0), c("y") - margin)
    x1, y1 = F.least(c("fw"), c("x") + c("w") + margin), F.least(c("fh"), c("y") + c("h") + margin // 2)
    return rois.withColumns({"g_x": x0, "g_y": y0, "g_w": x1 - x0, "g_h": y1 - y0})


def with_inner(rois: DataFrame, scale: float | Column) -> DataFrame:
    """rois (with their guard region) with the place of the region inside the guard crop scaled by `scale`: i_x, i_y, i_w, i_h."""
    c = F.col

    def scaled(x):
        return F.bround(x * scale).cast("int")

    at_x, at_y = scaled(c("x") - c("g_x")), scaled(c("y") - c("g_y"))
    w = F.greatest(F.lit(1), F.least(scaled(c("w")), F.greatest(F.lit(1), scaled(c("g_w"))) - at_x))
    h = F.greatest(F.lit(1), F.least(scaled(c("h")), F.greatest(F.lit(1), scaled(c("g_h"))) - at_y))
    return rois.withColumns({"i_x": F.greatest(F.lit(0), at_x), "i_y": F.greatest(F.lit(0), at_y), "i_w": w, "i_h": h})


def roi_from_json(text: Column) -> Column:
    """A struct x, y, width, height of whole numbers; numbers are cut to whole ones, texts must be whole numbers; anything else, or less, is an error."""

    def once(x, f):
        # As a lambda's variable x is worked out once, however often f names it.
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def whole(side):
        value, quoted = side["value"], side["quoted"]
        usable = F.when(quoted, value.rlike(r"^\s*[+-]?\d+\s*$")).otherwise(value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
        number = F.when(quoted, F.trim(value).cast("int")).otherwise(F.floor(F.abs(value.cast("double"))).cast("int") * F.signum(value.cast("double")).cast("int"))
        return F.when(F.coalesce(usable, F.lit(False)), number).otherwise(F.raise_error(F.lit("the selected region is not valid")).cast("int"))

    def sides(t):
        return F.struct(*(once(F.struct(F.get_json_object(t, f"$.{name}").alias("value"), t.rlike(rf'"{name}"\s*:\s*"').alias("quoted")), whole).alias(name) for name in ("x", "y", "width", "height")))

    return once(text, sides)


def valid_region(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Whether numbers name a region: finite, not empty, and inside the frame where the frame's size is known."""
    numbers = F.lit(True)
    for v in (x, y, w, h):
        numbers = numbers & F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    known = F.coalesce((frame_w > 0) & (frame_h > 0), F.lit(False))
    return numbers & (w > 0) & (h > 0) & (~known | ((x >= 0) & (y >= 0) & (x + w <= frame_w) & (y + h <= frame_h)))


def with_click_region(clicks: DataFrame, width: int = 60, fraction: float = 0.45) -> DataFrame:
    """From a click (px, py) in a frame fw by fh: a region below it, with a small margin above, inside the frame."""
    c = F.col
    w = F.least(F.lit(width), "fw")
    h = F.least(c("fh"), F.greatest(F.lit(16), F.floor(c("fh") * fraction).cast("int")))
    above = F.greatest(F.lit(2), F.floor(c("fh") * 0.02).cast("int"))
    x = F.greatest(F.lit(0), F.least(c("fw") - w, c("px") - F.floor(w / 2).cast("int")))
    y = F.greatest(F.lit(0), F.least(c("fh") - h, c("py") - above))
    return clicks.withColumns({"x": x, "y": y, "w": w, "h": h})
