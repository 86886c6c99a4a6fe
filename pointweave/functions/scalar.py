"""Scalar formulas of the tissue tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def optical_density(v: Column) -> Column:
    return -F.log((v + 1) / 255.0 + 1e-8)


def is_tissue(r: Column, g: Column, b: Column, background: int = 200) -> Column:
    """A pixel that is neither background (all channels above the limit) nor missing (all zero)."""
    return (F.least(r, g, b) <= background) & (F.greatest(r, g, b) > 0)


def standardize(r: Column, g: Column, b: Column, background: int = 200) -> tuple[Column, Column, Column]:
    """Background and missing pixels become white."""
    keep = is_tissue(r, g, b, background)
    return tuple(F.when(keep, c).otherwise(255) for c in (r, g, b))


def circularity(area: Column, perimeter: Column) -> Column:
    """At most 1; null without a perimeter (least() would skip the null)."""
    return F.when(perimeter != 0, F.least(4 * F.pi() * area / (perimeter * perimeter), F.lit(1.0)))


def px_area_to_um2(area: Column, rx: float, ry: float) -> Column:
    return area * (rx * ry)


def px_to_um(length: Column, rx: float, ry: float) -> Column:
    return length * ((rx * rx + ry * ry) / 2) ** 0.5


def um_to_px(length: Column, rx: float) -> Column:
    """Only the x resolution counts here, by definition."""
    return length / rx


def um2_to_px_area(area: Column, rx: float, ry: float, ratio: float) -> Column:
    """An area in pixels of an image whose magnification is ratio of that with the resolution rx, ry."""
    return area / (rx * ry) * ratio**2


def ramp_color(v: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """A share from 0 to 1 as rgb(r,g,b) on the line between two colours, truncated; values beyond are clipped."""
    t = clip(v, 0.0, 1.0)
    return F.format_string("rgb(%d,%d,%d)", *[(F.lit(a) + t * (b - a)).cast("int") for a, b in zip(low, high, strict=True)])


def minutes(seconds: Column) -> Column:
    """Minutes of a text of seconds; null where it is no number."""
    return seconds.try_cast("double") / 60


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")


def strip_zero(text: Column) -> Column:
    """An id without its one leading zero."""
    return F.regexp_replace(text, "^0", "")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "[\\r\\n]+", "")


def clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def memory_gb(text: Column) -> Column:
    """Sizes with suffix K or M in gigabytes; any other suffix is null."""
    n = F.try_to_number(F.regexp_extract(text, r"^([0-9.]+)", 1), F.lit("999999999999.999")).cast("double")
    return F.when(F.right(text, F.lit(1)) == "K", n / 1e6).when(F.right(text, F.lit(1)) == "M", n / 1e3)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value on a scale of 0 to 255, truncated."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    hue = (
        F.when(span == 0, 0.0)
        .when(r == top, F.try_divide(g - b, span))
        .when(g == top, 2.0 + F.try_divide(b - r, span))
        .otherwise(4.0 + F.try_divide(r - g, span))
        / 6.0
    )
    hue = F.when(hue < 0, hue + 1).otherwise(hue)
    return (hue * 255).cast("int"), F.coalesce(F.try_divide(span * 255, top), F.lit(0.0)).cast("int"), top.cast("int")


def skewness(c: str) -> Column:
    """Bias-corrected skewness of a group; null below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis of a group; null below four values or without spread."""
    n = F.count(c).cast("double")
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), g2)
