"""Shape of regions beyond moments: convex area, nuclei on the axes, box dimension, and the whole row of an aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from . import spatial
from .raster import scales
from .spatial import hull_edges

#: Second moments that differ by less than this share count as equal; then the orientation is a diagonal.
EQUAL = 1e-9


def _floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b for longs and b > 0, exactly."""
    return F.call_function("div", a - F.pmod(a, b), b)


def convex_areas(pix: DataFrame, key: str = "label") -> DataFrame:
    """(key, convex_area): the number of pixels whose centre lies in the convex hull of the region's pixel sides.

    The hull is that of the middles of the sides, in doubled whole coordinates, so every test is exact. Only the ends of
    a region's rows can be corners; hulls of cells come before the hull of a region. Each side of the hull gives the
    border of the rows it crosses: no pixel inside is looked at.
    """
    ends = pix.groupBy(key, F.col("py").cast("long").alias("py")).agg(F.min("px").cast("long").alias("lo"), F.max("px").cast("long").alias("hi"))
    y, lo, hi = 2 * F.col("py"), 2 * F.col("lo"), 2 * F.col("hi")
    middles = [(lo - 1, y), (hi + 1, y), (lo, y - 1), (lo, y + 1), (hi, y - 1), (hi, y + 1)]
    corners = ends.select(F.lit(0).alias("image_id"), F.col(key).alias("component"), F.inline(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in middles])))
    sides = hull_edges(corners).where("py <> qy").withColumn("up", F.col("qy") > F.col("py"))
    first, last = _floor_div(F.least("py", "qy") + 1, F.lit(2)), _floor_div(F.greatest("py", "qy"), F.lit(2))
    rows = sides.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last))))
    way = F.col("qy") - F.col("py")
    at, by = F.col("px") * way + (2 * F.col("row") - F.col("py")) * (F.col("qx") - F.col("px")), F.abs(way) * 2
    # hulls run counter-clockwise: a side that goes up bounds from the right, one that goes down from the left
    right, left = F.when(F.col("up"), _floor_div(at, by)), F.when(~F.col("up"), -_floor_div(at, by))
    spans = rows.groupBy("component", "row").agg(F.min(right).alias("right"), F.max(left).alias("left"))
    return spans.groupBy(F.col("component").alias(key)).agg(F.sum(F.col("right") - F.col("left") + 1).alias("convex_area"))


def moments(pix: DataFrame, key: str = "label") -> DataFrame:
    """(key, area, cy, cx, box, major_axis, minor_axis, eccentricity, orientation) of regions.

    orientation is the angle from the downward direction to the major axis, positive towards greater px. Where both
    second moments are equal it is a quarter of pi, with the sign of the mixed moment, negative where that is 0.
    """
    m = pix.groupBy(key).agg(
        F.count("*").alias("area"), F.avg("py").alias("cy"), F.avg("px").alias("cx"), F.min("py").alias("min_row"), F.min("px").alias("min_col"),
        (F.max("py") + 1).alias("max_row"), (F.max("px") + 1).alias("max_col"),
        (F.var_pop("py") + 1 / 12).alias("_yy"), (F.var_pop("px") + 1 / 12).alias("_xx"), F.covar_pop("px", "py").alias("_xy"),
    )
    yy, xx, xy = F.col("_yy"), F.col("_xx"), F.col("_xy")
    spread = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    l1, l2 = (xx + yy + spread) / 2, F.greatest((xx + yy - spread) / 2, F.lit(0.0))
    least = EQUAL * (xx + yy)
    even = F.when(xy > least, math.pi / 4).otherwise(-math.pi / 4)
    return m.withColumns({
        "major_axis": 4 * F.sqrt(l1), "minor_axis": 4 * F.sqrt(l2), "eccentricity": F.sqrt(1 - l2 / l1),
        "orientation": F.when(F.abs(xx - yy) <= least, even).otherwise(0.5 * F.atan2(2 * xy, yy - xx)),
    }).drop("_yy", "_xx", "_xy")


def axis_lines(row: str = "orientation", padding: int = 100) -> dict[str, list[tuple[Column, Column, Column, Column]]]:
    """Two lines (y1, x1, y2, x2) along each axis of the columns of moments, one row above and one below it.

    Lines go on past the axis by padding - 1 on both sides, in the region's box with padding around it; ends are clipped
    to the box, five short of its far sides, and cut to whole places. Places are again those of the raster.
    """
    cos, sin = F.cos(row), F.sin(row)

    def place(centre: str, low: str, high: str, shift: Column) -> Column:
        limit = F.col(high) - F.col(low) + 2 * padding - 5
        at = F.greatest(F.least(F.round(F.col(centre) - F.col(low) + padding + shift, 6), limit), F.lit(1.0))
        return at.cast("long") - padding + F.col(low)

    def lines(dy: Column, dx: Column, axis: str):
        half = 0.5 * (F.col(axis) + 2 * padding - 2)
        y1, x1, y2, x2 = (place(c, f"min_{s}", f"max_{s}", d * half) for c, s, d in (("cy", "row", -dy), ("cx", "col", -dx), ("cy", "row", dy), ("cx", "col", dx)))
        return [(y1 + k, x1, y2 + k, x2) for k in (-1, 1)]

    return {"major": lines(cos, sin, "major_axis"), "minor": lines(sin, -cos, "minor_axis")}


def on_line(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Whether the pixel (py, px) is covered by the smoothed line between two places: less than one away from it, and
    between its ends in the direction in which it is longer."""
    dy, dx = y2 - y1, x2 - x1
    off = (F.col("py") - y1) * dx - (F.col("px") - x1) * dy
    steep = F.abs(dy) > F.abs(dx)
    between = lambda v, a, b, more=0: F.col(v).between(F.least(a, b) - more, F.greatest(a, b) + more)
    along = F.when(steep, between("py", y1, y2) & between("px", x1, x2, 1)).otherwise(between("px", x1, x2) & between("py", y1, y2, 1))
    return along & (off * off < F.greatest(dy * dy + dx * dx, F.lit(1)))


def axis_counts(pix: DataFrame, props: DataFrame, key: str, label: str, padding: int = 100) -> DataFrame:
    """(key, num_major, num_minor): how many labels of a region (key, label, py, px) lie on its axes.

    A pixel is tested against its own region's lines in its row, after one join with props (as moments gives them). What
    both axes cover counts for the minor one.
    """
    lines = axis_lines(padding=padding)
    ends = props.select(key, *[F.struct(*[c.alias(n) for n, c in zip(("y1", "x1", "y2", "x2"), line, strict=True)]).alias(f"_{axis}{k}") for axis, both in lines.items() for k, line in enumerate(both)])
    covered = lambda axis: on_line(*[F.col(f"_{axis}0.{c}") for c in ("y1", "x1", "y2", "x2")]) | on_line(*[F.col(f"_{axis}1.{c}") for c in ("y1", "x1", "y2", "x2")])
    hits = pix.select(key, label, "py", "px").join(ends, key).select(key, label, covered("major").alias("_major"), covered("minor").alias("_minor"))
    met = hits.groupBy(key, label).agg(F.max(F.col("_major") & ~F.col("_minor")).alias("_major"), F.max("_minor").alias("_minor"))
    return met.groupBy(key).agg(F.count("*").alias("num_labels"), F.count_if("_major").alias("num_major"), F.count_if("_minor").alias("num_minor"))


def box_dimensions(pix: DataFrame, props: DataFrame, key: str, buffer: int = 1) -> DataFrame:
    """(key, dimension): box-counting dimension of each region in its own box with buffer pixels around.

    As raster.box_counts counts, with rows binned along the width and columns along the height; null where fewer than two
    scales have boxes.
    """
    side = lambda low, high: F.col(high) - F.col(low) + 2 * buffer
    own = props.select(
        key, F.col("min_row").alias("_y0"), F.col("min_col").alias("_x0"), side("min_row", "max_row").alias("_h"), side("min_col", "max_col").alias("_w"),
        F.explode(F.array(*map(F.lit, scales()))).alias("scale"),
    )
    own = own.withColumn("_ny", F.ceil(F.col("_w") / F.col("scale")) - 1).withColumn("_nx", F.ceil(F.col("_h") / F.col("scale")) - 1).where("_ny > 0 AND _nx > 0")
    y, x = F.col("py") - F.col("_y0") + buffer, F.col("px") - F.col("_x0") + buffer
    inside = (y <= F.col("_ny") * F.col("scale")) & (x <= F.col("_nx") * F.col("scale"))
    at = lambda v, n: F.least(F.floor(v / F.col("scale")), F.col(n) - 1)
    boxes = pix.select(key, "py", "px").join(own, key).where(inside).select(key, "scale", at(y, "_ny").alias("by"), at(x, "_nx").alias("bx")).distinct()
    counts = boxes.groupBy(key, "scale").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg((-F.regr_slope(F.log("n"), F.log("scale"))).alias("dimension"))


def aggregate_rows(pix: DataFrame, key: str, label: str, resolution: tuple[float, float] = (1.0, 1.0), padding: int = 100) -> DataFrame:
    """One row for each aggregate of nuclei pixels (key, label, py, px): centroid, convex and nuclei area, eccentricity,
    number of nuclei, axes, nuclei on the axes, box dimension and box, in units of resolution (width, height of a pixel).

    Every part is a grouped aggregate on the key or on rows of it, so a large aggregate is never one task's pixels.
    """
    rx, ry = resolution
    props = moments(pix, key)
    length = ((rx * rx + ry * ry) / 2) ** 0.5
    out = props.join(convex_areas(pix, key), key).join(axis_counts(pix, props, key, label, padding), key)
    return out.join(box_dimensions(pix, props, key), key, "left").select(
        key, F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), (F.col("convex_area") * (rx * ry)).alias("convex_area"), "eccentricity",
        (F.col("area") * (rx * ry)).alias("nuclei_area"), (F.col("area") / F.col("convex_area")).alias("solidity"), F.col("num_labels").alias("num_nuclei"),
        (F.col("major_axis") * length).alias("major_axis_length"), (F.col("minor_axis") * length).alias("minor_axis_length"),
        F.col("num_major").alias("num_nuclei_major_axis"), F.col("num_minor").alias("num_nuclei_minor_axis"), F.col("dimension").alias("fractal_dimension"),
        "orientation", F.col("min_row").alias("bb_min_row"), F.col("min_col").alias("bb_min_col"), F.col("max_row").alias("bb_max_row"), F.col("max_col").alias("bb_max_col"),
    )


def included_pixels(mask: DataFrame, members: DataFrame, height: int, width: int, mode: str = "dtfe", buffer: int = 1) -> DataFrame:
    """(component, py, px, row, col): the pixels of nuclei that belong to each aggregate, and their place in its window.

    mask: py, px, label of all nuclei of a slide of height x width; members: component, label. Pixels of members in the
    last buffer rows and columns are left out; the others' box, grown by buffer but not over the slide's first pixel, is
    the window, without its last row and column. Mode dtfe takes the members' pixels, bbox those of all nuclei in the
    window, convex those of them in the convex hull of the members' pixels. A member without pixels adds none.
    """
    if mode not in ("dtfe", "convex", "bbox"):
        raise ValueError(f"mode is dtfe, convex or bbox, not {mode}")
    own = mask.join(members.select("component", "label").distinct(), "label").select("component", "py", "px")
    own = own.where((F.col("py") <= height - buffer - 1) & (F.col("px") <= width - buffer - 1))
    window = own.groupBy("component").agg(*[
        f.alias(n) for k, n0 in (("py", "row"), ("px", "col"))
        for n, f in ((f"_first_{n0}", F.greatest(F.min(k), F.lit(buffer)) - buffer), (f"_past_{n0}", F.max(k) + buffer))
    ])
    if mode == "dtfe":
        found = own.distinct()
    else:
        at = mask.where("label > 0").select(F.lit(0).alias("image_id"), F.lit(0).alias("nid"), "px", "py")
        box = window.select(F.lit(0).alias("image_id"), "component", F.col("_first_col").alias("min_x"), (F.col("_past_col") - 1).alias("max_x"),
                            F.col("_first_row").alias("min_y"), (F.col("_past_row") - 1).alias("max_y"))
        found = spatial.in_boxes(at.withColumnsRenamed({"px": "x", "py": "y"}), box).select("component", F.col("y").alias("py"), F.col("x").alias("px"))
    if mode == "convex":
        # pixels are taken by the middles of their sides, in halves
        sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        middles = own.select("component", "py", "px", F.inline(sides)).select(
            F.lit(0).alias("image_id"), "component", (F.col("px") * 2 + F.col("b")).alias("x"), (F.col("py") * 2 + F.col("a")).alias("y")
        )
        at = found.select("py", "px").distinct().select(F.lit(0).alias("image_id"), F.lit(0).alias("nid"), (F.col("px") * 2).alias("x"), (F.col("py") * 2).alias("y"))
        held = spatial.in_hulls(at, materialize(middles)).select("component", F.expr("int(y div 2)").alias("py"), F.expr("int(x div 2)").alias("px"))
        found = found.join(held, ["component", "py", "px"], "left_semi")
    return found.join(window, "component").select(
        "component", "py", "px", (F.col("py") - F.col("_first_row")).alias("row"), (F.col("px") - F.col("_first_col")).alias("col")
    )
