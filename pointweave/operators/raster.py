"""Rasters as rows (py, px, value): morphology, labelling, region properties, windows, box counting."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import broadcast_if_small, materialize
from .components import connected_components

FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]
#: Side of the tiles in which pixels are labelled before their components meet.
LABEL_TILE = 256


def _shifted(pix: DataFrame, offsets) -> DataFrame:
    moves = F.array(*[F.struct((F.col("py") + a).alias("py"), (F.col("px") + b).alias("px")) for a, b in offsets])
    return pix.select(F.inline(moves))


def dilate(fg: DataFrame, offsets=FOUR) -> DataFrame:
    """Foreground (py, px) grown by one step; unbounded, clip to the raster with a filter."""
    return _shifted(fg, [(0, 0), *offsets]).distinct()


def erode(fg: DataFrame, offsets=FOUR) -> DataFrame:
    """Foreground whose whole neighbourhood is foreground; outside the raster counts as background."""
    n = len(offsets) + 1
    return _shifted(fg, [(0, 0), *offsets]).groupBy("py", "px").count().where(F.col("count") == n).select("py", "px")


def erode_within(fg: DataFrame, grid: DataFrame, offsets=FOUR) -> DataFrame:
    """Foreground of which no neighbour is background of grid (py, px); what lies outside grid counts as foreground."""
    ground = dilate(grid.join(fg.hint("merge"), ["py", "px"], "left_anti"), offsets)
    return fg.join(ground.hint("merge"), ["py", "px"], "left_anti")


def fill_holes(fg: DataFrame, grid: DataFrame) -> DataFrame:
    """Foreground and the background of grid (py, px) that no four-neighbour path of background joins to its frame."""
    ground = materialize(label_components(grid.join(fg.hint("merge"), ["py", "px"], "left_anti")))
    frame = grid.agg(F.min("py").alias("y0"), F.max("py").alias("y1"), F.min("px").alias("x0"), F.max("px").alias("x1"))
    on_frame = F.col("py").isin(F.col("y0"), F.col("y1")) | F.col("px").isin(F.col("x0"), F.col("x1"))
    outside = ground.crossJoin(F.broadcast(frame)).where(on_frame).select("component").distinct()
    inner = ground.join(broadcast_if_small(materialize(outside)), "component", "left_anti")
    return fg.select("py", "px").unionAll(inner.select("py", "px"))


def tissue_fragments(pix: DataFrame, background: int = 200, beta: float = 0.12, least: int = 1) -> DataFrame:
    """(py, px, component) of the tissue of a raster (py, px, r, g, b) of low resolution.

    Background and missing pixels become white; pixels whose greatest optical density reaches beta are grown by one step,
    their holes are filled, they shrink by one step, and components of fewer than least pixels go.
    """
    from ..functions.scalar import optical_density, standardize

    grid = pix.select("py", "px")
    density = F.greatest(*[optical_density(c) for c in standardize(F.col("r"), F.col("g"), F.col("b"), background)])
    grown = dilate(pix.where(density >= beta).select("py", "px")).join(grid.hint("merge"), ["py", "px"], "left_semi")
    tissue = erode_within(fill_holes(materialize(grown), grid), grid)
    return remove_small(materialize(label_components(tissue)), least)


def slide_mask(mask: DataFrame, nuclei: DataFrame, size: int) -> DataFrame:
    """Sparse pixels (py, px, label, point) of all tiles together, from the least row and column of tiles with nuclei.

    mask: tile_row, tile_col, y, x, label, of which labels 0 and 1 are background; nuclei: tile_row, tile_col, label,
    slide_label, y, x. label is the nucleus's label in the slide and point the same at the nucleus's own place only, each
    0 where the pixel has none; of nuclei at one place the greatest tile label counts. A tile with a labelled pixel but
    no nucleus of that label is blank.
    """
    key = ["tile_row", "tile_col"]
    origin = F.broadcast(nuclei.agg(F.min("tile_row").alias("r0"), F.min("tile_col").alias("c0")))
    names = nuclei.where("label > 1").groupBy(*key, "label").agg(F.max("slide_label").alias("slide_label"))
    inside = mask.where("label > 1").join(nuclei.select(*key).distinct(), key, "left_semi")
    blank = inside.select(*key, "label").distinct().join(names, [*key, "label"], "left_anti").select(*key).distinct()
    drawn = inside.join(names, [*key, "label"]).join(blank, key, "left_anti")
    drawn = drawn.select(*key, "y", "x", F.col("slide_label").alias("label"), F.lit(0).alias("point"))
    last = F.max_by("slide_label", "label")
    points = nuclei.where("label > 1").join(mask.select(*key).distinct(), key, "left_semi").join(blank, key, "left_anti")
    points = points.groupBy(*key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(last.alias("point"))
    both = drawn.unionByName(points.withColumn("label", F.lit(0))).crossJoin(origin)
    place = lambda tile, low, at: ((F.col(tile) - F.col(low)) * size + F.col(at)).cast("int")
    return (
        both.groupBy(place("tile_row", "r0", "y").alias("py"), place("tile_col", "c0", "x").alias("px"))
        .agg(F.max("label").alias("label"), F.max("point").alias("point"))
    )


def label_components(fg: DataFrame, offsets=FOUR, by: str | None = None) -> DataFrame:
    """fg (py, px[, by]) with component, the least (py, px) of its connected pixels of equal by, as a struct.

    Pixels are labelled in tiles first; the graph's nodes are the components of tiles and its edges the steps across the
    tiles' borders, so joins hold border pixels only. offsets are FOUR or EIGHT.
    """
    import pyarrow as pa

    extra, names = [by] if by else [], fg.columns
    kinds = {c: fg.schema[c].dataType.simpleString() for c in names}
    tile = lambda c: F.floor(F.col(c) / LABEL_TILE)
    eight = len(offsets) == len(EIGHT)

    def label(pixels: pa.Table) -> pa.Table:
        y, x = (pixels[c].to_numpy() for c in ("py", "px"))
        least = _least_connected(y, x, eight)
        return pixels.select(names).append_column("_ny", pa.array(y[least])).append_column("_nx", pa.array(x[least]))

    schema = ", ".join(f"`{c}` {k}" for c, k in [*kinds.items(), ("_ny", kinds["py"]), ("_nx", kinds["px"])])
    dealt = fg.withColumn("_ty", tile("py")).withColumn("_tx", tile("px")).groupBy("_ty", "_tx", *extra)
    placed = materialize(dealt.applyInArrow(label, schema))
    node = F.struct(F.col("_ny").alias("py"), F.col("_nx").alias("px"))
    side = lambda c: F.pmod(F.col(c), F.lit(LABEL_TILE)).isin(0, LABEL_TILE - 1)
    border = placed.where(side("py") | side("px")).select("py", "px", *extra, node.alias("b"))
    ahead = [(a, b) for a, b in offsets if (a, b) > (0, 0)]
    steps = F.array(*[F.struct((F.col("py") + a).alias("py"), (F.col("px") + b).alias("px"), tile("py").alias("ty"), tile("px").alias("tx")) for a, b in ahead])
    over = border.select(F.col("b").alias("a"), *extra, F.inline(steps)).where((tile("py") != F.col("ty")) | (tile("px") != F.col("tx")))
    edges = over.join(border.hint("merge"), ["py", "px", *extra]).select("a", "b").distinct()
    found = connected_components(edges).select(F.col("child.py").alias("_ny"), F.col("child.px").alias("_nx"), F.col("parent").alias("_up"))
    joined = placed.join(broadcast_if_small(found), ["_ny", "_nx"], "left").withColumn("component", F.coalesce("_up", node))
    return joined.select(*names, "component")


def _least_connected(y: np.ndarray, x: np.ndarray, eight: bool) -> np.ndarray:
    """For each pixel of a tile the index of the least (y, x) of its connected pixels.

    Nodes are the runs of pixels of each row. Each round every run takes the least of those it touches, and of the run
    that it then points to, so rounds grow with the logarithm of the longest path.
    """
    order = np.lexsort((x, y))
    r, c = y[order].astype(np.int64), x[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] > c[:-1] + 1)])
    row, first, last = r[starts], c[starts], c[np.r_[starts[1:], len(r)] - 1]
    # a run meets those of the next row from the first that ends behind its begin to the last that begins before its end
    reach, wide = int(eight), int(last.max() - first.min()) + 4
    at = lambda rows, cols: (rows - row[0]) * wide + cols - first.min() + 1
    low = np.searchsorted(at(row, last), at(row + 1, first - reach))
    high = np.searchsorted(at(row, first), at(row + 1, last + reach), side="right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(starts)), n)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    up = np.arange(len(starts))
    while (up[a] != up[b]).any():
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while (up != up[up]).any():
            up = up[up]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(order[starts[up]], np.diff(np.r_[starts, len(r)]))
    return out


def remove_small(labelled: DataFrame, least: int) -> DataFrame:
    n = labelled.groupBy("component").count().where(F.col("count") >= least).select("component")
    return labelled.join(broadcast_if_small(materialize(n)), "component", "left_semi")


def region_properties(pix: DataFrame, key: str = "label") -> DataFrame:
    """Area, centroid, half-open box, axes, eccentricity, orientation, diameter and Euler number of each region.

    Second moments get 1/12 for the pixel's own extent. The Euler number counts 2 x 2 quads for 4-connectivity.
    """
    base = pix.groupBy(key).agg(
        F.count("*").alias("area"),
        F.avg("py").alias("cy"),
        F.avg("px").alias("cx"),
        F.min("py").alias("min_row"),
        F.min("px").alias("min_col"),
        (F.max("py") + 1).alias("max_row"),
        (F.max("px") + 1).alias("max_col"),
        (F.var_pop("py") + 1 / 12).alias("myy"),
        (F.var_pop("px") + 1 / 12).alias("mxx"),
        F.covar_pop("px", "py").alias("mxy"),
    )
    spread = F.sqrt((F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) + 4 * F.col("mxy") * F.col("mxy"))
    l1, l2 = (F.col("mxx") + F.col("myy") + spread) / 2, (F.col("mxx") + F.col("myy") - spread) / 2
    quads = (
        pix.select(F.col(key), F.inline(F.array(*[F.struct((F.col("py") + a).alias("qy"), (F.col("px") + b).alias("qx"), F.lit(a * 2 + b).alias("at")) for a in (0, 1) for b in (0, 1)])))
        .groupBy(key, "qy", "qx").agg(F.count("*").alias("n"), F.sum("at").alias("s"))
        .groupBy(key)
        .agg(((F.count_if(F.col("n") == 1) - F.count_if(F.col("n") == 3) + 2 * F.count_if((F.col("n") == 2) & (F.col("s") == 3))) / 4).cast("int").alias("euler"))
    )
    return (
        base.withColumn("major_axis", 4 * F.sqrt(l1))
        .withColumn("minor_axis", 4 * F.sqrt(F.greatest(l2, F.lit(0.0))))
        .withColumn("eccentricity", F.sqrt(F.greatest(1 - F.try_divide(l2, l1), F.lit(0.0))))
        .withColumn("equivalent_diameter", F.sqrt(4 * F.col("area") / math.pi))
        .drop("mxx", "myy", "mxy")
        .join(quads, key)
    )


def border_length(pix: DataFrame, cls: int, value: str = "label") -> DataFrame:
    """(py, px, border) of every pixel: neighbours of another class, less equal pairs of them; edges mirror inward."""
    rows, cols = Window.partitionBy("px").orderBy("py"), Window.partitionBy("py").orderBy("px")
    v = F.col(value)
    out = (
        pix.withColumn("n0", F.lag(v).over(rows)).withColumn("n1", F.lead(v).over(rows))
        .withColumn("n2", F.lag(v).over(cols)).withColumn("n3", F.lead(v).over(cols))
    )
    n = [F.coalesce("n0", "n1", v), F.coalesce("n1", "n0", v), F.coalesce("n2", "n3", v), F.coalesce("n3", "n2", v)]
    differs = sum((x != cls).cast("int") for x in n)
    pairs = sum(((n[i] == n[j]) & (n[j] != cls)).cast("int") for i in range(4) for j in range(i + 1, 4))
    return out.where(v == cls).select("py", "px", (differs - pairs).alias("border"))


def box_sum(grid: DataFrame, value: str, width: int) -> DataFrame:
    """grid with the sum over a width x width box, from width/2 before to width/2 - 1 after; zero outside.

    Two running windows, one along rows and one along columns; rows and columns are the groups.
    """
    before, after = width // 2, (width - 1) // 2
    rows = Window.partitionBy("py").orderBy("px").rangeBetween(-before, after)
    cols = Window.partitionBy("px").orderBy("py").rangeBetween(-before, after)
    return grid.withColumn("_s", F.sum(value).over(rows)).withColumn(f"{value}_{width}", F.sum("_s").over(cols)).drop("_s")


def density_windows(
    grid: DataFrame, small: int = 64, big: int = 512, pixel_area: float = 0.5e-6, tissue_limit: float = 0.25
) -> DataFrame:
    """Local and regional density over tissue, the local tissue share, and the quotient of the densities.

    grid: py, px, nucleus (0/1) and tissue (0/1). A density is the sum of nucleus over share * pixel_area * width^2. A
    share of tissue below tissue_limit counts as -1, which makes the density negative; there, and where both densities
    are 0, relative is 0.
    """
    out = grid
    for w in (small, big):
        out = box_sum(box_sum(out, "nucleus", w), "tissue", w)
        share = F.col(f"tissue_{w}") / (w * w)
        out = out.withColumn(f"_share_{w}", F.when(share < tissue_limit, -1.0).otherwise(share))
    d = lambda w: F.col(f"nucleus_{w}") / (F.col(f"_share_{w}") * pixel_area * w * w)
    relative = F.when(F.col(f"_share_{small}") < 0, 0.0).otherwise(F.coalesce(F.try_divide(d(small), d(big)), F.lit(0.0)))
    return out.select(
        "py", "px", d(small).alias("local"), d(big).alias("regional"), F.col(f"_share_{small}").alias("tissue_share"),
        F.greatest(relative, F.lit(0.0)).alias("relative"),
    )


def otsu(values: DataFrame, v: str) -> DataFrame:
    """One row, threshold: the first grey level (0 to 255) that maximises the variance between the classes below and above.

    The histogram has 256 rows; only those are ordered in one place.
    """
    h = values.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("n"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    w1, s1 = F.sum("n").over(up), F.sum(F.col("n") * F.col("v")).over(up)
    w, s = F.sum("n").over(every), F.sum(F.col("n") * F.col("v")).over(every)
    gap = F.try_divide(s1.cast("double"), w1) - F.try_divide((s - s1).cast("double"), w - w1)
    between = h.select("v", (w1 * (w - w1) * gap * gap).alias("score"))
    return between.where("score IS NOT NULL").agg(F.max_by("v", F.struct("score", -F.col("v"))).alias("threshold"))


def resize_nearest(pix: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Nearest resampling: new pixel (i, j) takes the pixel at floor of its scaled place.

    The new pixels of a pixel are made in its row, so no table of new pixels is joined; places are multiplied as longs.
    """
    pix = pix.where(F.col("py").between(0, height - 1) & F.col("px").between(0, width - 1))
    for c, out, n, m in (("py", "i", height, new_height), ("px", "j", width, new_width)):
        # the least number whose scaled place is at least at
        least = lambda at: F.expr(f"({at} * {m}L + {n - 1}) div {n}")  # noqa: B023, E731
        low, high = least(f"CAST({c} AS BIGINT)"), least(f"(CAST({c} AS BIGINT) + 1)") - 1
        pix = pix.where(low <= high).withColumn(out, F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    rest = [c for c in pix.columns if c not in ("py", "px", "i", "j")]
    return pix.select("i", "j", *rest)


def resize_bilinear(pix: DataFrame, v: str, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """(i, j, v): bilinear resampling by pixel centres; each new pixel weighs the four around its place.

    Places beyond the outer centres take the border's value; missing pixels weigh nothing. The pixels of each 2 x 2 square
    meet once; the new pixels that lie between them are made in the square's row, so no table of new pixels is joined.
    """
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    squares = pix.select(F.inline(F.array(*[F.struct((F.col("py") - a).alias("py"), (F.col("px") - b).alias("px"), F.lit(2 * a + b).alias("_at"), F.col(v).alias("_v")) for a, b in corners])))
    squares = squares.where(F.col("py").between(0, height - 1) & F.col("px").between(0, width - 1))
    held = [F.sum(F.when(F.col("_at") == 2 * a + b, f)).alias(f"_{n}{a}{b}") for a, b in corners for n, f in (("s", F.col("_v")), ("n", F.when(F.col("_v").isNotNull(), 1)), ("m", F.lit(1)))]
    met = squares.groupBy("py", "px").agg(*held)
    for c, out, n, m in (("py", "i", height, new_height), ("px", "j", width, new_width)):
        near = F.least(F.greatest((F.col(out) + 0.5) * n / m - 0.5, F.lit(0.0)), F.lit(n - 1.0))
        low = F.when(F.col(c) == 0, 0).otherwise(F.greatest(F.floor((F.col(c) + 0.5) * m / n - 0.5) - 1, F.lit(0)))
        high = F.when(F.col(c) == n - 1, m - 1).otherwise(F.least(F.ceil((F.col(c) + 1.5) * m / n - 0.5) + 1, F.lit(m - 1)))
        met = met.withColumn(out, F.explode(F.sequence(low.cast("int"), high.cast("int")))).withColumn(f"_{out}", near)
        met = met.where(F.floor(f"_{out}") == F.col(c))
    part = lambda c, d: F.col(c) - F.floor(c) if d else 1 - F.col(c) + F.floor(c)
    w = {(a, b): part("_i", a) * part("_j", b) for a, b in corners}
    total = lambda f: sum(F.when(w[q] > 0, F.coalesce(f(q), F.lit(0))).otherwise(0) for q in corners)
    known = total(lambda q: F.col("_n%d%d" % q))
    value = total(lambda q: w[q] * F.col("_s%d%d" % q)) / total(lambda q: w[q] * F.col("_m%d%d" % q))
    seen = total(lambda q: F.col("_m%d%d" % q))
    return met.where(seen > 0).select("i", "j", F.when(known > 0, value).alias(v))


def resize_area(pix: DataFrame, v: str, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """(i, j, v): a new, larger pixel is the mean of those it covers, each by the area in common.

    A source pixel finds the few new ones it touches by itself, so there is no join; missing pixels weigh nothing.
    """
    for c, out, n, m in (("py", "i", height, new_height), ("px", "j", width, new_width)):
        low, high = F.col(c) * m / F.lit(float(n)), (F.col(c) + 1) * m / F.lit(float(n))
        pix = pix.withColumn(out, F.explode(F.sequence(F.floor(low).cast("int"), F.least(F.ceil(high).cast("int") - 1, F.lit(m - 1)))))
        pix = pix.withColumn(f"_{out}", F.least(high, F.col(out) + 1) - F.greatest(low, F.col(out)))
    w = F.col("_i") * F.col("_j")
    return pix.where(w > 1e-9).groupBy("i", "j").agg((F.sum(w * F.col(v)) / F.sum(w)).alias(v))


def stitch(tiles: DataFrame, size: int, inclusive: bool = True) -> DataFrame:
    """Pixels of tiles in scene coordinates from the least tile row and column; not inclusive: the last ones are left out."""
    e = tiles.agg(F.min("tile_row").alias("r0"), F.min("tile_col").alias("c0"), F.max("tile_row").alias("r1"), F.max("tile_col").alias("c1"))
    out = tiles.crossJoin(F.broadcast(e))
    if not inclusive:
        out = out.where("tile_row < r1 AND tile_col < c1")
    place = lambda tile, low, at: ((F.col(tile) - F.col(low)) * size + F.col(at)).cast("int")
    rest = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "y", "x")]
    return out.select(place("tile_row", "r0", "y").alias("py"), place("tile_col", "c0", "x").alias("px"), *rest)


def polygon_pixels(rings: DataFrame) -> DataFrame:
    """(id, py, px) of the pixel places inside polygons (id, ring of points x, y) by the even-odd rule on scan lines."""
    ring = F.col("ring")
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    sides = rings.select("id", F.inline(F.arrays_zip(ring.alias("p"), nxt.alias("q"))))
    sides = sides.where(F.col("p.y") != F.col("q.y"))
    lo, hi = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    rows = sides.withColumn("py", F.explode(F.when(F.ceil(lo) < F.ceil(hi), F.sequence(F.ceil(lo), F.ceil(hi) - 1)))).withColumn(
        "at", F.col("p.x") + (F.col("py") - F.col("p.y")) * (F.col("q.x") - F.col("p.x")) / (F.col("q.y") - F.col("p.y"))
    )
    crossings = rows.groupBy("id", "py").agg(F.sort_array(F.collect_list("at")).alias("at"))
    spans = crossings.select("id", "py", F.posexplode("at").alias("k", "a"), "at").where("k % 2 = 0").withColumn("b", F.get("at", F.col("k") + 1))
    first, last = F.ceil("a"), F.ceil("b") - 1
    return spans.select("id", "py", F.explode(F.when(first <= last, F.sequence(first, last))).alias("px"))


def scales(n: int = 10, top: float = 10.0) -> list[float]:
    """Powers of two from 2^0.01 up to, but without, 2^top."""
    return [2 ** (0.01 + (top - 0.01) * k / n) for k in range(n)]


def box_counts(fg: DataFrame, height: int, width: int, sizes: list[float]) -> DataFrame:
    """(scale, boxes): occupied boxes of each scale; rows are binned along the width and columns along the height.

    Edges run from 0 in steps of the scale below the extent; what lies beyond the last edge is left out, the last bin is
    closed, and scales stop at the first without boxes.
    """
    spark = fg.sparkSession
    bins = [(s, max(math.ceil(width / s) - 1, 0), max(math.ceil(height / s) - 1, 0)) for s in sizes]
    bins = bins[: next((k for k, b in enumerate(bins) if not b[1] or not b[2]), len(bins))]
    table = F.broadcast(spark.createDataFrame(bins, "scale double, ny int, nx int"))
    at = lambda v, n: F.least(F.floor(F.col(v) / F.col("scale")), F.col(n) - 1)
    inside = (F.col("py") <= F.col("ny") * F.col("scale")) & (F.col("px") <= F.col("nx") * F.col("scale"))
    return (
        fg.crossJoin(table).where(inside)
        .select("scale", at("py", "ny").alias("by"), at("px", "nx").alias("bx")).distinct()
        .groupBy("scale").agg(F.count("*").alias("boxes"))
    )


def box_dimension(counts: DataFrame) -> DataFrame:
    return counts.agg((-F.regr_slope(F.log("boxes"), F.log("scale"))).alias("dimension"))


def otsu_mask(pix: DataFrame, v: str) -> DataFrame:
    """pix with above, whether the value lies over the Otsu threshold of all."""
    return pix.crossJoin(F.broadcast(otsu(pix, v))).withColumn("above", F.col(v) > F.col("threshold")).drop("threshold")


def stains(r: Column, g: Column, b: Column, inverse: list[list[float]]) -> list[Column]:
    """Stain amounts: the optical densities of three channels times a 3 x 3 matrix."""
    from ..functions.scalar import optical_density

    od = [optical_density(c) for c in (r, g, b)]
    return [sum(od[i] * inverse[i][k] for i in range(3)) for k in range(3)]
