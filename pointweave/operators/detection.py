"""Nuclei from pixels: local thresholds, refinement of objects, markers and a watershed, over the whole slide at once.

Rasters are rows (py, px, value); objects are components of a slide, so no tile border cuts one. A threshold of each
object is a grouped histogram and a neighbourhood is a join on places. Only the flood holds one object in a task, as plain
arrays.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import circularity
from ..sources.storage import broadcast_if_small, materialize
from .raster import EIGHT, FOUR, label_components, otsu, region_properties, remove_small, stains

PLACE = ["py", "px"]
#: Side of the cells through which windows meet pixels.
CELL = 64
#: Pixels whose neighbours a flood looks up at once, and rows of a batch that it hands on.
WHOLE_PIXELS, ROWS = 1024 * 1024, 100_000
#: Share of the marker threshold, and weight of a pixel's way to its marker in the flood.
MARKER_SHARE, COMPACTNESS = 0.85, 50.0


def grouped_otsu(values: DataFrame, key: str, v: str, n: str | None = None) -> DataFrame:
    """(key, threshold): the first level of v that maximises the variance between the classes up to it and above.

    Levels are few (grey levels or bins), so a group's histogram is short. Groups of one level have no row. n: a column
    of how many values a row stands for.
    """
    h = values.groupBy(key, F.col(v).alias("v")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    up = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    w1, s1 = F.sum("n").over(up), F.sum(F.col("n") * F.col("v")).over(up)
    w, s = F.sum("n").over(every), F.sum(F.col("n") * F.col("v")).over(every)
    gap = F.try_divide(s1.cast("double"), w1) - F.try_divide((s - s1).cast("double"), w - w1)
    between = h.select(key, "v", (w1 * (w - w1) * gap * gap).alias("score"))
    return between.where("score IS NOT NULL").groupBy(key).agg(F.max_by("v", F.struct("score", -F.col("v"))).alias("threshold"))


def fill_small_holes(fg: DataFrame, grid: DataFrame, least: int) -> DataFrame:
    """fg (py, px) with the four-connected components of fewer than least pixels of the rest of grid."""
    fg = fg.select(*PLACE)
    ground = materialize(label_components(grid.select(*PLACE).join(fg.hint("merge"), PLACE, "left_anti")))
    small = ground.groupBy("component").count().where(F.col("count") < least).select("component")
    return fg.unionAll(ground.join(broadcast_if_small(materialize(small)), "component", "left_semi").select(*PLACE))


def by_cells(pix: DataFrame, windows: DataFrame, work, schema: str) -> DataFrame:
    """work(pixels, windows) -> rows for every cell of pix (py, px, ...), with the windows (y0, y1, x0, x1, half open)
    that reach into it; both are Arrow tables, so pairs of a pixel and a window are never rows."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    rows, cols = (F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)) for a, b in (("y0", "y1"), ("x0", "x1")))
    spread = windows.where("y1 > y0 AND x1 > x0").withColumn("_cy", F.explode(rows)).withColumn("_cx", F.explode(cols))
    placed = pix.withColumn("_cy", cell("py")).withColumn("_cx", cell("px"))
    return placed.groupBy("_cy", "_cx").cogroup(spread.groupBy("_cy", "_cx")).applyInArrow(work, schema)


def _inside(pixels, windows):
    """For each window of a cell, which of the cell's pixels it holds."""
    y, x = (pixels[c].to_numpy() for c in PLACE)
    for y0, y1, x0, x1 in zip(*(windows[c].to_numpy() for c in ("y0", "y1", "x0", "x1")), strict=True):
        yield (y >= y0) & (y < y1) & (x >= x0) & (x < x1)


def window_levels(pix: DataFrame, windows: DataFrame, v: str) -> DataFrame:
    """(component, v, n) counts of the levels in parts of the windows of components."""
    import pyarrow as pa

    def count(pixels: pa.Table, windows: pa.Table) -> pa.Table:
        level, at = np.unique(pixels[v].to_numpy(), return_inverse=True)
        counts = [np.bincount(at[m], minlength=len(level)) for m in _inside(pixels, windows)]
        w, k = np.nonzero(np.array(counts, np.int64).reshape(len(windows), len(level)))
        n = np.array(counts, np.int64)[w, k] if len(w) else np.zeros(0, np.int64)
        return pa.table([windows["component"].take(pa.array(w, pa.int64())), pa.array(level[k]), pa.array(n)], names=["component", v, "n"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return by_cells(pix, windows, count, f"component {kind(windows, 'component')}, {v} {kind(pix, v)}, n long")


def darker_in_windows(pix: DataFrame, windows: DataFrame, v: str) -> DataFrame:
    """(py, px) of the pixels below the threshold of a window that holds them."""
    import pyarrow as pa

    def keep(pixels: pa.Table, windows: pa.Table) -> pa.Table:
        level, dark = pixels[v].to_numpy(), np.zeros(len(pixels), bool)
        for m, limit in zip(_inside(pixels, windows), windows["threshold"].to_numpy(), strict=True):
            dark |= m & (level < limit)
        y, x = np.unique(np.stack([pixels[c].to_numpy()[dark] for c in PLACE]), axis=1)
        return pa.table([pa.array(y), pa.array(x)], names=PLACE)

    return by_cells(pix, windows, keep, ", ".join(f"{c} {pix.schema[c].dataType.simpleString()}" for c in PLACE))


def local_foreground(
    pix: DataFrame, limit: int = 140, ratio: float = 3.0, least: int = 16, hole: int = 24, v: str = "stain"
) -> DataFrame:
    """(py, px) of pixels darker than the threshold of an object in whose window they lie.

    pix: py, px and v, a grey level. Objects are eight-connected pixels above 0 and up to the Otsu threshold of all levels
    below limit, in four-connected components of least pixels. Each gets a window of its box and ratio equivalent
    diameters around, and the Otsu threshold of the levels below limit there, or limit where those are one level. Holes
    of fewer than hole pixels are filled and components of fewer than least go.
    """
    dark = pix.where(F.col(v) < limit)
    first = pix.crossJoin(F.broadcast(otsu(dark, v))).where((F.col(v) <= F.col("threshold")) & (F.col(v) > 0)).select(*PLACE)
    kept = remove_small(materialize(label_components(first)), least).select(*PLACE)
    around = ratio * F.sqrt(4 * F.count("*") / math.pi)
    windows = label_components(kept, EIGHT).groupBy("component").agg(
        F.bround(F.min("py") - around).alias("y0"), F.bround(F.max("py") + 1 + around).alias("y1"),
        F.bround(F.min("px") - around).alias("x0"), F.bround(F.max("px") + 1 + around).alias("x1"),
    )
    windows = materialize(windows)
    own = grouped_otsu(window_levels(dark.select(*PLACE, v), windows, v), "component", v, "n")
    own = windows.join(own, "component", "left").withColumn("threshold", F.coalesce("threshold", F.lit(limit)))
    darker = darker_in_windows(pix.select(*PLACE, v).where(F.col(v).isNotNull()), materialize(own), v)
    filled = materialize(fill_small_holes(materialize(darker), pix, hole))
    return remove_small(label_components(filled), least).select(*PLACE)


def refine_objects(fg: DataFrame, pix: DataFrame, rounds: int = 5, least: int = 32, most: int = 256, v: str = "stain") -> DataFrame:
    """(py, px) of fg after rounds in which objects of most pixels and more are cut by their own Otsu threshold.

    In each round holes of fewer than least / 2 pixels are filled and eight-connected objects of fewer than least go. An
    object of most pixels is grown by one step within its box and keeps what is not above the threshold of its levels.
    Rounds end early once no object is that large, since another round changes nothing.
    """

    def clean(fg):
        filled = materialize(fill_small_holes(fg, pix, least // 2))
        return materialize(remove_small(materialize(label_components(filled, EIGHT)), least))

    objects = clean(fg.select(*PLACE))
    for _ in range(rounds):
        boxes = objects.groupBy("component").agg(
            F.count("*").alias("area"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.min("px").alias("x0"), F.max("px").alias("x1")
        )
        large = materialize(boxes.where(F.col("area") >= most))
        if large.isEmpty():
            break
        few = broadcast_if_small(large)
        mine = objects.join(few, "component")
        steps = F.array(*[F.struct((F.col("py") + a).alias("py"), (F.col("px") + b).alias("px")) for a, b in [(0, 0), *FOUR]])
        grown = mine.select("component", "y0", "y1", "x0", "x1", F.inline(steps)).where("py BETWEEN y0 AND y1 AND px BETWEEN x0 AND x1")
        grown = materialize(grown.select("component", *PLACE).distinct().join(pix.select(*PLACE, v).hint("merge"), PLACE))
        cut = grown.join(grouped_otsu(grown, "component", v), "component", "left")
        cut = cut.where(F.col("threshold").isNull() | (F.col(v) <= F.col("threshold"))).select(*PLACE)
        objects = clean(objects.join(few, "component", "left_anti").select(*PLACE).unionAll(cut).distinct())
    return objects.select(*PLACE)


def median_disk(fg: DataFrame, grid: DataFrame, radius: int = 3) -> DataFrame:
    """(py, px) of grid where most of the disk around is foreground; what lies outside grid is background."""
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    steps = F.array(*[F.struct((F.col("py") + a).alias("py"), (F.col("px") + b).alias("px")) for a, b in disk])
    most = fg.select(F.inline(steps)).groupBy(*PLACE).count().where(F.col("count") > len(disk) // 2)
    return most.select(*PLACE).join(grid.select(*PLACE).hint("merge"), PLACE, "left_semi")


def distance_transform(fg: DataFrame) -> DataFrame:
    """fg (py, px) with d2, the squared distance to the nearest pixel that is not foreground, exactly.

    What lies outside the raster counts as background. First the way along the column, from the ends of its run; then the
    least sum over the places of the row that are nearer than both of a pixel's straight ways.
    """

    def way(along, across, name):
        run = Window.partitionBy(across).orderBy(along)
        placed = F.col(along) - F.row_number().over(run)
        whole = Window.partitionBy(across, "_run")
        return lambda df: df.withColumn("_run", placed).withColumn(
            name, F.least(F.col(along) - F.min(along).over(whole), F.max(along).over(whole) - F.col(along)) + 1
        ).drop("_run")

    ways = materialize(way("px", "py", "h")(way("py", "px", "g")(fg.select(*PLACE).distinct())))
    near = F.least("g", "h") - 1
    asked = ways.select("py", F.col("px").alias("at"), F.explode(F.sequence(-near, near)).alias("dx")).withColumn("px", F.col("at") + F.col("dx"))
    met = asked.join(ways.select(*PLACE, "g").hint("merge"), PLACE).groupBy("py", F.col("at").alias("px")).agg(F.min(F.col("dx") * F.col("dx") + F.col("g") * F.col("g")).alias("d"))
    straight = F.col("h") * F.col("h")
    return ways.join(met.hint("merge"), PLACE).select(*PLACE, F.least("d", straight).cast("long").alias("d2"))


def nucleus_markers(fg: DataFrame, pix: DataFrame, share: float = MARKER_SHARE, v: str = "stain") -> DataFrame:
    """(py, px, label) of the cores of fg's objects: pixels where depth and darkness together are high for the object.

    The distance to the background and the inverted level are each stretched to 0..255 within an eight-connected object
    (from 0 where it leaves a pixel of its box free) and averaged. A core is above share times the Otsu threshold of the
    object's values in 256 bins, or above half of the greatest where they are one value. label: a number of the core, by
    its least place, whose row and column are from 0 to 2^31 - 2.
    """
    fg, top = fg.select(*PLACE), pix.agg(F.max(v).alias("_dark"), F.min(v).alias("_bright"))
    darkness = F.coalesce(F.try_divide((F.col("_dark") - F.col(v)) * 255.0, F.col("_dark") - F.col("_bright")), F.lit(0.0))
    objects = label_components(fg, EIGHT).join(distance_transform(fg).hint("merge"), PLACE).join(pix.select(*PLACE, v).hint("merge"), PLACE).crossJoin(F.broadcast(top))
    objects = materialize(objects.select("component", *PLACE, F.sqrt("d2").alias("depth"), darkness.alias("dark")))
    extent = lambda c: F.max(c) - F.min(c) + 1
    full = F.count("*") == extent("py") * extent("px")
    ranges = objects.groupBy("component").agg(
        *[f.alias(f"{c}_{k}") for c in ("depth", "dark") for k, f in (("low", F.when(full, F.min(c)).otherwise(0.0)), ("high", F.max(c)))]
    )
    stretched = lambda c: F.coalesce(F.try_divide((F.col(c) - F.col(f"{c}_low")) * 255, F.col(f"{c}_high") - F.col(f"{c}_low")), F.lit(0.0))
    both = materialize(objects.join(ranges, "component").select("component", *PLACE, ((stretched("depth") + stretched("dark")) / 2).alias("both")))
    span = both.where("both > 0").groupBy("component").agg(F.min("both").alias("low"), F.max("both").alias("high"))
    placed = both.where("both > 0").join(span, "component")
    binned = placed.where("high > low").withColumn("bin", F.least(F.floor((F.col("both") - F.col("low")) * 256 / (F.col("high") - F.col("low"))), F.lit(255)))
    limit = F.when(
        F.col("threshold").isNotNull(), share * (F.col("low") + (F.col("threshold") + 0.5) * (F.col("high") - F.col("low")) / 256)
    ).otherwise(F.col("high") / 2)
    limits = span.join(grouped_otsu(binned, "component", "bin"), "component", "left").select("component", limit.alias("limit"))
    cores = materialize(both.join(limits, "component").where("both > limit").select(*PLACE))
    number = F.col("component.py").cast("long") * F.lit(1 << 31).cast("long") + F.col("component.px") + 1
    return label_components(cores, EIGHT).select(*PLACE, number.alias("label"))


def flood(y: np.ndarray, x: np.ndarray, v: np.ndarray, label: np.ndarray, compactness: float, block: int = WHOLE_PIXELS) -> np.ndarray:
    """Labels of the pixels of one object after a flood from those with a label above 0; 0 on lines and where none comes.

    Pixels come by row and column. They wait in a queue by their level plus compactness times the distance to the marker
    pixel from which they were reached, then in the order in which they were reached. One that leaves the queue takes its
    marker's label and puts its four-neighbours in, unless it touches another label: then it is part of a line. An object
    takes some 40 bytes a pixel besides the queue, whatever its size; block pixels look up their neighbours at once.
    """
    size, y, x = len(y), y.astype(np.int64), x.astype(np.int64)
    wide = int(np.ptp(x)) + 2 if size else 2
    place = (y - y[:1]) * wide + x - (x.min() if size else 0)
    near = np.empty((size, 4), np.int64)
    for at in range(0, size, block):
        for c, step in enumerate((-wide, -1, 1, wide)):
            wanted = place[at : at + block] + step
            k = np.minimum(np.searchsorted(place, wanted), size - 1)
            near[at : at + block, c] = np.where(place[k] == wanted, k, -1)
    del place
    out, level, order = array("q", np.where(label > 0, label, 0).astype(np.int64).tobytes()), array("d", v.astype(np.float64).tobytes()), itertools.count()
    beside, ys, xs = array("q", near.tobytes()), array("q", y.tobytes()), array("q", x.tobytes())
    del near

    def reach(k, source):
        for n in beside[4 * k : 4 * k + 4]:
            if n >= 0 and not out[n]:
                way = math.hypot(ys[n] - ys[source], xs[n] - xs[source])
                heapq.heappush(queue, (level[n] + compactness * way, next(order), n, source))

    queue: list = []
    marked = np.flatnonzero(label > 0)
    for k in marked[np.argsort(v[marked], kind="stable")].tolist():
        reach(k, k)
    while queue:
        _, _, k, source = heapq.heappop(queue)
        if out[k] or any(n >= 0 and out[n] not in (0, out[source]) for n in beside[4 * k : 4 * k + 4]):
            continue
        out[k] = out[source]
        reach(k, source)
    return np.frombuffer(out, np.int64)


def watershed(pix: DataFrame, markers: DataFrame, compactness: float = COMPACTNESS, v: str = "stain") -> DataFrame:
    """(py, px, label) of pix (py, px, v), flooded from markers (py, px, label long above 0); null on lines and unreached.

    Eight-connected objects are flooded one by one, see flood, each whole in one task: a flood has one order of its pixels,
    so a cut of an object would move its lines.
    """
    import pyarrow as pa

    block = WHOLE_PIXELS
    objects = materialize(label_components(pix.select(*PLACE), EIGHT))
    key = ["oy", "ox"]
    placed = objects.select(F.col("component.py").alias("oy"), F.col("component.px").alias("ox"), *PLACE)
    met = placed.join(pix.select(*PLACE, F.col(v).cast("double").alias("v")).hint("merge"), PLACE).join(markers.select(*PLACE, F.col("label").cast("long")).hint("merge"), PLACE, "left")
    dealt = met.select(*key, "py", "px", "v", F.coalesce("label", F.lit(0)).alias("label")).repartition(*key).sortWithinPartitions(*key, *PLACE)

    def run(batches):
        def done(parts):
            y, x, v, label = (np.concatenate(c) for c in list(zip(*parts, strict=True))[2:])
            label = flood(y, x, v, label, compactness, block)
            for at in range(0, len(y), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS], kind) for c, kind in ((y, pa.int32()), (x, pa.int32()), (label, pa.int64()))], names=["py", "px", "label"])

        held: list = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = np.stack(cols[:2])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if held and a < b and any(held[0][i][0] != cols[i][a] for i in range(2)):
                    yield from done(held)
                    held = []
                if a < b:
                    held.append([c[a:b] for c in cols])
        if held:
            yield from done(held)

    flooded = dealt.mapInArrow(run, "py int, px int, label long")
    return flooded.select(*PLACE, F.when(F.col("label") > 0, F.col("label")).alias("label"))


def perimeters(pix: DataFrame, key: str = "label") -> DataFrame:
    """(key, perimeter) of regions (key, py, px): the length of the line through the pixels on their border.

    A border pixel has a four-neighbour outside its region. Its length follows from how many four-neighbours and
    diagonal ones are border pixels too.
    """
    own = pix.select(key, *PLACE)
    shifted = lambda df, moves: df.select(key, F.inline(F.array(*[F.struct((F.col("py") + a).alias("py"), (F.col("px") + b).alias("px"), F.lit(abs(a) + abs(b)).alias("step")) for a, b in moves])))
    inner = shifted(own, FOUR).groupBy(key, *PLACE).count().where("count = 4").select(key, *PLACE)
    border = materialize(own.join(inner.hint("merge"), [key, *PLACE], "left_anti"))
    near = shifted(border, EIGHT).groupBy(key, *PLACE).agg(F.count_if(F.col("step") == 1).alias("a"), F.count_if(F.col("step") == 2).alias("b"))
    # fixed values: lengths by (four-neighbours, diagonal neighbours)
    straight, slanted, mixed = [(2, 0), (3, 0), (2, 1), (3, 1), (2, 2), (3, 2)], [(0, 2), (1, 3)], [(1, 1), (1, 2)]
    among = lambda pairs: F.struct("a", "b").isin(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in pairs])
    length = F.when(among(straight), 1.0).when(among(slanted), math.sqrt(2)).when(among(mixed), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    found = border.join(near.hint("merge"), [key, *PLACE], "left").withColumn("length", length)
    return found.groupBy(key).agg(F.sum("length").alias("perimeter"))


def stain_level(pix: DataFrame, inverse: list[list[float]], k: int = 0) -> DataFrame:
    """(py, px, stain): the grey level that light through stain k alone would leave of 255."""
    amount = stains(F.col("r"), F.col("g"), F.col("b"), inverse)[k]
    return pix.select(*PLACE, F.floor(F.least(F.greatest(255 * F.exp(-amount), F.lit(0.0)), F.lit(255.0))).cast("int").alias("stain"))


def detect_nuclei(
    pix: DataFrame, inverse: list[list[float]], limit: int = 140, least_area: float = 6.0, compactness: float = COMPACTNESS
) -> DataFrame:
    """(py, px, label) of the nuclei of a slide (py, px, r, g, b); label is the number of a nucleus's core.

    The nuclear stain is thresholded around each object, large objects are cut again, a median smooths them, cores are
    grown by a watershed, and its lines separate nuclei. Nuclei of fewer than least_area pixels, with an Euler number
    below -1 or a circularity below 0.3 go. Black and missing pixels are no nuclei. An empty slide has none.
    """
    level = materialize(stain_level(pix, inverse))
    fg = refine_objects(materialize(local_foreground(level, limit)), level)
    fg = materialize(median_disk(fg, level))
    grown = watershed(level.join(fg.hint("merge"), PLACE, "left_semi"), nucleus_markers(fg, level), compactness)
    regions = materialize(grown.where("label IS NOT NULL"))
    shape = region_properties(regions).join(perimeters(regions), "label")
    good = (F.col("area") >= least_area) & (F.col("euler") >= -1) & F.coalesce(circularity(F.col("area"), F.col("perimeter")) >= 0.3, F.lit(True))
    return regions.join(shape.where(good).select("label"), "label", "left_semi").select(*PLACE, "label")
