"""Ordered outlines of regions: directed sides of pixels, linked to rings and ranked by doubling the way along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import closed_ring, geojson_feature, materialize, release

#: Sides of a pixel with the region on their right hand: (start, end) as (dy, dx) from the pixel, and the pixel beyond.
SIDES = [((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 1), (0, 1)), ((1, 1), (1, 0), (1, 0)), ((1, 0), (0, 0), (0, -1))]
#: Bits of a place in a packed key.
_SHIFT = 30


def boundary_sides(pix: DataFrame, key: str = "label") -> DataFrame:
    """(key, py, px, dir, sy, sx, ey, ex, side) of the pixel sides that part a region from what is not the region.

    side numbers a side of any region: its pixel's place and dir. Places are from -2^29 to 2^29 - 1.
    """
    sides = [
        F.struct(
            F.lit(d).alias("dir"), (F.col("py") + s[0]).alias("sy"), (F.col("px") + s[1]).alias("sx"), (F.col("py") + e[0]).alias("ey"),
            (F.col("px") + e[1]).alias("ex"), (F.col("py") + o[0]).alias("oy"), (F.col("px") + o[1]).alias("ox"),
        )
        for d, (s, e, o) in enumerate(SIDES)
    ]
    spread = pix.select(key, "py", "px", F.inline(F.array(*sides)))
    other = pix.select(F.col(key).alias("_key"), F.col("py").alias("oy"), F.col("px").alias("ox"))
    met = spread.join(other, ["oy", "ox"], "left").where(F.col("_key").isNull() | (F.col("_key") != F.col(key)))
    half = F.lit(1 << (_SHIFT - 1)).cast("long")
    number = ((F.col("py") + half) * F.lit(1 << _SHIFT).cast("long") + F.col("px") + half) * 4 + F.col("dir")
    return met.select(key, "py", "px", "dir", "sy", "sx", "ey", "ex", number.alias("side"))


def linked_sides(sides: DataFrame, key: str = "label") -> DataFrame:
    """sides with next, the side that goes on at each one's end, and turn, whether it has another direction.

    Where two begin there, the pixels meet at a corner only, and the one of the same pixel goes on: regions are
    four-connected.
    """
    following = sides.select(
        key, F.col("sy").alias("ey"), F.col("sx").alias("ex"), F.col("side").alias("_next"), F.col("dir").alias("_dir"),
        F.col("py").alias("_py"), F.col("px").alias("_px"),
    )
    other = (F.col("py") != F.col("_py")) | (F.col("px") != F.col("_px"))
    # a turn onto another pixel at a shared corner is to the left, that onto the own pixel to the right
    choice = F.struct((other & (F.pmod(F.col("_dir") - F.col("dir"), F.lit(4)) == 3)).alias("left"), F.col("_next").alias("next"), F.col("_dir").alias("to"))
    best = sides.join(following, [key, "ey", "ex"]).groupBy("side").agg(F.min(choice).alias("c"))
    return sides.join(best, "side").withColumn("next", F.col("c.next")).withColumn("turn", F.col("c.to") != F.col("dir")).drop("c")


def ranked_rings(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(side, ring, behind) of links (side, next), each side the next of one: the least side of its ring, and how many
    sides on that is.

    A round joins each side to the one as far on as the round before reached, so rings of n sides take log2(n) rounds;
    slim rows of longs, and no ring is in one task.
    """
    state = materialize(links.select("side", "next", F.col("side").alias("ring"), F.lit(0).cast("long").alias("behind")))
    step = 1
    for _ in range(max_rounds):
        on = state.select(F.col("side").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), F.col("behind").alias("_behind"))
        less = F.col("_ring") < F.col("ring")
        after = materialize(
            state.join(on, "next").select(
                "side", F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring"),
                F.when(less, F.col("_behind") + step).otherwise(F.col("behind")).alias("behind"), less.alias("moved"),
            )
        )
        release(state)
        state, step = after, step * 2
        if state.where("moved").isEmpty():
            return state.select("side", "ring", "behind")
    raise RuntimeError(f"rings did not close in {max_rounds} rounds")


def contour_points(pix: DataFrame, key: str = "label") -> DataFrame:
    """(key, ring, place, y, x): the corners of the outlines of regions (key, py, px) of a raster, in order.

    A region has a ring for each of its four-connected parts and each hole of it; outer rings run clockwise as seen with
    rows downward, holes the other way. Points are corners of pixels, those on a straight line left out. ring is the
    least side of the ring and place counts its corners from 0, from the first after that side's start.
    """
    linked = materialize(linked_sides(materialize(boundary_sides(pix, key)), key))
    ranked = ranked_rings(linked)
    met = linked.where("turn").select(key, "side", "ey", "ex").join(ranked, "side")
    # a side n before the least one is the last but n - 1 of the ring: the fewer behind, the later, the least side first of all
    order = F.when(F.col("behind") == 0, F.lit(1 << 62).cast("long")).otherwise(F.col("behind"))
    points = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("ey").alias("y"), F.col("ex").alias("x"))), asc=False)
    rings = met.groupBy(key, "ring").agg(points.alias("points"))
    return rings.select(key, "ring", F.posexplode("points").alias("place", "p")).select(key, "ring", "place", "p.y", "p.x")


def contour_rings(pix: DataFrame, key: str = "label", least_points: int = 5) -> DataFrame:
    """(key, ring, points, hole, area): outlines as arrays of points x, y; those of fewer than least_points points go.

    area is what a ring encloses. A ring is one row, as an outline document needs it: it grows with the length of the
    outline, not with the region's area.
    """
    points = contour_points(pix, key)
    rings = points.groupBy(key, "ring").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y"))).alias("p"))
    rings = rings.select(key, "ring", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    twice = shoelace(F.col("points"))
    return rings.where(F.size("points") >= least_points).withColumn("hole", twice < 0).withColumn("area", F.abs(twice) / 2)


def shoelace(points: Column) -> Column:
    """Twice the signed area of a ring of points x, y: positive where it runs clockwise with rows downward."""
    closed = closed_ring(points)
    pairs = F.zip_with(F.slice(closed, F.lit(1), F.size(points)), F.slice(closed, F.lit(2), F.size(points)), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda total, v: total + v)


def below_largest(rings: DataFrame, rank: int = 2) -> DataFrame:
    """rings whose number of points is below the rank-th greatest of the different numbers; all where there are fewer."""
    sizes = rings.select(F.size("points").alias("n")).distinct().orderBy(F.desc("n")).limit(rank)
    cut = F.broadcast(sizes.agg(F.when(F.count("*") == rank, F.min("n")).alias("_cut")))
    return rings.crossJoin(cut).where(F.col("_cut").isNull() | (F.size("points") < F.col("_cut"))).drop("_cut")


def outline_features(rings: DataFrame, **properties: Column) -> DataFrame:
    """(feature): a GeoJSON polygon for each ring."""
    return rings.select(geojson_feature(F.col("points"), **properties).alias("feature"))
