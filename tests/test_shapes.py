"""Hull measures, axes, box dimensions, concave areas and the triangulation's tables against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import delaunay, raster, shapes, spatial, stains


def raster_of(spark, places, schema="label int, py int, px int"):
    return spark.createDataFrame(places, schema)


def hull_pixels(places):
    """Pixels whose centre no line through two middles of sides parts from all the middles."""
    pts = sorted({(2 * y + a, 2 * x + b) for y, x in places for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))})
    cross = lambda p, q, r: (q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1])
    sides = [(p, q) for p, q in itertools.permutations(pts, 2) if all(cross(p, q, r) >= 0 for r in pts)]
    ys, xs = zip(*places, strict=True)
    return sum(all(cross(p, q, (2 * y, 2 * x)) >= 0 for p, q in sides) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1))


def test_convex_areas_equal_half_planes(spark):
    rng = random.Random(5)
    regions = {1: [(0, 0)], 2: [(3, 3), (3, 9)], 3: [(-4, -4), (-3, -3), (-2, -2)], 4: [(y, 0) for y in range(5)] + [(0, x) for x in range(5)]}
    for k in range(5, 12):
        regions[k] = sorted({(rng.randrange(-6, 8), rng.randrange(-9, 6)) for _ in range(12)})
    found = shapes.convex_areas(raster_of(spark, [(k, y, x) for k, r in regions.items() for y, x in r]))
    got = {r["label"]: r["convex_area"] for r in found.collect()}
    assert got == {k: hull_pixels(r) for k, r in regions.items()} and got[1] == 1 and got[3] == 3
    assert shapes.convex_areas(raster_of(spark, [])).count() == 0


def test_convex_area_does_not_depend_on_cells(spark, monkeypatch):
    places = [(1, y, x) for y in range(0, 90, 7) for x in range(-40, 60, 9) if (y * 3 + x) % 5]
    whole = shapes.convex_areas(raster_of(spark, places)).collect()
    monkeypatch.setattr(shapes, "hull_edges", lambda m: spatial.hull_edges(m, cell=16))
    assert shapes.convex_areas(raster_of(spark, places)).collect() == whole


def squares(at, size=9):
    return [(1, k, y0 + y, x0 + x) for k, (y0, x0) in enumerate(at, 1) for y in range(size) for x in range(size)]


@pytest.mark.parametrize(("at", "major", "minor"), [
    ([(0, 0), (1, 20), (0, 40)], 3, 1), ([(0, 0), (20, 1), (41, 0)], 3, 1), ([(0, 0), (20, 20), (40, 41)], 3, 1), ([(0, 0), (3, 40)], 2, 0),
    ([(0, 40), (20, 20), (41, 0)], 3, 1),
])
def test_nuclei_on_axes(spark, at, major, minor):
    """Lines run through three squares in a row, across the middle one, and through none between two."""
    pix = spark.createDataFrame(squares(at), "agg int, label int, py int, px int")
    row = shapes.axis_counts(pix, shapes.moments(pix, "agg"), "agg", "label").first()
    assert (row["num_labels"], row["num_major"], row["num_minor"]) == (len(at), major, minor)


def test_orientation_of_bars(spark):
    bars = {1: [(y, 0) for y in range(9)], 2: [(0, x) for x in range(9)], 3: [(k, k) for k in range(9)], 4: [(k, -k) for k in range(9)], 5: [(0, 0)]}
    got = {r["label"]: r for r in shapes.moments(raster_of(spark, [(k, y, x) for k, b in bars.items() for y, x in b])).collect()}
    assert abs(got[1]["orientation"]) < 1e-9 and abs(abs(got[2]["orientation"]) - math.pi / 2) < 1e-9
    assert [round(got[k]["orientation"] / math.pi, 9) for k in (3, 4, 5)] == [0.25, -0.25, -0.25]
    assert got[5]["eccentricity"] == 0 and got[1]["eccentricity"] > 0.9


def test_box_dimension_equals_that_of_one_raster(spark):
    places = [(7, y, x) for y in range(40) for x in range(64) if (y * x) % 3 == 0 or y < 10]
    pix = raster_of(spark, places)
    one = raster.box_dimension(raster.box_counts(pix.select((F.col("py") + 1).alias("py"), (F.col("px") + 1).alias("px")), 42, 66, raster.scales()))
    own = shapes.box_dimensions(pix.withColumn("py", F.col("py") - 100), shapes.moments(pix.withColumn("py", F.col("py") - 100)), "label")
    assert abs(own.first()["dimension"] - one.first()["dimension"]) < 1e-12


def ring_points(radius, n, gap=0):
    return [(round(1000 + radius * math.cos(2 * math.pi * k / n)), round(1000 + radius * math.sin(2 * math.pi * k / n))) for k in range(gap, n)]


def shoelace(ring):
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def concave(spark, rows, radius):
    p = spark.createDataFrame([(i, n, x, y) for i, pts in rows.items() for n, (x, y) in enumerate(pts)], "image_id int, nid long, x long, y long")
    corners = delaunay.with_corners(delaunay.delaunay(p), p)
    return {r["image_id"]: r for r in delaunay.concave_areas(corners, delaunay.alpha_triangles(corners, 1 / radius)).collect()}


def test_holes_of_kept_triangles_are_filled(spark):
    """A closed ring, one with an island in its hole, one that is open, and points too far apart to be kept."""
    outer, inner, island = ring_points(500, 48), ring_points(440, 48), [(980, 990), (1030, 985), (1005, 1040)]
    opened = ring_points(500, 48, 9) + ring_points(440, 48, 9)
    got = concave(spark, {1: outer + inner, 2: outer + inner + island, 3: opened, 4: [(0, 0), (9000, 1), (4000, 7000)]}, 90)
    assert abs(got[1]["area"] - shoelace(outer)) < 1 and got[1]["enclosed_area"] > got[1]["kept_area"]
    assert abs(got[2]["area"] - shoelace(outer)) < 1 and abs(got[2]["kept_area"] - got[1]["kept_area"] - shoelace(island)) < 1
    assert got[3]["enclosed_area"] == 0 and 0 < got[3]["area"] < got[1]["kept_area"]
    assert (got[4]["kept_area"], got[4]["enclosed_area"], got[4]["area"]) == (0, 0, 0)


def test_concave_area_fills_what_kept_triangles_enclose(spark, monkeypatch):
    from pointweave import catalog_points

    outer, inner = ring_points(500, 48), ring_points(440, 48)
    rows = [(1, n, x, y) for n, (x, y) in enumerate(outer + inner)] + [(2, n, x, y) for n, (x, y) in enumerate([(0, 0), (9000, 1), (4000, 7000)])]
    p = spark.createDataFrame(rows, "image_id int, nid long, x long, y long")
    monkeypatch.setattr(catalog_points, "_triangulated", lambda spark, d: (p, delaunay.delaunay_corners(p)))
    got = {r["image_id"]: r for r in catalog_points.concave_area(spark, "").collect()}
    assert abs(got[1]["area"] - shoelace(outer)) < 1 and abs(got[1]["enclosed_area"] - shoelace(inner)) < 1 and got[1]["n"] == 96
    assert (got[2]["kept_area"], got[2]["enclosed_area"], got[2]["area"], got[2]["n"]) == (0, 0, 0, 0)


@pytest.fixture(scope="module")
def small(spark):
    """Two images of points in general position, with triangles by testing every triple's circle against every point."""
    rng, rows, tri = random.Random(8), [], []
    for image in (1, 2):
        pts = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(16)]
        rows += [(image, n, x, y) for n, (x, y) in enumerate(pts)]
        tri += [(image, *t) for t in itertools.combinations(range(16), 3) if empty(pts, t)]
    return rows, tri, spark.createDataFrame(rows, "image_id int, nid long, x long, y long")


def empty(pts, t):
    (ax, ay), (bx, by), (cx, cy) = (pts[k] for k in t)
    turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def inside(p):
        m = [[x - p[0], y - p[1], (x - p[0]) ** 2 + (y - p[1]) ** 2] for x, y in ((ax, ay), (bx, by), (cx, cy))]
        d = sum(m[i][0] * (m[(i + 1) % 3][1] * m[(i + 2) % 3][2] - m[(i + 2) % 3][1] * m[(i + 1) % 3][2]) for i in range(3))
        return d * turn > 0

    return turn != 0 and not any(inside(p) for k, p in enumerate(pts) if k not in t)


def test_tables_of_a_triangulation_equal_loops(spark, small):
    rows, tri, p = small
    at = {(i, n): (x, y) for i, n, x, y in rows}
    t = delaunay.delaunay(p)
    assert sorted(tuple(r) for r in t.collect()) == sorted(tri)
    pairs = lambda s: [(s[0], *e) for e in itertools.combinations(s[1:], 2)]
    assert sorted(tuple(r) for r in delaunay.edges(t).collect()) == sorted({e for s in tri for e in pairs(s)})
    graph = {(i, a, b) for (i, a), (j, b) in itertools.combinations(sorted(at), 2) if i == j and math.dist(at[i, a], at[i, b]) <= 1100}
    g = spatial.radius_edges(p, 1100)
    for complete, test in ((True, all), (False, any)):
        want = sorted(s for s in tri if test(e in graph for e in pairs(s)))
        assert sorted(tuple(r) for r in delaunay.constrained(t, g, complete).collect()) == want and 0 < len(want) < len(tri)
    corners = delaunay.with_corners(t, p)
    area = {s: abs(np.cross(np.subtract(*(at[s[0], k] for k in (s[2], s[1]))).tolist() + [0], np.subtract(*(at[s[0], k] for k in (s[3], s[1]))).tolist() + [0])[2]) / 2 for s in tri}
    circle = {s: math.prod(math.dist(at[e[0], e[1]], at[e[0], e[2]]) for e in pairs(s)) / (4 * area[s]) for s in tri}
    kept = {(r["image_id"], r["a"], r["b"], r["c"]) for r in delaunay.alpha_triangles(corners, 1 / 700).collect()}
    assert kept == {s for s in tri if circle[s] < 700} and 0 < len(kept) < len(tri)
    dens = {(r["image_id"], r["nid"]): r["dtfe"] for r in delaunay.density(corners).collect()}
    own = {k: [area[s] for s in tri if k[0] == s[0] and k[1] in s[1:]] for k in at}
    assert all(abs(dens[k] - len(v) / sum(v)) < 1e-12 for k, v in own.items())
    grid = {(r["image_id"], r["gx"], r["gy"]): r["density"] for r in delaunay.gridded(corners, delaunay.density(corners), 250).collect()}
    for (i, gx, gy), value in grid.items():
        for s in tri:
            m = np.array([[*at[s[0], k], 1.0] for k in s[1:]]).T
            w = np.linalg.solve(m, [gx, gy, 1.0])
            if s[0] == i and (w > 1e-9).all():
                assert abs(value - sum(w[j] * dens[i, s[j + 1]] for j in range(3))) < 1e-12
    holds = lambda s, x, y: (np.linalg.solve(np.array([[*at[s[0], k], 1.0] for k in s[1:]]).T, [x, y, 1.0]) > 1e-9).all()
    assert set(grid) >= {(s[0], x, y) for s in tri for x in range(0, 4000, 250) for y in range(0, 4000, 250) if holds(s, x, y)}


def test_normalised_pixels(spark):
    """Pixels of two stains take the wanted colours; with equal stains they stay; kept pixels stay."""
    basis, target = [[0.55, 0.75, 0.35], [0.2, 0.9, 0.35]], [[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]]
    amounts = [(0.2, 0.1), (0.8, 0.3), (0.1, 0.9), (0.0, 0.0)]
    light = lambda rows, a: 256 * np.exp(-(np.array(a) @ stains.unit_rows(rows))) - 1
    pix = spark.createDataFrame([(0, k, *map(float, light(basis, a))) for k, a in enumerate(amounts)], "py int, px int, r double, g double, b double")
    got = sorted(tuple(r) for r in stains.normalize_stains(pix, basis, target).select("px", "r", "g", "b").collect())
    want = [(k, *(int(round(v, 6)) for v in light(target, a))) for k, a in enumerate(amounts)]
    assert got == want and got[3] == (3, 255, 255, 255)
    same = stains.normalize_stains(pix, basis, basis).join(pix.toDF("y0", "px", "r0", "g0", "b0"), "px")
    assert same.where("abs(r - r0) > 1 OR abs(g - g0) > 1 OR abs(b - b0) > 1").isEmpty()
    held = stains.normalize_stains(pix, basis, target, F.col("px") == 1).where("px = 1").first()
    assert abs(held["r"] - light(basis, amounts[1])[0]) < 1e-9


@pytest.mark.parametrize("mode", ["dtfe", "bbox", "convex"])
@pytest.mark.parametrize("buffer", [1, 2])
def test_included_pixels_equal_loops(spark, mode, buffer):
    rng = random.Random(8)
    size = 24
    places = {(y, x): rng.randrange(1, 6) for y in range(size) for x in range(size) if rng.random() < 0.4}
    members = [(1, 1), (1, 2), (2, 4), (2, 4), (3, 99)]
    want = set()
    for k in (1, 2):
        own = [p for p, label in places.items() if (k, label) in members and max(p) <= size - buffer - 1]
        r0, c0 = (max(min(p[i] for p in own), buffer) - buffer for i in (0, 1))
        r1, c1 = (max(p[i] for p in own) + buffer for i in (0, 1))
        take = [p for p in places if r0 <= p[0] < r1 and c0 <= p[1] < c1]
        if mode == "dtfe":
            take = own
        elif mode == "convex":
            pts = sorted({(2 * y + a, 2 * x + b) for y, x in own for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))})
            cross = lambda p, q, r: (q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1])
            sides = [(p, q) for p, q in itertools.permutations(pts, 2) if all(cross(p, q, r) >= 0 for r in pts)]
            take = [p for p in take if all(cross(*e, (2 * p[0], 2 * p[1])) >= 0 for e in sides)]
        want |= {(k, y, x, y - r0, x - c0) for y, x in take}
    mask = spark.createDataFrame([(y, x, label) for (y, x), label in places.items()], "py int, px int, label int")
    found = shapes.included_pixels(mask, spark.createDataFrame(members, "component int, label int"), size, size, mode, buffer).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_fitted_grid_is_linear_and_reaches_the_ends(spark):
    """Densities that are a plane over the square's corners come back at every place of the grid."""
    at = [(0, 0), (90, 0), (0, 30), (90, 30), (45, 10)]
    points = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(at)], "image_id int, nid long, x long, y long")
    dens = spark.createDataFrame([(1, k, 1.0 + x / 90 + y / 30) for k, (x, y) in enumerate(at)], "image_id int, nid long, dtfe double")
    c = delaunay.with_corners(delaunay.delaunay(points), points)
    values = [1.0 + x / 90 + y / 30 for x, y in at]
    q = math.sqrt(float(np.median(values)) + 5 * float(np.std(values)))
    f = delaunay.grid_sizes(c, dens).first()
    assert (f["x_size"], f["y_size"]) == (int(q * 10 * 3), int(q * 10))
    got = {(r["gi"], r["gj"]): r["density"] for r in delaunay.gridded_to_fit(c, dens).collect()}
    assert len(got) == f["x_size"] * f["y_size"]
    assert all(v == pytest.approx(1 + i / (f["x_size"] - 1) + j / (f["y_size"] - 1)) for (i, j), v in got.items())
