"""Hand-computed fixtures and brute-force checks of the spatial operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import scalar
from pointweave.operators import cohort, components, delaunay, raster, spatial, tables
from pointweave.sources import storage


def points(spark, xy):
    return spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(xy)], "image_id int, nid long, x long, y long")


@pytest.mark.parametrize(("step", "scale"), [(3333, 1), (1, 1 << 17), (273, 1.0), (0.1, 1.0), (1 << 20, 1)])
def test_triangulation_of_a_lattice_of_any_width(step, scale):
    """Cocircular squares: as many triangles as Euler's formula asks, without overlap."""
    m = 24
    at = [(i * step * scale, j * step * scale) for i in range(m) for j in range(m)]
    at = np.array(at)
    t = delaunay.triangulate(at[:, 0], at[:, 1])
    p, q, r = (at[t[:, k]].astype(float) for k in range(3))
    area = np.abs((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])) / 2
    assert len(t) >= 2 * (m - 1) ** 2 and abs(area.sum() / ((m - 1) * step * scale) ** 2 - 1) < 1e-9
    assert step == 0.1 or len(t) == 2 * (m - 1) ** 2


def test_importance_scores_every_row_in_every_repeat(spark):
    from pointweave.operators import ml

    rows = [(k, float(k % 2), float(k * 7 % 10), int(k % 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y int")
    numbered = ml._numbered(df.withColumn("_id", F.col("k").cast("long")).withColumn("_h", F.xxhash64("k")), ["y"], "_h")
    for y in (0, 1):
        assert sorted(r["_rank"] for r in numbered.where(F.col("y") == y).collect()) == list(range(150))
    model = ml.logistic(ml.vectors(df, ["a", "b"]), "y")
    found = {r["feature"]: r for r in ml.permutation_importance(model, df, ["a", "b"], "y", repeats=4).collect()}
    # 300 rows are scored each time: falls are whole 300ths, and a, which decides, falls by about a half
    assert set(found) == {"a", "b"} and abs(found["a"]["importance"] - 0.5) < 0.1 and abs(found["b"]["importance"]) < 0.01
    assert abs(found["a"]["importance"] * 4 * 300 - round(found["a"]["importance"] * 4 * 300)) < 1e-6 and found["a"]["spread"] > 0
    steps = ml.backward_elimination(ml.logistic, df, df, ["a", "b"], "y", sizes=(1,), repeats=2).collect()
    assert [(r["n_features"], r["features"], r["accuracy"]) for r in steps] == [(2, ["a", "b"], 1.0), (1, ["a"], 1.0)]


def test_square_with_centre(spark):
    p = points(spark, [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)])
    t = delaunay.delaunay(p)
    assert t.count() == 4
    got = {r["nid"]: r for r in delaunay.density(delaunay.with_corners(t, p)).collect()}
    assert (got[4]["dtfe_area"], got[4]["dtfe_num_triangles"], got[4]["dtfe"]) == (16.0, 4, 0.25)
    assert all((got[i]["dtfe_area"], got[i]["dtfe"]) == (8.0, 0.25) for i in range(4))


def hull_size(points):
    def half(q):
        h = []
        for c in q:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (c[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (c[0] - h[-2][0]) < 0:
                h.pop()
            h.append(c)
        return h

    q = sorted(points)
    return len(half(q)) + len(half(q[::-1])) - 2


@pytest.mark.parametrize("n,side,scale", [(3, 5, 1), (40, 8, 1), (150, 2000, 1), (400, 9000, 1), (150, 2000, 0.37), (1500, 8192, 1)])
def test_triangulation_satisfies_euler_and_empty_circles(n, side, scale):
    r = np.random.default_rng(n + side)
    xy = np.unique(r.integers(0, side, (n, 2)), axis=0)
    r.shuffle(xy)
    x, y = xy[:, 0] * scale if scale != 1 else xy[:, 0], xy[:, 1] * scale if scale != 1 else xy[:, 1]
    t = delaunay.triangulate(x, y)
    if scale == 1:
        assert len(t) == 2 * len(x) - 2 - hull_size([tuple(map(int, p)) for p in xy])
    assert len({tuple(q) for q in t.tolist()}) == len(t)
    circle = delaunay._circles(x.astype(float), y.astype(float), t)
    for (cx, cy, r2), tri in zip(circle, t, strict=True):
        inside = (x - cx) ** 2 + (y - cy) ** 2 < r2 * (1 - 1e-9)
        inside[tri] = False
        assert not inside.any()


@pytest.mark.parametrize("kind", ["long", "double"])
def test_cells_change_no_triangle(spark, kind):
    """Lattices, circles with and without centre, lines, dense clumps and single points, cut into cells or whole."""
    rng = np.random.default_rng(3)
    angle = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    circle = np.unique(np.round(np.column_stack([np.cos(angle), np.sin(angle)]) * 10000).astype(int), axis=0)
    line = np.array([(k, 2 * k) for k in range(120)])
    images = [
        np.unique(rng.integers(0, 900, (500, 2)), axis=0), np.array([(i * 333, j * 333) for i in range(16) for j in range(16)]), circle,
        np.concatenate([circle, [(0, 0)]]), np.unique(np.concatenate([rng.integers(0, 20, (200, 2)), rng.integers(-5000, 5000, (90, 2))]), axis=0),
        line, np.concatenate([line, [(5, 100), (300, -7)]]), np.array([(3, 4)]),
    ]
    images = [(a / 3 if kind == "double" else a) for a in images]
    rows = [(k, 10 * n + 7, *xy) for k, a in enumerate(images) for n, xy in enumerate(a.tolist())]
    lacking = [(0, None, *images[0][0].tolist()), (None, 1, *images[0][1].tolist()), (0, 5, None, images[0][0].tolist()[1])]
    points = spark.createDataFrame(rows + lacking, f"image_id int, nid long, x {kind}, y {kind}")
    whole = sorted((k, *(10 * t + 7).tolist()) for k, a in enumerate(images) for t in delaunay.triangulate(a[:, 0], a[:, 1]))
    assert sorted(tuple(r) for r in delaunay.delaunay(points, 64).collect()) == whole
    assert delaunay.delaunay(points.limit(0), 64).count() == 0


def test_triangulation_of_lines():
    assert delaunay.triangulate(np.array([0, 1]), np.array([0, 1])).shape == (0, 3)
    assert len(delaunay.triangulate(np.array([0, 1, 2]), np.array([0, 1, 2]))) == 0
    x, y = (np.array([p[k] for p in itertools.product(range(5), range(4))]) for k in (0, 1))
    assert len(delaunay.triangulate(x, y)) == 24


def test_radius_edges_and_pruning(spark):
    rnd = random.Random(1)
    xy = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)]
    e = spatial.radius_edges(points(spark, xy), 25).collect()
    want = {(i, j) for i, j in itertools.combinations(range(150), 2) if math.dist(xy[i], xy[j]) <= 25}
    assert {(r["src"], r["dst"]) for r in e} == want and len(e) == len(want)
    close = points(spark, [(0, 0), (1, 0), (0, 1), (1, 1), (50, 50), (51, 50)])
    kept = spatial.edge_nodes(spatial.prune(spatial.radius_edges(close, 5)))
    assert {r["nid"] for r in kept.collect()} == {0, 1, 2, 3}
    assert spatial.prune(spatial.radius_edges(points(spark, [(0, 0), (1, 0), (0, 1)]), 5)).count() == 0


def test_components_and_forest(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    up = list(range(200))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["child"]: r["parent"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in range(200) if root(x) != x}
    frames = [spark.createDataFrame(edges[i::3], "a long, b long") for i in range(3)]
    merged = components.connected_components(frames[0])
    for more in (*frames[1:], frames[0]):
        merged = components.merge_components(merged, more)
    assert sorted(map(tuple, merged.collect())) == sorted(got.items())
    weighted = [(0, a, b, float((a * 7 + b * 13) % 19)) for a, b in {(min(e), max(e)) for e in edges if e[0] != e[1]}]
    forest = components.spanning_forest(spark.createDataFrame(weighted, "image_id int, src long, dst long, weight double"))
    up = list(range(200))
    total = 0.0
    for _, a, b, w in sorted(weighted, key=lambda e: (e[3], e[1], e[2])):
        if root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
            total += w
    assert math.isclose(forest.agg(F.sum("weight")).first()[0], total)


def test_nearest_label_at_the_cap(spark):
    lab = spark.createDataFrame([(1, 9, 0, 0, 5)], "image_id int, nid long, x long, y long, label int")
    got = spatial.nearest_label(points(spark, [(199, 0), (201, 0)]), lab, 200)
    assert {r["nid"]: r["label"] for r in got.collect()} == {0: 5, 1: 0}


def test_hull_membership(spark):
    xy = [(0, 0), (10, 0), (10, 10), (0, 10), (5, 5), (12, 5), (10, 5), (1500, 3)]
    p = points(spark, xy)
    m = p.where("nid < 4").withColumn("component", F.lit(0))
    assert {r["nid"] for r in spatial.in_hulls(p, m).collect()} == {0, 1, 2, 3, 4, 6}


def test_box_counts_of_a_full_mask(spark):
    full = spark.createDataFrame([(y, x) for y in range(40) for x in range(40)], "py int, px int")
    got = {r["scale"]: r["boxes"] for r in raster.box_counts(full, 40, 40, [2.0, 3.0, 7.5, 64.0]).collect()}
    assert got == {s: (math.ceil(40 / s) - 1) ** 2 for s in (2.0, 3.0, 7.5)}


def test_border_of_one_pixel_is_negative(spark):
    g = spark.createDataFrame([(y, x, int((y, x) == (2, 2))) for y in range(5) for x in range(5)], "py int, px int, label int")
    assert [tuple(r) for r in raster.border_length(g, 1).collect()] == [(2, 2, -2)]


def test_box_filter_of_an_impulse(spark):
    g = spark.createDataFrame([(0, x, int(x == 10)) for x in range(24)], "py int, px int, v int")
    ones = [r["px"] for r in raster.box_sum(g, "v", 8).where("v_8 = 1").orderBy("px").collect()]
    assert ones == list(range(10 - 3, 10 + 5))  # a frame of -4 to +3


def test_otsu_splits_two_spikes(spark):
    v = spark.createDataFrame([(10,)] * 30 + [(200,)] * 20, "v int")
    assert raster.otsu(v, "v").first()[0] == 10


def test_moments(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 4, 9, 11, 30)], "k int, v double")
    got = df.groupBy("k").agg(F.var_samp("v"), scalar.skewness("v"), scalar.kurtosis("v"), F.median("v")).first()
    assert [round(x, 9) for x in got[1:]] == [116.3, 1.773868427, 3.371694901, 6.5]


def test_scalars(spark):
    df = spark.createDataFrame([(200, 255, 255), (201, 201, 201), (0, 0, 0), (0, 0, 1)], "r int, g int, b int")
    assert [r[0] for r in df.select(scalar.is_tissue(F.col("r"), F.col("g"), F.col("b"))).collect()] == [True, False, False, True]
    assert spark.range(1).select(F.bround(F.lit(0.125), 2)).first()[0] == 0.12
    assert spark.range(1).select(scalar.circularity(F.lit(1.0), F.lit(0.0))).first()[0] is None
    t = spark.createDataFrame([("5000000K",), ("1500M",), ("3G",), (None,)], "t string").select(scalar.memory_gb(F.col("t")))
    assert [r[0] for r in t.collect()] == [5.0, 1.5, None, None]


def test_nan_is_missing(spark):
    df = storage.nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"))
    assert df.agg(F.max("v")).first()[0] == 1.0


def test_oversample_keeps_the_minority(spark):
    near = spark.createDataFrame([(i, int(i < 10)) for i in range(25)], "id int, y int")
    assert cohort.oversample(near, "y").count() == 25
    far = spark.createDataFrame([(i, int(i < 4)) for i in range(24)], "id int, y int")
    assert cohort.oversample(far, "y").where("y = 1").count() == 20


def test_lookup_and_grid(spark):
    one = spark.range(1)
    assert one.select(F.size(tables.tile_grid(F.lit(1000), F.lit(2100), 512))).first()[0] == 4
    assert one.select(F.size(tables.tile_grid(F.lit(100), F.lit(2100), 512))).first()[0] == 0
    raster_ = spark.createDataFrame([(0, 1, 7)], "py int, px int, label int")
    got = tables.point_lookup(points(spark, [(19, 9), (9, 9)]), raster_, 0.1, "label").orderBy("nid").collect()
    assert [r["label"] for r in got] == [7, None]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "name string, k int, v double")
    storage.write_csv(df, str(tmp_path / "csv"))
    assert storage.read_csv(spark, str(tmp_path / "csv"), "name string, k int, v double").orderBy("name").collect() == df.collect()
    storage.write_partitioned(df, str(tmp_path / "parts"), ["k"])
    assert spark.read.parquet(str(tmp_path / "parts")).where("k = 2").count() == 1
    (tmp_path / "log").write_text("JobID JobName ExitCode State T M\n----\n12   tile  0:0  DONE 60 5K\n")
    assert storage.read_job_log(spark, str(tmp_path / "log")).first()["memory"] == "5K"
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 1))])
    text = spark.range(1).select(storage.geojson_feature(ring, size=F.lit(3)).alias("t")).first()["t"]
    (tmp_path / "g.json").write_text('{"features": [' + text + "]}")
    assert len(storage.read_geojson(spark, str(tmp_path / "g.json")).first()["ring"]) == 4
    storage.write_lines(df, str(tmp_path / "lines"), "name")
    assert sorted(r[0] for r in storage.read_lines(spark, str(tmp_path / "lines")).collect()) == ["a", "b"]
    tiles = storage.read_binary_tiles(spark, str(tmp_path / "log"), lambda _: np.zeros((2, 3, 3), np.int16))
    assert tiles.count() == 6


def test_mst_weight_is_of_the_whole_table(spark):
    from pointweave import catalog
    from pointweave.sources import adapters

    sf = "/root/testdata/sf0.01"
    n = adapters.nuclei(spark, sf).select("image_id", "nid", "x", "y").toPandas()
    want = {}
    for image, g in n.sort_values("nid").groupby("image_id"):
        x, y = g.x.to_numpy(np.int64), g.y.to_numpy(np.int64)
        near = [(int(d), i, i + 1 + int(k)) for i in range(len(x)) for row in [(x[i + 1 :] - x[i]) ** 2 + (y[i + 1 :] - y[i]) ** 2] for k in np.flatnonzero(row <= 10000) for d in [row[k]]]
        degree = np.bincount([v for e in near for v in e[1:]], minlength=len(x))
        up = list(range(len(x)))

        def root(v, up=up):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        taken = []
        for d, a, b in sorted(e for e in near if degree[e[1]] >= 3 and degree[e[2]] >= 3):
            if root(a) != root(b):
                up[root(a)] = root(b)
                taken.append(math.sqrt(d))
        want[image] = (len(taken), sum(taken))
    got = {r["image_id"]: (r["edges"], r["weight"]) for r in catalog.queries()["mst_weight"](spark, sf).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(got[k][1], want[k][1], abs_tol=1e-3) for k in want)


def test_holes_and_closing_on_a_ring(spark):
    grid = [(y, x) for y in range(9) for x in range(9)]
    ring = {(y, x) for y, x in grid if max(abs(y - 4), abs(x - 4)) == 2}
    open_ring = ring - {(2, 4)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "py int, px int")
    pixels = lambda df: {tuple(r) for r in df.select("py", "px").collect()}
    g = frame(grid)
    inside = {(y, x) for y, x in grid if max(abs(y - 4), abs(x - 4)) <= 2}
    assert pixels(raster.fill_holes(frame(ring), g)) == inside
    assert pixels(raster.fill_holes(frame(open_ring), g)) == open_ring
    assert pixels(raster.erode_within(g, g)) == set(grid)
    # growth closes the gap and the hole is filled; shrinking opens the gap again, since (1, 4) is background
    dark = F.when(F.array_contains(F.lit([y * 9 + x for y, x in open_ring]), F.col("py") * 9 + F.col("px")), 30).otherwise(230)
    pix = g.withColumns({c: dark for c in "rgb"})
    got = raster.tissue_fragments(pix)
    assert pixels(got) == inside - {(2, 4)}
    assert {tuple(r["component"]) for r in got.collect()} == {(2, 2)}
    assert raster.tissue_fragments(pix, least=25).count() == 0
    assert raster.tissue_fragments(pix.limit(0)).count() == 0


def test_slide_mask_blanks_tiles_with_unknown_labels(spark):
    mask = spark.createDataFrame(
        [(3, 5, 0, 0, 1), (3, 5, 0, 1, 2), (3, 5, 1, 1, 3), (4, 6, 0, 0, 2), (4, 6, 1, 0, 9), (9, 9, 0, 0, 2)],
        "tile_row int, tile_col int, y int, x int, label int",
    )
    nuclei = spark.createDataFrame(
        [(3, 5, 2, 70, 0.6, 1.2), (3, 5, 3, 71, 0.2, 1.9), (4, 6, 2, 72, 0.0, 0.0)],
        "tile_row int, tile_col int, label int, slide_label int, y double, x double",
    )
    got = {(r["py"], r["px"]): (r["label"], r["point"]) for r in raster.slide_mask(mask, nuclei, 2).collect()}
    assert got == {(0, 1): (70, 71), (1, 1): (71, 0)}


def test_positions_join_by_rounding(spark):
    a = spark.createDataFrame([(1, 1.0000049, 2.0), (2, 1.1, 2.0)], "nid int, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 2.0000001), (8, 1.0, 2.0)], "area int, x double, y double")
    got = tables.join_positions(a, b, []).select("nid", "area", "x").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 1.0), (1, 8, 1.0)]


def test_ids_with_padded_and_versioned_forms(spark):
    ids = spark.createDataFrame([("a-1",), ("a-2",), ("a-3",)], "id string")
    known = spark.createDataFrame([("a-01",), ("a-01V0",), ("a-02V0",)], "known_id string")
    got = {r["id"]: r["known_id"] for r in tables.match_ids(ids, known).collect()}
    assert got == {"a-1": "a-01", "a-2": "a-02V0", "a-3": None}


def test_nearest_resampling_of_a_tall_raster(spark):
    """Places whose products leave an int; pixels outside the raster or without place give nothing."""
    h, m = 90_000, 60_000
    rows = [(y, x, y * 10 + x) for y in (0, 1, 2, 44_999, 89_997, 89_998, 89_999) for x in (0, 1, 2)] + [(-1, 0, 1), (h, 0, 1), (None, 1, 1), (5, 3, 1)]
    pix = spark.createDataFrame(rows, "py int, px int, label int")
    for n in (m, 2 * h):
        got = sorted(map(tuple, raster.resize_nearest(pix, h, 3, n, 4).select("i", "j", "label").collect()))
        held = {(y, x): v for y, x, v in rows if y is not None and 0 <= y < h and x < 3}
        assert got == sorted((i, j, held[y, x]) for i in range(n) for j in range(4) if (y := i * h // n, x := j * 3 // 4) in held)
