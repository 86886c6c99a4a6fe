"""Steps whose work must not grow faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import components, delaunay, raster, spatial, stains
from pointweave.plans import aggregates


@pytest.mark.parametrize("width", [60, 300, 8192])
def test_stars_are_the_sweep_s_triangles_and_leave_few_points(width):
    """Lattices with many points on one circle and wide places; only points along the hull stay open."""
    at = np.unique(np.random.default_rng(width).integers(0, width, (3000, 2)), axis=0)
    x, y = at.T
    own, end = np.ones(len(at), bool), np.array([1e9, 1e9])
    tri, open_ = delaunay._stars(x, y, own, -end, end)
    got = [tuple(t) for t in np.sort(tri, axis=1).tolist()]
    whole = [tuple(t) for t in delaunay.triangulate(x, y).tolist()]
    assert sorted(got) == sorted(t for t in whole if not open_[list(t)].all())
    assert open_.sum() < 4 * np.sqrt(len(at))


def test_cells_with_margins_change_nothing(spark):
    at = np.unique(np.random.default_rng(5).integers(0, 700, (9000, 2)), axis=0)
    points = spark.createDataFrame([(1, k, int(a), int(b)) for k, (a, b) in enumerate(at)], "image_id int, nid long, x long, y long")
    want = sorted((1, *t) for t in delaunay.triangulate(*at.T).tolist())
    corners = delaunay.delaunay_corners(points, 32)
    assert sorted((r["image_id"], r["a"], r["b"], r["c"]) for r in corners.collect()) == want
    assert all((r["bx"], r["by"]) == tuple(at[r["b"]]) for r in corners.limit(50).collect())


def _cloud(spark, n, width, seed=3):
    rows = np.random.default_rng(seed).integers(0, width, (n, 2)).tolist()
    return spark.createDataFrame([(k % 2, k, a, b) for k, (a, b) in enumerate(rows)], "image_id int, nid long, x long, y long")


@pytest.mark.parametrize("width", [150, 900])
def test_components_and_clusters_without_edges(spark, width):
    """Dense and sparse clouds with copies of positions: squares give what the table of edges gives."""
    p = _cloud(spark, 300, width).localCheckpoint()
    edges = spatial.prune(spatial.radius_edges(p, 100)).localCheckpoint()
    kept = spatial.well_linked(p, 100, 3).localCheckpoint()
    ends = spatial.radius_edges(kept, 100).select("image_id", "src", "dst")
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, edges.select("image_id", "src", "dst").collect()))
    want = components.label_nodes(spatial.edge_nodes(edges), edges)
    got = aggregates.aggregate_nodes(p, 100, 2)
    columns = ["image_id", "nid", "component"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    old, new = components.spanning_forest(edges), delaunay.spanning_forest(kept.select("image_id", "nid", "x", "y"), 100)
    assert new.count() == old.count()
    weights = [df.agg(F.sum("weight")).first()[0] or 0.0 for df in (old, new)]
    assert abs(weights[0] - weights[1]) < 1e-6 * (1 + weights[0])


def test_aggregates_make_no_edges(spark, monkeypatch):
    """The edges of a dense image are far more than its points."""
    monkeypatch.setattr(spatial, "radius_edges", None)
    p = _cloud(spark, 400, 150).withColumn("dtfe", F.col("nid").cast("double"))
    assert aggregates.aggregate_nodes(p, 100, 10).count() == 400
    assert [r["n_clustered"] for r in aggregates.threshold_sweep(p, [-1.0, 199.0], 100, 10).orderBy("threshold").collect()] == [400, 200]
    assert spatial.dbscan(p, 100, 5).where("cluster IS NOT NULL").count() == 400


def test_nuclei_are_numbered_without_one_window_of_an_image(spark):
    from pointweave.sources import adapters
    from tests.compare import SF

    n = adapters.nuclei(spark, SF)
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number()" in line]
    assert windows and all("_range" in line for line in windows)
    ids = [r[0] for r in n.where("image_id = 3").select("nid").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_lines_need_no_table_of_samples(spark):
    rows = [(1, -5, 3, 4, -2), (1, -5, 3, 4, -2), (1, 0, 0, 3, 3), (2, 7, -1, 7, 9)]
    got = stains.line_pixels(spark.createDataFrame(rows, "id int, x0 int, y0 int, x1 int, y1 int"), 50)
    want = {(k, int(b + (e - b) * (i / 49.0)), int(a + (c - a) * (i / 49.0))) for k, a, b, c, e in rows for i in range(50)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")


def test_nearest_labels_of_dense_and_far_points(spark):
    """Dense labels on one side make the search begin near; the far points still find theirs, or none."""
    rng = np.random.default_rng(8)
    lab = [(1, 1000 + k, a, b, k % 7 + 2) for k, (a, b) in enumerate(rng.integers(0, 120, (500, 2)).tolist())]
    pts = [(1, k, a, b) for k, (a, b) in enumerate(rng.integers(0, 260, (60, 2)).tolist())]
    got = spatial.nearest_label(
        spark.createDataFrame(pts, "image_id int, nid long, x long, y long"),
        spark.createDataFrame(lab, "image_id int, nid long, x long, y long, label int"), 100,
    )
    found = {r["nid"]: r["label"] for r in got.collect()}
    for _, k, x, y in pts:
        d2, _, label = min(((x - a) ** 2 + (y - b) ** 2, n, v) for _, n, a, b, v in lab)
        assert found[k] == (label if d2 <= 10000 else 0)


def test_nearest_vectors_in_blocks(spark):
    """Ties, copies, a null and a short vector; small blocks and large numbers change nothing, and no pair is a row."""
    rng = np.random.default_rng(4)
    for scale in (1, 10**8):
        rows = [(k, (rng.integers(-3, 4, 3) * scale).tolist()) for k in range(60)] + [(60, None), (61, [1, 2])]
        base = spark.createDataFrame([(k, k % 3, v) for k, v in rows], "b_id long, label int, v array<long>")
        asked = base.where("b_id % 5 = 0").selectExpr("b_id q_id", "v qv")
        away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b)) if a and b and len(a) == len(b) == 3 else float("inf")
        want = {(q, b, b % 3, r) for q, v in rows if q % 5 == 0 for r, (_, b) in enumerate(sorted((away(v, w), b) for b, w in rows if b != q)[:4], 1)}
        for block in (7, 8192):
            got = spatial.knn(asked, base, 4, block)
            assert {(r["q_id"], r["b_id"], r["label"], r["rank"]) for r in got.collect()} == want
            assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("offsets", [raster.FOUR, raster.EIGHT])
def test_labels_cross_tiles(spark, monkeypatch, offsets):
    """Speckle, snakes and classes over many small tiles, also below zero, against a flood of the whole."""
    monkeypatch.setattr(raster, "LABEL_TILE", 5)
    free = np.random.default_rng(6).random((30, 26)) < 0.55
    free[::4] = True
    places = {(a - 9, b - 7): int(a > 20) for a, b in np.argwhere(free).tolist()}
    want = {}
    for s in sorted(places):
        todo = [] if s in want else [s]
        want.setdefault(s, s)
        while todo:
            a, b = todo.pop()
            near = [q for da, db in offsets if (q := (a + da, b + db)) not in want and places.get(q) == places[a, b]]
            want.update(dict.fromkeys(near, want[s]))
            todo += near
    fg = spark.createDataFrame([(a, b, k) for (a, b), k in places.items()], "py int, px int, k int")
    got = raster.label_components(fg, offsets, by="k").collect()
    assert len(got) == len(places) and {(r["py"], r["px"]): tuple(r["component"]) for r in got} == want


def test_fragments_far_down_a_tall_raster(spark, tmp_path):
    """The number of a component at row 30,000 is beyond an int; pixels meet without a broadcast of them."""
    from pointweave import catalog

    spark.range(30000 * 125, 30050 * 125).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("tissue_fragments", "raster_components"):
        rows = catalog.queries()[name](spark, str(tmp_path)).select("component").collect()
        assert rows and min(r["component"] for r in rows) >= 3_000_000_000
    fg = spark.range(50).selectExpr("int(id) py", "int(id) px")
    assert "BroadcastHashJoin" not in raster.erode_within(fg, fg)._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """A path of 300 nodes and a hub take several rounds; that places' tables are small is no reason to send one to the driver in each."""
    plans, write = [], components.materialize

    def written(df):
        plans.append(_plan(df))
        return write(df)

    monkeypatch.setattr(components, "materialize", written)
    ends = spark.range(299).selectExpr("id", "id + 1 as up").unionAll(spark.range(501, 600).selectExpr("500L as id", "id as up"))
    place = lambda c: F.struct(F.col(c).cast("int").alias("py"), (F.col(c) % 7).cast("int").alias("px"))
    got = components.connected_components(ends.select(place("id").alias("a"), place("up").alias("b")))
    want = {(k, 0) for k in range(1, 300)} | {(k, 500) for k in range(501, 600)}
    assert {tuple(r) for r in got.select("child.py", "parent.py").collect()} == want
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_broadcasts_of_regions_do_not_follow_the_height(spark, monkeypatch):
    """A column over 3 or 60 tiles: more tiles take more rounds, but no more broadcasts."""
    from pointweave.operators import pixels

    plans, write = [], components.materialize

    def written(df):
        plans.append(_plan(df))
        return write(df)

    for module in (components, raster, pixels):
        monkeypatch.setattr(module, "materialize", written)
    monkeypatch.setattr(raster, "LABEL_TILE", 5)
    sent, rounds = [], []
    for height in (15, 300):
        plans.clear()
        got = pixels.large_regions(spark.range(height).selectExpr("int(id) py", "1 px"), 9)
        assert {tuple(r) for r in got.collect()} == {(y, 1, (0, 1)) for y in range(height)}
        sent.append(sum(p.count("BroadcastExchange") for p in [*plans, _plan(got)]))
        rounds.append(len(plans))
    assert rounds[0] < rounds[1] and sent[0] == sent[1]


def test_superpixels_copy_no_pixel(spark):
    rows = [(y, x, (y * 37 + x * 11) % 256, (y * x) % 256, (x * 5) % 256) for y in range(23) for x in range(17)]
    got = stains.superpixels(spark.createDataFrame(rows, "py int, px int, r int, g int, b int"), 6, rounds=2)
    seeds: dict = {}
    mean = lambda ps: [sum(c) / len(ps) for c in zip(*ps)]
    at = {p: (p[0] // 6, p[1] // 6) for p in rows}
    for _ in range(3):
        groups: dict = {}
        for p in rows:
            groups.setdefault(at[p], []).append(p)
        seeds = {k: mean(v) for k, v in groups.items()}
        before = at
        away = lambda p, m: sum((a - b) * (a - b) / 100 for a, b in zip(p[2:], m[2:])) + sum((a - b) ** 2 for a, b in zip(p[:2], m[:2])) * (0.5 / 6) ** 2 * 100
        at = {p: min((away(p, seeds[k]), *k) for a in (-1, 0, 1) for b in (-1, 0, 1) if (k := (p[0] // 6 + a, p[1] // 6 + b)) in seeds)[1:] for p in rows}
    assert {(r["py"], r["px"]): tuple(r["spx"]) for r in got.collect()} == {p[:2]: k for p, k in before.items()}
    assert "min_by" not in _plan(got)


def test_bilinear_joins_no_table_of_places(spark):
    rng = np.random.default_rng(2)
    rows = [(y, x, int(rng.integers(0, 9)) if (y + x) % 6 else None) for y in range(7) for x in range(9) if (y * x) % 5 != 1]
    pix, v = spark.createDataFrame(rows, "py int, px int, v int"), {(y, x): p for y, x, p in rows}
    for m, n in ((3, 4), (14, 20), (7, 9), (40, 1)):
        want = {}
        for i in range(m):
            for j in range(n):
                y, x = min(max((i + 0.5) * 7 / m - 0.5, 0), 6), min(max((j + 0.5) * 9 / n - 0.5, 0), 8)
                near = [(int(y) + a, int(x) + b, (y % 1 if a else 1 - y % 1) * (x % 1 if b else 1 - x % 1)) for a in (0, 1) for b in (0, 1)]
                met = [(w, v[a, b]) for a, b, w in near if w > 0 and (a, b) in v]
                if met:
                    known = [w * g for w, g in met if g is not None]
                    want[i, j] = sum(known) / sum(w for w, _ in met) if known else None
        got = raster.resize_bilinear(pix, "v", 7, 9, m, n)
        assert "Join" not in _plan(got)
        assert {(r["i"], r["j"]): r["v"] for r in got.collect()} == {k: g if g is None else pytest.approx(g) for k, g in want.items()}


def test_intensity_takes_counts_of_levels(spark):
    """A group of one level, one pixel, and missing values; the percentiles read levels, not pixels."""
    from pointweave.operators import tables

    rng = np.random.default_rng(3)
    sets = {1: rng.integers(0, 40, 300).tolist(), 2: [5] * 9, 3: [7], 4: [1, 2, 9, 30], 5: [3, 4]}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs] + [(1, None)], "k int, v int")
    got = {r["k"]: r for r in tables.full_intensity(df, ["k"], "v").collect()}
    for k, vs in sets.items():
        a, n = np.array(vs, float), len(vs)
        r, s = got[k], a.std()
        assert [r["v_min"], r["v_max"]] == [min(vs), max(vs)]
        assert [r["v_mean"], r["v_median"], r["v_std"], r["v_iqr"], r["v_mad"]] == pytest.approx([a.mean(), np.median(a), s, np.percentile(a, 75) - np.percentile(a, 25), np.median(abs(a - np.median(a)))])
        z = (a - a.mean()) / (s or 1)
        assert r["v_skew"] == (pytest.approx((z**3).mean() * (n * (n - 1)) ** 0.5 / (n - 2)) if n > 2 and s else None)
        assert r["v_kurt"] == (pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((z**4).mean() - 3) + 6)) if n > 3 and s else None)


def test_dealt_values_are_no_broadcast(spark, monkeypatch):
    """Every row is dealt 60 times here: only the values travel, and the rows' copies are never joined."""
    from pointweave.operators import ml

    df = spark.range(400).selectExpr("double(id % 2) a", "double(id % 7) b", "double(id * 7 % 11) c", "double(id % 2) y")
    model = ml.random_forest(ml.vectors(df, ["a", "b", "c"]), "y", trees=3)
    got = ml.permutation_importance(model, df, ["a", "b", "c"], "y", repeats=20)
    plan = _plan(got)
    assert plan.count("SortMergeJoin") == 1 and "collect_list" in plan
    found = {r["feature"]: r["importance"] for r in got.collect()}
    assert found["a"] > 0.3 and abs(found["b"]) < 0.1 and set(found) == {"a", "b", "c"}


@pytest.mark.parametrize("share", [0.0, 0.37, 1.0])
def test_splits_order_only_the_range_of_the_cut(spark, share):
    import hashlib

    from pointweave.operators import cohort

    rows = [(k % 50 if k < 200 else k, "a" if k % 3 else "b") for k in range(900)] + [(7, None)]
    got = cohort.stratified_split(spark.createDataFrame(rows, "k int, y string"), "y", "k", share, "s:")
    for y in "ab":
        order = sorted((hashlib.md5(f"s:{k}".encode()).hexdigest(), k) for k, v in rows if v == y)
        want = sorted((k, n < int(len(order) * share)) for n, (_, k) in enumerate(order))
        assert sorted((r["k"], r["train"]) for r in got.where(F.col("y") == y).collect()) == want
    assert got.where("y IS NULL").isEmpty()
    assert _plan(got).count("Exchange hashpartitioning") == 1


def test_windows_meet_pixels_without_rows_of_pairs(spark):
    from pointweave.operators import detection

    rng = np.random.default_rng(9)
    pix = [(y, x, int(rng.integers(0, 6))) for y in range(-5, 90) for x in range(70) if rng.random() < 0.7]
    boxes = [((k, k), float(a), float(a + h), float(b), float(b + w), k % 5) for k, (a, b, h, w) in enumerate(rng.integers(-20, 80, (30, 4)).tolist())]
    p = spark.createDataFrame(pix, "py int, px int, v int")
    win = spark.createDataFrame(boxes, "component struct<py:int,px:int>, y0 double, y1 double, x0 double, x1 double, threshold int")
    held = lambda y, x, b: b[1] <= y < b[2] and b[3] <= x < b[4]
    want: dict = {}
    for b in boxes:
        for y, x, g in pix:
            if held(y, x, b):
                want[b[0][0], g] = want.get((b[0][0], g), 0) + 1
    got = detection.window_levels(p, win, "v")
    assert "Join" not in _plan(got)
    found = got.groupBy("component.py", "v").agg(F.sum("n").alias("n"))
    assert {(r["py"], r["v"]): r["n"] for r in found.collect()} == want
    dark = sorted((y, x) for y, x, g in pix if any(held(y, x, b) and g < b[5] for b in boxes))
    assert sorted(map(tuple, detection.darker_in_windows(p, win, "v").collect())) == dark


@pytest.mark.parametrize(("width", "reach"), [(60, 100), (700, 40), (5000, 90)])
def test_forest_in_ranges_equals_the_forest_of_all_edges(spark, monkeypatch, width, reach):
    """Ranges of few points, ties of weights on dense lattices, parts that are apart and positions on one line."""
    line = [(3, k, 7 * k, 0) for k in range(30)] + [(4, 5, 9, 9), (4, 6, 9, 9)]
    rows = [(k % 2, 10_000 - k, a, b) for k, (a, b) in enumerate(np.random.default_rng(width).integers(0, width, (900, 2)).tolist())]
    p = spark.createDataFrame(rows + line, "image_id int, nid long, x long, y long").localCheckpoint()
    for points, joined in ((20, 2), (65_536, 16)):
        monkeypatch.setattr(delaunay.forest_in_ranges, "__defaults__", (points,))
        monkeypatch.setattr(delaunay, "RANGES_JOINED", joined)
        got = delaunay.spanning_forest(p, reach).collect()
        by_image = {}
        for e in spatial.radius_edges(p, reach).collect():
            by_image.setdefault(e["image_id"], []).append((e["weight"], e["src"], e["dst"]))
        for image in (0, 1, 3, 4):
            want = plain_forest(by_image.get(image, []))
            mine = [(r["src"], r["dst"], r["weight"]) for r in got if r["image_id"] == image]
            assert len(mine) == len(want) == len(plain_forest([(w, a, b) for a, b, w in mine]))
            assert abs(sum(w for *_, w in mine) - sum(w for w, *_ in want)) < 1e-6


def plain_forest(edges):
    up, out = {}, []

    def top(k):
        while up.get(k, k) != k:
            k = up[k]
        return k

    for w, a, b in sorted(edges):
        p, q = top(a), top(b)
        if p != q:
            up[p] = q
            out.append((w, a, b))
    return out


@pytest.mark.parametrize("kind", ["long", "double"])
def test_densities_of_tasks_equal_those_of_the_whole_table(spark, kind):
    """Cells of few points: shared triangles, points open along the hull, and an image of one cell."""
    at = np.unique(np.random.default_rng(9).integers(0, 900, (7000, 2)), axis=0)
    rows = [(1, k, a, b) for k, (a, b) in enumerate(at.tolist())] + [(2, k, a, b) for k, (a, b) in enumerate(at[:20].tolist())]
    p = spark.createDataFrame(rows, "image_id int, nid long, x long, y long").withColumns({c: F.col(c).cast(kind) for c in "xy"})
    plain = delaunay.delaunay_corners(p, 32).localCheckpoint()
    want = {(r["image_id"], r["nid"]): r["dtfe"] for r in delaunay.density(plain).collect()}
    got = delaunay.delaunay_corners(p, 32, densities=True).collect()
    assert sorted((r["image_id"], r["a"], r["b"], r["c"]) for r in got) == sorted((r["image_id"], r["a"], r["b"], r["c"]) for r in plain.collect())
    assert all(r[f"{c}d"] == want[r["image_id"], r[c]] for r in got for c in "abc") and len({r[c] for r in got for c in "abc"}) == len(at)


def test_sides_within_reach_need_no_graph(spark):
    p = _cloud(spark, 400, 900).groupBy("image_id", "x", "y").agg(F.min("nid").alias("nid")).localCheckpoint()
    corners = delaunay.delaunay_corners(p).localCheckpoint()
    for complete in (True, False):
        want = sorted(map(tuple, delaunay.constrained(corners, spatial.radius_edges(p, 50), complete).collect()))
        assert sorted(map(tuple, delaunay.constrained_by_length(corners, 50, complete).collect())) == want and want


def test_triangulation_queries_shuffle_no_triangles(spark, monkeypatch):
    """Triangles are written once, and neither densities nor lengths need a join of all of them."""
    from pointweave import catalog
    from tests.compare import SF

    monkeypatch.setattr(spatial, "radius_edges", None)
    for name in ("trace_simplices", "constrained_dtfe"):
        df = catalog.queries()[name](spark, SF)
        assert df.count() > 0
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    p = _cloud(spark, 3000, 700).groupBy("image_id", "x", "y").agg(F.min("nid").alias("nid")).localCheckpoint()
    corners = delaunay.delaunay_corners(p)
    written, write = [], delaunay.materialize

    def counted(df):
        written.append((back := write(df)).count())
        return back

    monkeypatch.setattr(delaunay, "materialize", counted)
    inner = delaunay.enclosed_triangles(corners, delaunay.within_alpha(0.01)).count()
    assert inner < corners.count() / 10 and max(written) < corners.count() / 10


@pytest.mark.parametrize(("width", "kind", "pairs"), [(150, "long", 50), (900, "int", 2_000_000), (900, "double", 300)])
def test_radius_edges_equal_loops_and_carry_few_rows(spark, monkeypatch, width, kind, pairs):
    """Copies of positions, squares shared by tasks, points below zero and without place; a point travels at most twice on average."""
    monkeypatch.setattr(spatial, "PAIRS", pairs)
    monkeypatch.setattr(spatial, "SQUARE_POINTS", 70)
    at = np.random.default_rng(width).integers(-width // 2, width // 2, (400, 2)).tolist()
    rows = [(k % 2, 5000 - k, a, b) for k, (a, b) in enumerate(at + at[:40])] + [(1, 9000, None, 3), (None, 9001, 2, 3)]
    p = spark.createDataFrame(rows, "image_id int, nid long, x long, y long").withColumns({c: F.col(c).cast(kind) for c in "xy"})
    got = sorted(map(tuple, spatial.radius_edges(p, 40).collect()))
    far = lambda a, b: (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
    known = sorted((r for r in rows if None not in r), key=lambda r: r[1])
    want = sorted((a[0], a[1], b[1], far(a, b) ** 0.5) for i, a in enumerate(known) for b in known[i + 1 :] if a[0] == b[0] and far(a, b) <= 1600)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))
    plan = spatial.radius_edges(p, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan
