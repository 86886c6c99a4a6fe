"""Detection, outlines and texture on small rasters against plain loops."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import contours, detection, texture

FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def parts(places, steps):
    left, out = set(places), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            seen.add((y, x))
            for a, b in steps:
                if (q := (y + a, x + b)) in left:
                    left.remove(q)
                    todo.append(q)
        out.append(seen)
    return out


def otsu(values):
    n, best = len(values), None
    for t in sorted(set(values))[:-1]:
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        score = len(low) * (n - len(low)) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
        if best is None or score > best[0] * (1 + 1e-12):
            best = score, t
    return best[1] if best else None


def without_small(places, least, steps=FOUR):
    return {q for c in parts(places, steps) if len(c) >= least for q in c}


def holes_filled(places, grid, least):
    return places | {q for c in parts(set(grid) - places, FOUR) if len(c) < least for q in c}


def foreground_by_hand(level, limit=140, ratio=3.0, least=16, hole=24):
    top = otsu([v for v in level.values() if v < limit])
    first = without_small({q for q, v in level.items() if 0 < v <= top}, least)
    out = set()
    for c in parts(first, EIGHT):
        around = ratio * math.sqrt(4 * len(c) / math.pi)
        ys, xs = [y for y, _ in c], [x for _, x in c]
        y0, y1, x0, x1 = (round(v) for v in (min(ys) - around, max(ys) + 1 + around, min(xs) - around, max(xs) + 1 + around))
        window = {q: v for q, v in level.items() if y0 <= q[0] < y1 and x0 <= q[1] < x1}
        cut = otsu([v for v in window.values() if v < limit])
        out |= {q for q, v in window.items() if v < (limit if cut is None else cut)}
    return without_small(holes_filled(out, level, hole), least)


def refined_by_hand(fg, level, rounds=5, least=32, most=256):
    for _ in range(rounds):
        fg = without_small(holes_filled(fg, level, least // 2), least, EIGHT)
        new = set()
        for c in parts(fg, EIGHT):
            if len(c) < most:
                new |= c
                continue
            ys, xs = [y for y, _ in c], [x for _, x in c]
            grown = {(y + a, x + b) for y, x in c for a, b in [(0, 0), *FOUR]}
            grown = [q for q in grown if q in level and min(ys) <= q[0] <= max(ys) and min(xs) <= q[1] <= max(xs)]
            cut = otsu([level[q] for q in grown])
            new |= {q for q in grown if cut is None or level[q] <= cut}
        fg = without_small(holes_filled(new, level, least // 2), least, EIGHT)
    return fg


def blobs(seed, size=44):
    r = random.Random(seed)
    centres = [(r.uniform(6, size - 6), r.uniform(6, size - 6), r.uniform(3, 5)) for _ in range(7)] + [(size / 2, size / 2, 9), (size / 2 + 3, size / 2 + 12, 8)]
    level = {}
    for y in range(size):
        for x in range(size):
            deep = max(math.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * s * s)) for a, b, s in centres)
            level[y, x] = min(255, max(0, int(220 - 190 * deep + r.gauss(0, 6))))
    return level


def frame(spark, level, names="py int, px int, stain int"):
    return spark.createDataFrame([(y, x, int(v)) for (y, x), v in level.items()], names)


def places(df):
    rows = [(r["py"], r["px"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def stained():
    return blobs(3)


def test_local_thresholds_equal_loops(spark, stained, monkeypatch):
    monkeypatch.setattr(detection, "CELL", 16)
    assert places(detection.local_foreground(frame(spark, stained))) == foreground_by_hand(stained)


def test_refinement_equals_loops_and_cuts_large_objects(spark, stained):
    fg = {q for q, v in stained.items() if v < 170}
    assert max(map(len, parts(fg, EIGHT))) >= 256
    got = places(detection.refine_objects(frame(spark, {q: 0 for q in fg}), frame(spark, stained)))
    assert got == refined_by_hand(fg, stained) and len(got) < len(fg)


def test_distance_transform_is_exact_to_the_border(spark):
    r = random.Random(1)
    fg = {(y, x) for y in range(20) for x in range(17) if r.random() < 0.93}
    got = {(x["py"], x["px"]): x["d2"] for x in detection.distance_transform(frame(spark, dict.fromkeys(fg, 0))).collect()}
    outside = {(y, x) for y in range(-1, 21) for x in range(-1, 18)} - fg
    assert got == {q: min((q[0] - y) ** 2 + (q[1] - x) ** 2 for y, x in outside) for q in fg}


def flood_by_hand(level, marked, compactness):
    """The same queue as a list that is searched for its least entry."""
    out, queue, count = dict(marked), [], 0
    todo = sorted(marked, key=lambda q: (level[q], q))
    while todo or queue:
        if todo:
            q = s = todo.pop(0)
        else:
            queue.remove(e := min(queue))
            q, s = e[2:]
            if q in out or any(out.get((q[0] + a, q[1] + b), out[s]) != out[s] for a, b in FOUR):
                continue
            out[q] = out[s]
        for a, b in [(-1, 0), (0, -1), (0, 1), (1, 0)]:
            if (n := (q[0] + a, q[1] + b)) in level and n not in out:
                queue.append((level[n] + compactness * math.dist(n, s), count, n, s))
                count += 1
    return out


@pytest.mark.parametrize("compactness", [0.0, 50.0])
def test_watershed_equals_a_plain_flood(spark, compactness):
    level = blobs(5, 26)
    fg = {q: v for q, v in level.items() if v < 190}
    r = random.Random(2)
    marked = {q: k + 1 for k, c in enumerate(parts(fg, EIGHT)) for q in r.sample(sorted(c), 1)}
    marked |= {q: 100 + k for k, q in enumerate(r.sample(sorted(set(fg) - set(marked)), 5))}
    got = detection.watershed(frame(spark, fg), frame(spark, marked, "py int, px int, label long"), compactness)
    got = {(x["py"], x["px"]): x["label"] for x in got.collect()}
    assert set(got) == set(fg)
    want = {}
    for c in parts(fg, EIGHT):
        want |= flood_by_hand({q: fg[q] for q in c}, {q: n for q, n in marked.items() if q in c}, compactness)
    assert {q: n for q, n in got.items() if n is not None} == want


def test_watershed_does_not_depend_on_an_object_s_size(spark, monkeypatch):
    """An object over the corner of four tiles of 1024 is flooded as a whole, whatever counts as large."""
    monkeypatch.setattr(detection, "WHOLE_PIXELS", 10)
    level = {(1010 + y, 1008 + x): v for (y, x), v in blobs(7, 30).items() if v < 200}
    r, fg = random.Random(4), sorted(level)
    marked = {q: 1 + k for k, q in enumerate(r.sample(fg, 6))}
    got = detection.watershed(frame(spark, level), frame(spark, marked, "py int, px int, label long"))
    want = {}
    for c in parts(set(fg), EIGHT):
        want |= flood_by_hand({q: level[q] for q in c}, {q: n for q, n in marked.items() if q in c}, detection.COMPACTNESS)
    assert any(len({(y // 1024, x // 1024) for y, x in c}) > 1 and sum(q in c for q in marked) > 1 for c in parts(set(fg), EIGHT))
    rows = {(x["py"], x["px"]): x["label"] for x in got.collect()}
    assert set(rows) == set(fg) and {q: n for q, n in rows.items() if n is not None} == want


def discs(centres, radius, top=0, left=0):
    return {(top + y, left + x) for y in range(64) for x in range(64) if any((y - a) ** 2 + (x - b) ** 2 <= radius**2 for a, b in centres)}


def test_two_touching_discs_part_whatever_the_cut(spark, monkeypatch):
    found = []
    for top, left, n in ((0, 0, 4), (1010, 2040, 3), (500, 1017, 7)):
        centres = [(15, 12), (15, 25)]
        fg = discs(centres, 7, top, left)
        level = {(top + y, left + x): min(230, 60 + int(24 * min(math.dist((y, x), c) for c in centres))) for y in range(40) for x in range(40)}
        pix = frame(spark, level).repartition(n)
        markers = detection.nucleus_markers(frame(spark, dict.fromkeys(fg, 0)), pix)
        got = detection.watershed(pix.join(frame(spark, dict.fromkeys(fg, 0), "py int, px int, one int"), ["py", "px"]), markers)
        rows = [(r["py"] - top, r["px"] - left, r["label"]) for r in got.collect()]
        assert {k for _, _, k in rows if k} == set(r["label"] for r in markers.collect()) and len({k for _, _, k in rows if k}) == 2
        name = {k: i for i, k in enumerate(sorted({k for _, _, k in rows if k}))}
        found.append({(y, x): name.get(k) for y, x, k in rows})
    assert found[0] == found[1] == found[2]
    assert found[0][15, 12] != found[0][15, 25] and {x for (y, x), k in found[0].items() if k is None} <= {17, 18, 19, 20}
    # beyond the bound of a whole object, tiles
    monkeypatch.setattr(detection, "WHOLE_PIXELS", 10)
    assert detection.watershed(pix, markers).count() == 1600


def test_nuclei_of_a_slide(spark):
    """Four round nuclei, two of them touching; a thin line and a speck are none."""
    centres = [(12, 12), (40, 11), (38, 33), (38, 48)]
    dark, thin = discs(centres, 8), {(2, x) for x in range(22, 60)} | {(20, 45), (20, 46)}
    level = lambda q: 60 + int(8 * min(math.dist(q, c) for c in centres)) if q in dark else 60 if q in thin else 235
    rows = [(y, x, 255, level((y, x)), 255) for y in range(56) for x in range(62)]
    pix = spark.createDataFrame(rows, "py int, px int, r int, g int, b int")
    green = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    got = detection.detect_nuclei(pix, green).groupBy("label").agg(F.avg("py").alias("y"), F.avg("px").alias("x"), F.count("*").alias("n")).collect()
    assert sorted((round(r["y"]), round(r["x"])) for r in got) == sorted(centres) and all(40 <= r["n"] <= 200 for r in got)
    assert detection.detect_nuclei(pix.limit(0), green).count() == 0


# outlines


def rings_by_hand(region):
    """Corners of each outline, walked from side to side; a set of rings, each from its least corner on."""
    side = {}
    for y, x in region:
        for (a, b), (c, d), (e, f) in [((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 1), (0, 1)), ((1, 1), (1, 0), (1, 0)), ((1, 0), (0, 0), (0, -1))]:
            if (y + e, x + f) not in region:
                side.setdefault((y + a, x + b), []).append(((y + c, x + d), (y, x)))
    rings = []
    while side:
        at = next(iter(side))
        (to, pixel), walk = side[at].pop(), [at]
        if not side[at]:
            del side[at]
        while to != walk[0] or any(p == pixel for _, p in side.get(to, [])):
            walk.append(to)
            k = next((k for k, (_, p) in enumerate(side[to]) if p == pixel), 0)
            end, pixel = side[to].pop(k)
            if not side[to]:
                del side[to]
            to = end
        turn = [walk[k] for k in range(len(walk)) if len({(b - a, d - c) for (a, c), (b, d) in ((walk[k - 1], walk[k]), (walk[k], walk[(k + 1) % len(walk)]))}) > 1]
        k = turn.index(min(turn))
        rings.append(tuple(turn[k:] + turn[:k]))
    return Counter(rings)


def test_rings_equal_a_walk(spark):
    r = random.Random(4)
    labelled = {(y, x): r.choice([1, 1, 1, 2]) for y in range(14) for x in range(15) if r.random() < 0.7}
    labelled |= {(30 + y, x): 3 for y in range(9) for x in range(9) if not 2 < y < 6 or not 2 < x < 6} | {(50, 50): 4}
    pix = frame(spark, labelled, "py int, px int, label int")
    rows = {}
    for p in contours.contour_points(pix).collect():
        rows.setdefault((p["label"], p["ring"]), {})[p["place"]] = (p["y"], p["x"])
    for n in (1, 2, 3, 4):
        got = []
        for (label, _), points in rows.items():
            if label == n:
                ring = [points[k] for k in range(len(points))]
                k = ring.index(min(ring))
                got.append(tuple(ring[k:] + ring[:k]))
        assert Counter(got) == rings_by_hand({q for q, v in labelled.items() if v == n})
    rings = contours.contour_rings(pix, least_points=1).collect()
    for n in (1, 2, 3, 4):
        assert sum((-1 if r["hole"] else 1) * r["area"] for r in rings if r["label"] == n) == sum(v == n for v in labelled.values())
    assert sum(r["hole"] for r in rings if r["label"] == 3) == 1
    # squares have four corners and go, as does what is not below the second largest number of points
    kept = contours.contour_rings(pix)
    assert all(len(r["points"]) > 4 for r in kept.collect()) and not {3, 4} & {r["label"] for r in kept.collect()}
    sizes = sorted({len(r["points"]) for r in kept.collect()}, reverse=True)
    assert max(len(r["points"]) for r in contours.below_largest(kept).collect()) < sizes[1]
    doc = json.loads(contours.outline_features(kept, kind=F.lit("nucleus")).first()["feature"])
    ring = doc["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and doc["properties"] == {"kind": "nucleus"} and doc["type"] == "Feature"
    assert contours.contour_rings(pix.limit(0)).count() == 0


# texture


def test_texture_of_plain_and_chequered_regions(spark):
    rows = [(1, y, x, 100) for y in range(5) for x in range(5)] + [(2, y, 20 + x, 255 * ((x + y) % 2)) for y in range(6) for x in range(6)] + [(3, 40, 40, 7)]
    pix = spark.createDataFrame(rows, "label int, py int, px int, v int")
    got = {r["label"]: r for r in texture.haralick(pix, "label", "v", levels=4).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["asm"], got[1]["contrast"], got[1]["entropy"], got[1]["idm"], got[1]["correlation"], got[1]["imc1"]) == (1, 0, 0, 1, 0, 0)
    # 60 straight neighbours differ by 3 levels, 50 diagonal ones by none
    assert got[2]["contrast"] == pytest.approx(9 * 60 / 110) and got[2]["difference_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in (60 / 110, 50 / 110)))
    assert got[2]["sum_average"] == pytest.approx(3) and got[2]["correlation"] == pytest.approx(1 - 2 * 60 / 110)


def test_gradient_equals_numpy(spark):
    a = np.random.default_rng(0).integers(0, 256, (9, 7))
    pix = spark.createDataFrame([(y, x, int(a[y, x])) for y in range(9) for x in range(7)], "py int, px int, v int")
    dy, dx = np.gradient(a.astype(float))
    got = {(r["py"], r["px"]): r["gradient"] for r in texture.gradient(pix, "v").collect()}
    assert all(got[y, x] == pytest.approx(math.hypot(dy[y, x], dx[y, x])) for y in range(9) for x in range(7))


# resampling


def test_resampling_of_small_rasters(spark):
    from pointweave.operators import raster

    a = np.arange(24).reshape(4, 6) ** 2
    pix = spark.createDataFrame([(y, x, int(a[y, x])) for y in range(4) for x in range(6)], "py int, px int, v int")
    grid = lambda df: {(r["i"], r["j"]): r["v"] for r in df.collect()}
    same = {(y, x): a[y, x] for y in range(4) for x in range(6)}
    assert grid(raster.resize_bilinear(pix, "v", 4, 6, 4, 6)) == same == grid(raster.resize_area(pix, "v", 4, 6, 4, 6))
    assert grid(raster.resize_area(pix, "v", 4, 6, 2, 3)) == {(i, j): a[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for i in range(2) for j in range(3)}
    # a half: the new centre lies between four old ones
    assert grid(raster.resize_bilinear(pix, "v", 4, 6, 2, 3)) == {(i, j): a[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for i in range(2) for j in range(3)}
    wide = grid(raster.resize_bilinear(pix, "v", 4, 6, 8, 12))
    assert wide[0, 0] == a[0, 0] and wide[7, 11] == a[3, 5] and wide[0, 1] == pytest.approx(0.75 * a[0, 0] + 0.25 * a[0, 1])
    part = grid(raster.resize_area(pix.where("px < 5"), "v", 4, 6, 1, 2))
    assert part[0, 1] == pytest.approx(a[:, 3:5].mean())
