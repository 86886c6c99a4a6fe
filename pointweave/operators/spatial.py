"""Radius graphs, nearest neighbours, hull and box membership on grids of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import broadcast_if_small, materialize
from .components import connected_components, merge_components

#: One half of the cells around a cell; with the cell itself each unordered pair of cells comes once.
_HALF = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
_AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
#: Rows of a block in which nearest vectors are sought; marks of vectors without a distance and of a query itself.
KNN_BLOCK = 8192
_NO_DISTANCE, _SAME = 2**63 - 2, 2**63 - 1
#: Side of a square of radius edges by their reach, the points beyond which more tasks share it, and pairs and rows at once.
EDGE_SQUARE, SQUARE_POINTS, PAIRS, EDGE_ROWS = 8, 100_000, 2_000_000, 100_000


def _cells(points: DataFrame, r: float) -> DataFrame:
    return points.withColumn("_cx", F.floor(F.col("x") / r)).withColumn("_cy", F.floor(F.col("y") / r))


def _near(offsets, cx: str = "_cx", cy: str = "_cy"):
    return F.explode(F.array(*[F.struct((F.col(cx) + a).alias("cx"), (F.col(cy) + b).alias("cy")) for a, b in offsets]))


def radius_edges(points: DataFrame, r: float) -> DataFrame:
    """(image_id, src, dst, weight) of all pairs within r, src < dst.

    Points meet in squares of EDGE_SQUARE times r: a pair belongs to the square of its lower point (the left one, then the
    one of the lesser nid, of two in one row), which sees the points up to r above and beside it. So a point travels some
    1.4 times as a slim row, and pairs are made in the tasks, PAIRS at once. A square of more than SQUARE_POINTS points is
    dealt to more tasks, each for a share of its lower points.
    """
    import pyarrow as pa

    side, shuffle = EDGE_SQUARE * r, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = r * (1 + 1e-9)
    p = points.select("image_id", "nid", "x", "y").dropna()
    p = p if hasattr(points, "written_to") else materialize(p)
    cell = lambda c, d=0.0: F.floor((F.col(c) + d) / side)
    place = lambda cx, cy: F.struct(cx.alias("cx"), cy.alias("cy"))
    around = F.array_distinct(F.array(place(cell("x"), cell("y")), *[place(cell("x", dx * reach), cell("y", dy * reach)) for dx, dy in ((-1, 0), (1, 0), (-1, -1), (0, -1), (1, -1))]))
    key = ["image_id", "cx", "cy"]
    full = p.select("image_id", cell("x").alias("cx"), cell("y").alias("cy")).groupBy(*key).agg(F.count("*").alias("n"))
    full = full.where(F.col("n") > SQUARE_POINTS).withColumn("_parts", F.ceil(F.col("n") / SQUARE_POINTS).cast("int")).drop("n")
    seen = p.select("*", F.inline(around)).join(broadcast_if_small(materialize(full)), key, "left")
    seen = seen.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).withColumn("parts", F.coalesce("_parts", F.lit(1)))
    own = (cell("x") == F.col("cx")) & (cell("y") == F.col("cy")) & (F.pmod(F.xxhash64("nid"), F.col("parts")) == F.col("part"))
    dealt = seen.select(*key, "part", "y", "x", "nid", own.alias("own")).repartition(shuffle, *key, "part").sortWithinPartitions(*key, "part")
    kind = points.schema["image_id"].dataType.simpleString()
    nid = points.schema["nid"].dataType.simpleString()
    schema = f"image_id {kind}, src {nid}, dst {nid}, weight double"

    def run(batches):
        held: list = []
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            change = np.zeros(max(batch.num_rows - 1, 0), bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                now = tuple(k[i] for k in keys)
                if held and held[0][0] != now:
                    yield from done([h[1] for h in held])
                    held = []
                held.append((now, batch.slice(i, j - i)))
        if held:
            yield from done([h[1] for h in held])

    def done(parts):
        t = pa.Table.from_batches(parts)
        y, x, n, mine = (t[c].to_numpy() for c in ("y", "x", "nid", "own"))
        image = t["image_id"][0]
        x, y = (v.astype(np.int64) if np.issubdtype(v.dtype, np.integer) else v for v in (x, y))
        # in strips as wide as the reach and upwards in each, what a lower point may meet is one run of its own strip and
        # of both beside it
        strip = np.floor((x - x.min()) / reach).astype(np.int64) + 1
        apart, height = float(np.ptp(y)) + 3 * reach, y - y.min()
        more = 1e-12 * apart * (strip.max() + 2)
        order = np.lexsort((height, strip))
        y, x, n, mine, strip, height = (v[order] for v in (y, x, n, mine, strip, height))
        at_, low = strip * apart + height, np.flatnonzero(mine)
        starts = np.concatenate([(strip[low] + d) * apart + height[low] for d in (-1, 0, 1)])
        first, last = np.searchsorted(at_, starts - more, "left"), np.searchsorted(at_, starts + reach + more, "right")
        low = np.tile(low, 3)
        ends, at = np.cumsum(last - first), 0
        while at < len(low):
            upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
            for wide in range(int(first[at]), int(last[at]), PAIRS) if upto == at + 1 else (None,):
                a, b = first[at:upto], last[at:upto]
                if wide is not None:
                    a, b = np.array([wide]), np.minimum(b, wide + PAIRS)
                size = b - a
                p = np.repeat(low[at:upto], size)
                q = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
                dx, dy = x[q] - x[p], y[q] - y[p]
                d2 = dx * dx + dy * dy
                good = np.flatnonzero((d2 <= r * r) & ((dy > 0) | (dx > 0) | ((dx == 0) & (n[q] > n[p]))))
                p, q = n[p[good]], n[q[good]]
                for k in range(0, len(good), EDGE_ROWS):
                    u, v = p[k : k + EDGE_ROWS], q[k : k + EDGE_ROWS]
                    w = np.sqrt(d2[good[k : k + EDGE_ROWS]].astype(float))
                    yield pa.RecordBatch.from_arrays([pa.repeat(image, len(u)), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(w)], names=["image_id", "src", "dst", "weight"])
            at = upto

    return dealt.mapInArrow(run, schema)


def prune(edges: DataFrame, min_neighbours: int = 3) -> DataFrame:
    """Edges whose ends both have so many neighbours; one pass, degrees are those before it."""
    ends = edges.select("image_id", F.explode(F.array("src", "dst")).alias("nid"))
    kept = ends.groupBy("image_id", "nid").count().where(F.col("count") >= min_neighbours).select("image_id", "nid")
    for c in ("src", "dst"):
        edges = edges.join(kept.withColumnRenamed("nid", c), ["image_id", c], "left_semi")
    return edges.select("image_id", "src", "dst", "weight")


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("image_id", F.explode(F.array("src", "dst")).alias("nid")).distinct()


def _squares(points: DataFrame, r: float) -> DataFrame:
    """points with gx, gy: squares so small that any two points of one are within r."""
    return points.withColumn("gx", F.floor(F.col("x") * 1.4143 / r)).withColumn("gy", F.floor(F.col("y") * 1.4143 / r))


_NEXT = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]


def _meet(few: DataFrame, points: DataFrame, r: float, *columns) -> DataFrame:
    """Pairs of few and points (both with gx, gy) within r: image_id, nid of few and columns of points."""
    a = few.select("image_id", F.col("nid").alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"), _near(_NEXT, "gx", "gy").alias("c"))
    a = a.select("image_id", "_n", "_x", "_y", F.col("c.cx").alias("gx"), F.col("c.cy").alias("gy"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    met = a.join(points, ["image_id", "gx", "gy"]).where((dx * dx + dy * dy <= r * r) & (F.col("nid") != F.col("_n")))
    return met.select("image_id", F.col("_n").alias("nid"), *columns)


def well_linked(points: DataFrame, r: float, least: int) -> DataFrame:
    """points, with their squares gx, gy, that have so many others within r; no table of edges is made.

    All points of a square with more than least are; the others, at most least in a square, meet the squares around, so
    a point is met at most 25 * least times.
    """
    p = materialize(_squares(points.dropna(subset=["image_id", "nid", "x", "y"]), r))
    key = ["image_id", "gx", "gy"]
    full = materialize(p.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(*key))
    dense = p.join(broadcast_if_small(full), key, "left_semi").select(*p.columns)
    sparse = p.join(broadcast_if_small(full), key, "left_anti").select(*p.columns)
    enough = _meet(sparse, p.select(*key, "nid", "x", "y"), r).groupBy("image_id", "nid").count().where(F.col("count") >= least)
    return dense.unionAll(sparse.join(enough.select("image_id", "nid"), ["image_id", "nid"], "left_semi").select(*p.columns))


def label_squares(points: DataFrame, r: float) -> DataFrame:
    """(image_id, gx, gy, n, component) of the squares of points that have gx, gy (written before): components of the
    graph of all pairs within r, component the least nid.

    A square's points are linked, so squares are the nodes. Most links show by the squares' boxes alone: the points at
    two facing sides are near wherever they lie along them. Points meet only for squares in reach of each other that
    these links leave apart.
    """
    key = ["image_id", "gx", "gy"]
    box = materialize(points.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("nid").alias("nid"), *[f(k).alias(f"{k}{i}") for k in "xy" for i, f in ((0, F.min), (1, F.max))]
    ).withColumn("node", F.struct("image_id", "nid")))
    half = [o for o in _NEXT if o > (0, 0)]
    names = {k: f"_{k}" for k in ("node", "x0", "x1", "y0", "y1")}
    left = box.select("image_id", *[F.col(k).alias(v) for k, v in names.items()], F.col("gx").alias("ax"), F.col("gy").alias("ay"), _near(half, "gx", "gy").alias("c"))
    pairs = left.select("*", F.col("c.cx").alias("gx"), F.col("c.cy").alias("gy")).drop("c").join(box, key)
    gap = lambda k: F.greatest(F.col(f"{k}0") - F.col(f"_{k}1"), F.col(f"_{k}0") - F.col(f"{k}1"), F.lit(0))
    far = lambda k: F.greatest(F.col(f"{k}1") - F.col(f"_{k}0"), F.col(f"_{k}1") - F.col(f"{k}0"))
    # facing sides: their distance across, at most the boxes' extent along
    face = lambda k: F.least(F.abs(F.col(f"{k}0") - F.col(f"_{k}1")), F.abs(F.col(f"_{k}0") - F.col(f"{k}1")))
    near = F.least(face("x") * face("x") + far("y") * far("y"), face("y") * face("y") + far("x") * far("x")) <= r * r
    pairs = materialize(pairs.where(gap("x") * gap("x") + gap("y") * gap("y") <= r * r).withColumn("near", near))
    found = connected_components(pairs.where("near").select(F.col("_node").alias("a"), F.col("node").alias("b")))
    for c in ("node", "_node"):
        up = found.select(F.col("child").alias(c), F.col("parent").alias(f"{c}_top"))
        pairs = pairs.join(up, c, "left").withColumn(f"{c}_top", F.coalesce(f"{c}_top", c))
    apart = materialize(pairs.where("NOT near AND node_top <> _node_top").select("image_id", "ax", "ay", "gx", "gy", "node", "_node", "x0", "x1", "y0", "y1"))
    slim = points.select("image_id", "nid", "x", "y", "gx", "gy")
    out = lambda k: F.greatest(F.col(f"{k}0") - F.col(f"_{k}"), F.col(f"_{k}") - F.col(f"{k}1"), F.lit(0))
    one = slim.select("image_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("gx").alias("ax"), F.col("gy").alias("ay"))
    one = one.join(apart, ["image_id", "ax", "ay"]).where(out("x") * out("x") + out("y") * out("y") <= r * r)
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    met = one.join(slim, key).where(dx * dx + dy * dy <= r * r).select(F.col("_node").alias("a"), F.col("node").alias("b")).distinct()
    found = merge_components(found, met).select(F.col("child").alias("node"), F.col("parent.nid").alias("component"))
    return materialize(box.join(found, "node", "left").select(*key, "n", F.coalesce("component", "nid").alias("component")))


def label_linked(points: DataFrame, r: float, min_size: int = 1) -> DataFrame:
    """points (with gx, gy, written before) with component, of the components with so many points."""
    squares = label_squares(points, r)
    large = squares.groupBy("image_id", "component").agg(F.sum("n").alias("size")).where(F.col("size") >= min_size)
    squares = materialize(squares.join(large.select("image_id", "component"), ["image_id", "component"], "left_semi").select("image_id", "gx", "gy", "component"))
    return points.join(broadcast_if_small(squares), ["image_id", "gx", "gy"]).drop("gx", "gy")


def nearest_label(points: DataFrame, labelled: DataFrame, r: float) -> DataFrame:
    """points (image_id, nid, x, y) with the label of the nearest labelled point within r, else 0; ties to the least nid.

    Labelled points meet the cells around them. A first search goes as far as a labelled point is likely to be, in cells of
    that side; points with none so near search twice as far until r. So the pairs do not grow with the labels' density.
    """
    labelled = materialize(labelled.select("image_id", "nid", "x", "y", "label"))
    n = _cells(labelled, r).groupBy("image_id", "_cx", "_cy").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    reach, rest, parts = float(r), points, []
    while n and n > 4 and reach > r / 1024:
        reach, n = reach / 2, n / 4
    while True:
        p = _cells(rest, reach).withColumnsRenamed({"_cx": "cx", "_cy": "cy"})
        q = _cells(labelled, reach).select(
            "image_id", F.col("nid").alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"), "label", _near(_AROUND).alias("c"),
        ).select("image_id", "_n", "_x", "_y", "label", "c.cx", "c.cy")
        d2 = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
        near = (
            p.join(q, ["image_id", "cx", "cy"])
            .withColumn("d2", d2)
            .where(F.col("d2") <= reach * reach)
            .groupBy("image_id", "nid")
            .agg(F.min_by("label", F.struct("d2", "_n")).alias("label"))
        )
        near = materialize(near)
        parts.append(near)
        if reach >= r:
            break
        rest, reach = materialize(rest.join(near, ["image_id", "nid"], "left_anti").select(*points.columns)), min(2 * reach, float(r))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    return points.join(found, ["image_id", "nid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def in_boxes(points: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """(image_id, component, nid) of points in closed boxes; boxes are spread over grid cells for an equi-join."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    b = boxes.withColumn("cx", span("min_x", "max_x")).withColumn("cy", span("min_y", "max_y"))
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return (
        p.join(b, ["image_id", "cx", "cy"])
        .where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
        .select("image_id", "component", "nid", "x", "y")
    )


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The corners of the convex hull in counter-clockwise order, by a lower and an upper chain; all points if flat."""
    pts = sorted(set(zip(pdf["x"], pdf["y"], strict=True)))
    if len(pts) > 2:
        half = []
        for run in (pts, pts[::-1]):
            out = []
            for p in run:
                while len(out) > 1 and (
                    (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
                ):
                    out.pop()
                out.append(p)
            half += out[:-1]
        pts = half
    return pd.DataFrame(
        {"image_id": pdf["image_id"].iloc[0], "component": pdf["component"].iloc[0], "x": [p[0] for p in pts],
         "y": [p[1] for p in pts], "turn": range(len(pts))}
    )


def hull_edges(members: DataFrame, cell: int = 1024) -> DataFrame:
    """Directed edges (px, py, qx, qy) of the convex hull of each (image_id, component), counter-clockwise.

    Hulls of grid cells come first, then the hull of their corners, so a large component is never one group of all its
    points.
    """
    kinds = dict(members.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("image_id", "component", "x", "y")) + ", turn int"
    m = members.select("image_id", "component", "x", "y").distinct()
    m = m.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    local = m.groupBy("image_id", "component", "_cx", "_cy").applyInPandas(_chain, schema)
    corners = local.groupBy("image_id", "component").applyInPandas(_chain, schema)
    w = Window.partitionBy("image_id", "component").orderBy("turn")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first)).alias(f"q{c}")
    return corners.select("image_id", "component", F.col("x").alias("px"), F.col("y").alias("py"), nxt("x"), nxt("y"))


def in_hulls(points: DataFrame, members: DataFrame) -> DataFrame:
    """(image_id, component, nid) of all points inside or on the convex hull of a component's members.

    A hull travels as one array of its edges, which are few; a point is tested against all of them in its row.
    """
    from .tables import boxes

    near = in_boxes(points, boxes(members, ["image_id", "component"]))
    edges = hull_edges(members).groupBy("image_id", "component").agg(
        F.collect_list(F.struct("px", "py", "qx", "qy")).alias("hull")
    )
    side = lambda e: (e["qx"] - e["px"]) * (F.col("y") - e["py"]) - (e["qy"] - e["py"]) * (F.col("x") - e["px"])
    return near.join(edges, ["image_id", "component"]).where(F.forall("hull", lambda e: side(e) >= 0)).drop("hull")


def knn(queries: DataFrame, base: DataFrame, k: int, block: int = KNN_BLOCK) -> DataFrame:
    """The k nearest rows of base (b_id, v, ...) of each query (q_id, qv), with d2 and rank; ids that are equal never meet.

    Vectors are arrays of whole numbers and distances exact longs; equal ones are ordered by b_id. A vector that is null,
    holds a null or is shorter than others has no distance and comes last. Every block of queries meets every block of
    base in a task of its own, which keeps k rows a query; those of all blocks are ranked again.
    """
    import pyarrow as pa

    n, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    parts, asked = -(-max(n, 1) // block), -(-max(queries.count(), 1) // block)
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select("q_id", "qv", dealt("q_id", asked).alias("_q"), every(parts).alias("_b"))
    right = base.select("*", dealt("b_id", parts).alias("_b"), every(asked).alias("_q"))
    rest = [c for c in base.columns if c != "v"]
    schema = ", ".join(["q_id long", *[f"{c} {base.schema[c].dataType.simpleString()}" for c in rest], "d2 long"])

    def nearest(asking: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("b_id")
        (q, no_q), (v, no_v) = _whole_rows(asking["qv"], width or 0), _whole_rows(held["v"], width or 0)
        rows, cols, found = [], [], []
        for at in range(0, len(q), 256):
            d2 = _squared_distances(q[at : at + 256], v)
            d2[no_q[at : at + 256]], d2[:, no_v] = _NO_DISTANCE, _NO_DISTANCE
            d2[asking["q_id"].to_numpy()[at : at + 256, None] == held["b_id"].to_numpy()] = _SAME
            last = np.partition(d2, k - 1, axis=1)[:, k - 1 : k] if d2.shape[1] > k else _SAME
            i, j = np.nonzero((d2 <= last) & (d2 < _SAME))
            order = np.lexsort((j, d2[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows, cols, found = [*rows, i[first] + at], [*cols, j[first]], [*found, d2[i, j][first]]
        i, j, d2 = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (rows, cols, found))
        out = [asking["q_id"].take(pa.array(i)), *[held[c].take(pa.array(j)) for c in rest], pa.array(d2, mask=d2 == _NO_DISTANCE)]
        return pa.table(out, names=["q_id", *rest, "d2"])

    met = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInArrow(nearest, schema)
    order = Window.partitionBy("q_id").orderBy(F.asc_nulls_last("d2"), "b_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _whole_rows(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of whole numbers as rows of width, and which of them are none: null, with a null or of another length."""
    lists = column.combine_chunks()
    flat, sizes = lists.flatten(), lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    bad, out = sizes != width, np.zeros((len(lists), width), np.int64)
    if flat.null_count:
        owner = np.repeat(np.arange(len(lists)), np.maximum(sizes, 0))
        bad[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    held = np.repeat(~bad, np.maximum(sizes, 0))
    out[~bad] = flat.fill_null(0).to_numpy(zero_copy_only=False)[held].reshape(-1, width)
    return out, bad


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a and b; by one product where no sum leaves the whole numbers of a double."""
    top = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    if 4 * top * top * max(a.shape[1], 1) < 2**53:
        p, q = a.astype(float), b.astype(float)
        return ((p * p).sum(1)[:, None] + (q * q).sum(1) - 2 * (p @ q.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for c in range(a.shape[1]):
        step = a[:, c, None] - b[:, c]
        out += step * step
    return out


def dbscan(points: DataFrame, r: float, min_points: int) -> DataFrame:
    """points with cluster: components of core points (min_points within r, themselves included); a border point takes
    the least of the clusters around it, noise is null."""
    core = materialize(well_linked(points.select("image_id", "nid", "x", "y"), r, min_points - 1))
    cores = materialize(label_squares(core, r).join(core, ["image_id", "gx", "gy"]))
    others = _squares(points.select("image_id", "nid", "x", "y").dropna(), r).join(core.select("image_id", "nid"), ["image_id", "nid"], "left_anti")
    border = _meet(others, cores, r, "component").groupBy("image_id", "nid").agg(F.min("component").alias("component"))
    found = cores.select("image_id", "nid", "component").unionByName(border).withColumnRenamed("component", "cluster")
    return points.join(found, ["image_id", "nid"], "left")
