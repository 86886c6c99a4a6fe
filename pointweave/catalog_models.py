"""Queries on splits, scaling, the scores of models, pixel classifiers and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cohort, delaunay, ml, pixels, shapes, tables
from .sources import adapters as ad
from .sources.storage import materialize, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus AS y, md5('44:' || o_orderkey) AS h FROM orders)
  SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY h, o_orderkey) <= floor(count(*) OVER (PARTITION BY y) * 0.5) AS train FROM x""")
def stratified_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"))
    return cohort.stratified_split(o, "y", "o_orderkey", 0.5, "44:")


_SCALED = ("num_nuclei", "major_axis")


@query(f"WITH {ad.COHORT} SELECT aggregate_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _SCALED) + ", 0.0::DOUBLE AS same FROM cohort")
def standard_scaled(spark, d):
    c = ad.cohort(spark, d).select("aggregate_id", *_SCALED, F.lit(20).alias("same"))
    out = cohort.standard_scaled(c, [*_SCALED, "same"])
    return out.select("aggregate_id", *[F.round(k, 6).alias(k) for k in (*_SCALED, "same")])


@query(f"WITH {ad.COHORT} SELECT aggregate_id, " + ", ".join(f"round(({c} - min({c}) OVER ())::DOUBLE / (max({c}) OVER () - min({c}) OVER ()), 9) AS {c}" for c in _SCALED) + ", 0.0::DOUBLE AS same FROM cohort")
def min_max_scaled(spark, d):
    c = ad.cohort(spark, d).select("aggregate_id", *_SCALED, F.lit(20).alias("same"))
    out = cohort.min_max_scaled(c, [*_SCALED, "same"])
    return out.select("aggregate_id", *[F.round(k, 9).alias(k) for k in (*_SCALED, "same")])


@query("""WITH s AS (SELECT CAST(o_orderkey % 3 AS INT) AS y, [(o_custkey % 89 + (o_orderkey % 3 = 0)::INT * 9)::BIGINT, (o_custkey % 83 + (o_orderkey % 3 = 1)::INT * 7)::BIGINT,
    (o_orderkey % 79 + (o_orderkey % 3 = 2)::INT * 5)::BIGINT] AS p FROM orders),
  pairs AS (SELECT i, j, (y = i)::INT AS y, p[i + 1] AS score FROM s, range(3) a(i), range(3) b(j) WHERE i <> j AND y IN (i, j)),
  g AS (SELECT i, j, score, sum(y) AS p, count(*) - sum(y) AS q FROM pairs GROUP BY 1, 2, 3),
  w AS (SELECT *, p * (coalesce(sum(q) OVER (PARTITION BY i, j ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0) AS w FROM g)
  SELECT round(avg(a), 9) AS auc FROM (SELECT CAST(sum(w) AS DOUBLE) / CAST(sum(p) * sum(q) AS DOUBLE) AS a FROM w GROUP BY i, j)""")
def macro_auc(spark, d):
    y = (F.col("o_orderkey") % 3).cast("int")
    raised = lambda c, m, k, by: (F.col(c) % m + (y == k).cast("int") * by).alias(f"p{k}")
    s = table(spark, d, "orders").select(y.alias("y"), raised("o_custkey", 89, 0, 9), raised("o_custkey", 83, 1, 7), raised("o_orderkey", 79, 2, 5))
    return cohort.macro_auc(s, 3).select(F.round("auc", 9).alias("auc"))


@query()
def repeated_scores(spark, d):
    """Logistic models of large aggregates on ten stratified splits."""
    data = ad.cohort(spark, d).withColumn("large", (F.col("nuclei_area") > 2500 + F.col("num_nuclei")).cast("int"))
    return ml.repeated_scores(ml.logistic, data, ["num_nuclei", "nuclei_area", "major_axis"], "large", "aggregate_id", repeats=10)


def _tissue(spark, d):
    return ad.pixels(spark, d).where("r > 0")


@query()
def pixel_classes(spark, d):
    """Dark regions of more than 60 pixels, by a forest that learned from half of the raster."""
    pix = _tissue(spark, d)
    marked = pixels.labelled_pixels(pix, pix.where("label > 0")).withColumn("at", F.concat_ws(",", "py", "px"))
    model, _ = pixels.train_pixel_classifier(marked.select("at", "y", "r", "g", "b"), "at", trees=20)
    return pixels.marked_regions(pix, model, 60).select("py", "px", "component")


_DARK = "(r * 3 + g + b) % 11 < 8"


@query(f"""WITH RECURSIVE {ad.PIX}, fg AS (SELECT py, px FROM pix WHERE label > 0 AND {_DARK}), near AS (
    SELECT a.py AS ay, a.px AS ax, b.py AS bp, b.px AS bx FROM fg a JOIN fg b ON a.py = b.py AND abs(a.px - b.px) = 1 UNION ALL
    SELECT a.py, a.px, b.py, b.px FROM fg a JOIN fg b ON a.px = b.px AND abs(a.py - b.py) = 1), flood(py, px, c) AS (
    SELECT py, px, py * 100000 + px FROM fg UNION SELECT bp, bx, c FROM flood JOIN near ON ay = py AND ax = px WHERE c < bp * 100000 + bx),
  comp AS (SELECT py, px, min(c) AS c FROM flood GROUP BY 1, 2)
  SELECT py, px, c // 100000 AS first_row, c % 100000 AS first_col FROM comp WHERE c IN (SELECT c FROM comp GROUP BY c HAVING count(*) > 60)""")
def large_regions(spark, d):
    fg = ad.pixels(spark, d).where(f"label > 0 AND {_DARK}")
    return pixels.large_regions(fg, 60).select("py", "px", F.col("component.py").alias("first_row"), F.col("component.px").alias("first_col"))


@query("""SELECT s_suppkey AS image_id, s_nationkey % 4 AS scene_id, round(5 * (1 + s_suppkey % 8) + s_nationkey / 100.0::DOUBLE, 2) AS magnification FROM supplier
  WHERE trunc(5 * (1 + s_suppkey % 8) + s_nationkey / 100.0::DOUBLE) = 20""")
def valid_scenes(spark, d):
    mag = 5 * (1 + F.col("s_suppkey") % 8) + F.col("s_nationkey") / 100.0
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_nationkey") % 4).alias("scene_id"), mag.alias("magnification"))
    return tables.valid_scenes(s, 20).withColumn("magnification", F.round("magnification", 2))


@query(f"""WITH {ad.PIX}, t AS (SELECT py // 25 AS sy, px // 25 AS sx, count(*) AS n, avg((r > 0 AND least(r, g, b) < 200)::INT) AS fraction, sum((py % 25 = 12 AND px % 25 = 12 AND label > 0)::INT) AS nuclei FROM pix GROUP BY 1, 2)
  SELECT sy, sx, nuclei, round(fraction, 9) AS fraction, round(nuclei / (fraction * 0.016 * 20 + 1e-8), 6) AS density FROM t""")
def tissue_density(spark, d):
    """Nuclei of each superpixel over its tissue: a superpixel is a square of the raster, a nucleus the middle of a disc."""
    p = ad.pixels(spark, d).withColumns({"sy": F.expr("py div 25"), "sx": F.expr("px div 25")})
    nuclei = p.where("py % 25 = 12 AND px % 25 = 12 AND label > 0")
    tissue = p.withColumn("tissue", (F.col("r") > 0) & (F.least("r", "g", "b") < 200))
    out = tables.tissue_density(tissue, nuclei, ["sy", "sx"], 0.016, 20)
    return out.select("sy", "sx", "nuclei", F.round("fraction", 9).alias("fraction"), F.round("density", 6).alias("density"))


_HEIGHT = 10000
_CHOSEN = f"""pick AS (SELECT label % 4 AS component, py, px FROM pix WHERE label > 0 AND label % 4 < 2 AND py <= {_HEIGHT} - 2 AND px <= {ad.PIX_WIDTH} - 2),
  win AS (SELECT component, greatest(min(py), 1) - 1 AS r0, max(py) + 1 AS r1, greatest(min(px), 1) - 1 AS c0, max(px) + 1 AS c1 FROM pick GROUP BY 1)"""


def _included(spark, d, mode):
    """Aggregates of the discs whose labels leave 0 or 1 by four."""
    mask = ad.pixels(spark, d).where("label > 0").select("py", "px", "label")
    members = mask.where("label % 4 < 2").select((F.col("label") % 4).alias("component"), "label").distinct()
    return shapes.included_pixels(mask, members, _HEIGHT, ad.PIX_WIDTH, mode)


@query(f"WITH {ad.PIX}, {_CHOSEN} SELECT component, py, px, py - r0 AS row, px - c0 AS col FROM pick JOIN win USING (component)")
def pixels_of_members(spark, d):
    return _included(spark, d, "dtfe")


@query(f"""WITH {ad.PIX}, {_CHOSEN} SELECT component, py, px, py - r0 AS row, px - c0 AS col FROM pix JOIN win ON py >= r0 AND py < r1 AND px >= c0 AND px < c1
  WHERE label > 0""")
def pixels_in_box(spark, d):
    return _included(spark, d, "bbox")


@query()
def pixels_in_hull(spark, d):
    return _included(spark, d, "convex")


@query()
def dtfe_grid_fitted(spark, d):
    """Densities to a square of 256 pixels, so that the fitted grid is finer than one place a nucleus."""
    p = materialize(ad.positions(ad.nuclei(spark, d)))
    c = delaunay.delaunay_corners(p, densities=True)
    per_square = materialize(delaunay.density(c).withColumn("dtfe", F.col("dtfe") * 65536).select("image_id", "nid", "dtfe"))
    c = c.withColumns({f"{k}d": F.col(f"{k}d") * 65536 for k in "abc"})
    return delaunay.gridded_to_fit(c, per_square).withColumn("density", F.round("density", 6))


_SLIDES = """slides AS (SELECT o_orderkey AS id, (o_orderkey % 7) / 8.0::DOUBLE AS avg_tissue_per_tile, o_custkey % 40 AS num_tiles, o_orderkey % 991 AS original_num_nuclei,
  o_orderkey % 313 AS num_nuclei_total, o_orderkey % 307 AS num_nuclei_dtfe_only, o_orderkey % 4001 AS num_pixels_cluster, o_orderkey % 211 AS num_nuclei_cluster,
  o_orderkey % 19 AS num_clusters, 1 + (o_orderkey % 9) / 16.0::DOUBLE AS bc_frac_dim_dtfe_wsi, (o_custkey % 9) / 8.0::DOUBLE AS bc_frac_dim_full_wsi FROM orders)"""
_TO_TISSUE = {"nuclei_density": "original_num_nuclei", "nuclei_density_aggregates": "num_nuclei_total", "nuclei_density_dtfe": "num_nuclei_dtfe_only",
              "norm_pixels_max_cluster": "num_pixels_cluster", "norm_nuclei_max_cluster": "num_nuclei_cluster", "norm_num_clusters": "num_clusters",
              "norm_bc_frac_dim_dtfe_wsi": "bc_frac_dim_dtfe_wsi"}


@query(f"WITH {_SLIDES}, t AS (SELECT *, avg_tissue_per_tile * num_tiles AS total_tissue FROM slides) SELECT id, round(total_tissue, 6) AS total_tissue, "
       + ", ".join(f"round({c} / nullif(total_tissue, 0), 6) AS {n}" for n, c in _TO_TISSUE.items())
       + ", round(bc_frac_dim_dtfe_wsi / nullif(bc_frac_dim_full_wsi, 0), 6) AS bc_frac_dim_wsi_ratio FROM t")
def slide_ratios(spark, d):
    key = lambda n: F.col("o_orderkey") % n
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (key(7) / 8.0).alias("avg_tissue_per_tile"), (F.col("o_custkey") % 40).alias("num_tiles"),
        key(991).alias("original_num_nuclei"), key(313).alias("num_nuclei_total"), key(307).alias("num_nuclei_dtfe_only"), key(4001).alias("num_pixels_cluster"),
        key(211).alias("num_nuclei_cluster"), key(19).alias("num_clusters"), (1 + key(9) / 16.0).alias("bc_frac_dim_dtfe_wsi"),
        (F.col("o_custkey") % 9 / 8.0).alias("bc_frac_dim_full_wsi"),
    )
    names = ["total_tissue", *_TO_TISSUE, "bc_frac_dim_wsi_ratio"]
    return cohort.slide_ratios(o).select("id", *[F.round(c, 6).alias(c) for c in names])


@query(f"""WITH {ad.NUC}, {ad.TILES} SELECT n.image_id, nid, row_number() OVER (PARTITION BY n.image_id ORDER BY nid) AS slide_label FROM nuc n
  JOIN tiles t ON t.image_id = n.image_id AND tile_row = y // 1024 AND tile_col = x // 1024 WHERE tissue > 0.25""")
def slide_labels(spark, d):
    n = ad.nuclei(spark, d)
    kept = tables.density_input(n, ad.tiles(n)).select("image_id", "nid")
    return tables.numbered(kept, ["image_id"], "nid", "slide_label")


@query(f"""WITH {ad.NUC}, {ad.TILES}, k AS (SELECT * FROM tiles WHERE tissue > 0.25 AND num_nuclei > 5), c AS (
    SELECT image_id, avg(num_nuclei / (tissue * 0.25)) AS a, var_samp(num_nuclei / (tissue * 0.25)) AS v FROM k GROUP BY 1),
  f AS (SELECT n.image_id, avg(m.area / 1000) AS a, var_samp(m.area / 1000) AS v FROM nuc n JOIN k ON k.image_id = n.image_id AND tile_row = n.y // 1024 AND tile_col = n.x // 1024
    JOIN nuc m ON m.image_id = n.image_id AND m.x = n.x AND m.y = n.y GROUP BY 1)
  SELECT c.image_id, round(c.a, 6) AS avg_nuclei_density, round(c.v, 6) AS var_nuclei_density, round(f.a, 9) AS avg_dtfe, round(f.v, 9) AS var_dtfe FROM c LEFT JOIN f USING (image_id)""")
def subject_statistics(spark, d):
    """A nucleus' area stands for its density, which SQL cannot triangulate."""
    n = ad.nuclei(spark, d)
    field = n.select("image_id", F.col("x") + 0.02, F.col("y") - 0.02, F.col("area") / 1000).toDF("image_id", "x", "y", "dtfe")
    out = tables.subject_statistics(ad.tiles(n), tables.with_tile(n), field, 0.5, 0.25, 5)
    return out.select("image_id", *[F.round(c, k).alias(c) for c, k in (("avg_nuclei_density", 6), ("var_nuclei_density", 6), ("avg_dtfe", 9), ("var_dtfe", 9))])


@query("SELECT c_custkey, n_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def strict_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return tables.lookup(c, table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("""SELECT id, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(least, 0) AS least FROM (SELECT o_custkey % 50 AS id, count(*) AS n FROM orders WHERE o_custkey % 50 < 40 GROUP BY 1) a
  FULL JOIN (SELECT p_partkey % 60 AS id, sum(p_size)::BIGINT AS total FROM part WHERE p_partkey % 60 > 20 GROUP BY 1) b USING (id)
  FULL JOIN (SELECT s_suppkey % 70 AS id, min(s_nationkey) AS least FROM supplier GROUP BY 1) c USING (id)""")
def aligned_features(spark, d):
    o, p, s = table(spark, d, "orders"), table(spark, d, "part"), table(spark, d, "supplier")
    parts = [
        o.groupBy((F.col("o_custkey") % 50).alias("id")).agg(F.count("*").alias("n")).where("id < 40"),
        p.groupBy((F.col("p_partkey") % 60).alias("id")).agg(F.sum("p_size").alias("total")).where("id > 20"),
        s.groupBy((F.col("s_suppkey") % 70).alias("id")).agg(F.min("s_nationkey").alias("least")),
    ]
    return tables.aligned(parts, "id")


@query("SELECT c_custkey AS id, c_name || c_mktsegment AS name FROM customer")
def one_line_texts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias(" id\n"), F.concat("c_name", F.lit("\r\n"), "c_mktsegment", F.lit("\n")).alias("na\nme "))
    return tables.one_line(c)
