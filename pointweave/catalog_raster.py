"""Queries on pixel rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .operators import raster, stains, tables
from .sources import adapters as ad
from .sources.storage import broadcast_if_small, materialize, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


W = ad.PIX_WIDTH
#: Foreground in four-neighbour components, by flood from each pixel within its 25 x 25 cell of discs.
_FLOOD = """near AS (
  SELECT a.py AS ay, a.px AS ax, b.py AS by_, b.px AS bx FROM fg a JOIN fg b ON abs(a.py - b.py) + abs(a.px - b.px) = 1
    AND a.py BETWEEN b.py - 1 AND b.py + 1 AND a.px BETWEEN b.px - 1 AND b.px + 1
), flood(py, px, c) AS (
  SELECT py, px, py * 100000 + px FROM fg
  UNION
  SELECT by_, bx, c FROM flood JOIN near ON ay = py AND ax = px WHERE c < by_ * 100000 + bx
), comp AS (SELECT py, px, min(c) AS c FROM flood GROUP BY 1, 2)"""
FLOOD = f"fg AS (SELECT py, px FROM pix WHERE label > 0), {_FLOOD}"
_STEP = "(VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx)"
#: Tissue of the raster: background of more than 180 in all channels goes, holes are filled between growth and shrinking.
TISSUE = f"""dark AS (SELECT py, px FROM pix WHERE least(r, g, b) <= 180 AND greatest(r, g, b) > 0 AND -ln((least(r, g, b) + 1) / 255.0 + 1e-8) >= 0.12),
  grown AS (SELECT DISTINCT py + dy AS py, px + dx AS px FROM dark, {_STEP}), ground AS (SELECT py, px FROM pix ANTI JOIN grown USING (py, px)),
  frame AS (SELECT min(py) AS y0, max(py) AS y1, min(px) AS x0, max(px) AS x1 FROM pix), outside(py, px) AS (
    SELECT py, px FROM ground, frame WHERE py IN (y0, y1) OR px IN (x0, x1)
    UNION
    SELECT g.py, g.px FROM outside, {_STEP}, ground g WHERE g.py = outside.py + dy AND g.px = outside.px + dx),
  edge AS (SELECT DISTINCT py + dy AS py, px + dx AS px FROM outside, {_STEP}), fg AS (SELECT py, px FROM pix ANTI JOIN edge USING (py, px)), {_FLOOD}"""


def _pix(spark, d):
    return ad.pixels(spark, d)


def _fg(spark, d):
    return _pix(spark, d).where("label > 0").select("py", "px")


def _number(c):
    """A component's place as one long: rows go beyond what an int holds."""
    return c["component.py"].cast("long") * 100000 + c["component.px"]


@query(f"WITH {ad.PIX} SELECT py, px, label FROM pix WHERE label > 0")
def mask_pixels(spark, d):
    return _pix(spark, d).where("label > 0").select("py", "px", "label")


@query(f"WITH {ad.PIX} SELECT py // 25 AS tr, px // 25 AS tc, round(avg(CASE WHEN least(r, g, b) <= 200 AND greatest(r, g, b) > 0 THEN 1.0 ELSE 0.0 END), 9) AS tissue FROM pix GROUP BY 1, 2")
def tissue_fraction(spark, d):
    p = _pix(spark, d)
    t = scalar.is_tissue(F.col("r"), F.col("g"), F.col("b")).cast("int")
    return p.groupBy(F.expr("py div 25").alias("tr"), F.expr("px div 25").alias("tc")).agg(F.round(F.avg(t), 9).alias("tissue"))


@query(f"WITH {ad.PIX} SELECT py // 25 AS tr, px // 25 AS tc, round(avg(CASE WHEN greatest(r, g, b) <= 225 THEN 1.0 ELSE 0.0 END), 9) AS tissue FROM pix GROUP BY 1, 2")
def tissue_fraction_arx(spark, d):
    t = (F.greatest("r", "g", "b") <= 225).cast("int")
    return _pix(spark, d).groupBy(F.expr("py div 25").alias("tr"), F.expr("px div 25").alias("tc")).agg(F.round(F.avg(t), 9).alias("tissue"))


@query(f"WITH {ad.PIX} SELECT py, px FROM pix WHERE least(r, g, b) < 200")
def tissue_any_channel(spark, d):
    return _pix(spark, d).where(F.least("r", "g", "b") < 200).select("py", "px")


@query(f"WITH {ad.PIX} SELECT label, min(r) AS min_intensity, max(r) AS max_intensity, CAST(trunc(avg(r)) AS INT) AS avg_intensity, CAST(trunc(stddev_pop(r)) AS INT) AS std_intensity FROM pix WHERE label > 0 GROUP BY 1")
def object_intensity(spark, d):
    return tables.object_intensity(_pix(spark, d).where("label > 0"), ["label"], "r")


@query(f"""WITH {ad.PIX}, h AS (SELECT label, floor(g / 25.6) AS bin, count(*) AS n FROM pix GROUP BY 1, 2), p AS (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p FROM h),
  e AS (SELECT label, sum(p * p) AS en, -sum(p * log2(p)) AS et FROM p GROUP BY 1)
  SELECT label, min(g) AS v_min, max(g) AS v_max, round(avg(g), 6) AS v_mean, round(median(g), 6) AS v_median, round(avg(g) - median(g), 6) AS v_mean_median,
    round(stddev_pop(g), 6) AS v_std, round(quantile_cont(g, 0.75) - quantile_cont(g, 0.25), 6) AS v_iqr, round(skewness(g), 6) AS v_skew, round(kurtosis(g), 6) AS v_kurt, round(mad(g), 6) AS v_mad,
    round(any_value(en), 6) AS hist_energy, round(any_value(et), 6) AS hist_entropy FROM pix JOIN e USING (label) GROUP BY label""")
def superpixel_intensity(spark, d):
    out = tables.full_intensity(_pix(spark, d), ["label"], "g")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("label", "v_min", "v_max")})


@query(f"WITH {ad.PIX} SELECT label, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b, round(stddev_samp(r), 6) AS std_r, round(stddev_samp(g), 6) AS std_g, round(stddev_samp(b), 6) AS std_b FROM pix GROUP BY 1")
def superpixel_rgb(spark, d):
    return _pix(spark, d).groupBy("label").agg(*[F.round(f(c), 6).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("std", F.stddev_samp)) for c in "rgb"])


@query(f"WITH {ad.PIX} SELECT py, px, max(greatest(r, g, b) - least(r, g, b)) OVER () AS spread, round(-ln((r + 1) / 255.0 + 1e-8), 6) AS od_r FROM pix WHERE label > 0")
def optical_density(spark, d):
    p = _pix(spark, d).where("label > 0")
    top = F.broadcast(p.agg(F.max(F.greatest("r", "g", "b") - F.least("r", "g", "b")).alias("spread")))
    return p.crossJoin(top).select("py", "px", "spread", F.round(scalar.optical_density(F.col("r")), 6).alias("od_r"))


INVERSE = [[1.88, -0.07, -0.60], [-1.02, 1.13, -0.48], [-0.55, -0.13, 1.57]]


def _stain_sql(k: int) -> str:
    return "round(" + " + ".join(f"-ln(({c} + 1) / 255.0 + 1e-8) * ({INVERSE[i][k]})" for i, c in enumerate("rgb")) + f", 6) AS s{k}"


@query(f"WITH {ad.PIX} SELECT py, px, {', '.join(_stain_sql(k) for k in range(3))} FROM pix")
def deconvolution(spark, d):
    s = raster.stains(F.col("r"), F.col("g"), F.col("b"), INVERSE)
    return _pix(spark, d).select("py", "px", *[F.round(s[k], 6).alias(f"s{k}") for k in range(3)])


@query(f"""WITH {ad.PIX}, h AS (SELECT g AS v, count(*) AS n FROM pix GROUP BY 1), c AS (
  SELECT v, CAST(sum(n) OVER u AS DOUBLE) AS w1, CAST(sum(n * v) OVER u AS DOUBLE) AS s1, CAST(sum(n) OVER () AS DOUBLE) AS w, CAST(sum(n * v) OVER () AS DOUBLE) AS s FROM h
  WINDOW u AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), f AS (SELECT v, w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) * (s1 / w1 - (s - s1) / (w - w1)) AS score FROM c WHERE w > w1)
  SELECT v AS threshold FROM f ORDER BY score DESC, v LIMIT 1""")
def otsu(spark, d):
    return raster.otsu(_pix(spark, d), "g")


@query(f"WITH RECURSIVE {ad.PIX}, {FLOOD} SELECT py, px, c AS component FROM comp")
def raster_components(spark, d):
    c = raster.label_components(_fg(spark, d))
    return c.select("py", "px", _number(c).alias("component"))


@query(f"WITH RECURSIVE {ad.PIX}, {FLOOD} SELECT py, px FROM comp WHERE c IN (SELECT c FROM comp GROUP BY c HAVING count(*) >= 150)")
def remove_small(spark, d):
    return raster.remove_small(raster.label_components(_fg(spark, d)), 150).select("py", "px")


@query(f"""WITH RECURSIVE {ad.PIX}, {TISSUE}, n AS (SELECT c, count(*) AS n, min(py) AS y0, max(py) AS y1 FROM comp GROUP BY 1) SELECT c AS component, n, y0, y1 FROM n WHERE n >= 150""")
def tissue_fragments(spark, d):
    c = raster.tissue_fragments(_pix(spark, d), background=180, least=150)
    return c.groupBy(_number(c).alias("component")).agg(F.count("*").alias("n"), F.min("py").alias("y0"), F.max("py").alias("y1"))


@query(f"WITH RECURSIVE {ad.PIX}, {TISSUE} SELECT py, px FROM pix ANTI JOIN outside USING (py, px)")
def filled_tissue(spark, d):
    p = _pix(spark, d)
    grid = p.select("py", "px")
    dark = p.where("least(r, g, b) <= 180 AND greatest(r, g, b) > 0").select("py", "px")
    return raster.fill_holes(materialize(raster.dilate(dark).join(grid.hint("merge"), ["py", "px"], "left_semi")), grid)


@query(f"""WITH {ad.PIX}, m AS (SELECT py // 25 AS tr, px // 25 AS tc, py % 25 AS y, px % 25 AS x, 1 + label % 4 AS lab, label FROM pix WHERE label > 0),
  n AS (SELECT tr, tc, lab, max(label) + 1000 AS wsi, avg(y) AS y, avg(x) AS x FROM m WHERE label % 11 <> 5 GROUP BY 1, 2, 3),
  o AS (SELECT min(tr) AS r0, min(tc) AS c0 FROM n), blank AS (SELECT DISTINCT tr, tc FROM m ANTI JOIN n USING (tr, tc, lab) WHERE lab > 1),
  parts AS (SELECT tr, tc, m.y, m.x, wsi AS label, 0 AS point FROM m JOIN n USING (tr, tc, lab) WHERE lab > 1
    UNION ALL SELECT tr, tc, CAST(trunc(y) AS INT), CAST(trunc(x) AS INT), 0, wsi FROM n WHERE lab > 1)
  SELECT CAST((tr - r0) * 25 + y AS INT) AS py, CAST((tc - c0) * 25 + x AS INT) AS px, max(label) AS label, max(point) AS point FROM (parts ANTI JOIN blank USING (tr, tc)), o GROUP BY 1, 2""")
def wsi_mask(spark, d):
    p = _pix(spark, d).where("label > 0")
    m = p.select(
        F.expr("int(py div 25)").alias("tile_row"), F.expr("int(px div 25)").alias("tile_col"), (F.col("py") % 25).alias("y"),
        (F.col("px") % 25).alias("x"), (1 + F.col("label") % 4).alias("label"), F.col("label").alias("own"),
    )
    n = m.where("own % 11 <> 5").groupBy("tile_row", "tile_col", "label").agg((F.max("own") + 1000).alias("slide_label"), F.avg("y").alias("y"), F.avg("x").alias("x"))
    return raster.slide_mask(m.drop("own"), n, 25)


@query(f"""WITH {ad.PIX} SELECT label % 3 AS cls, count(DISTINCT label) AS islands FROM pix WHERE label > 0 GROUP BY 1""")
def islands(spark, d):
    fg = _pix(spark, d).where("label > 0").withColumn("cls", F.col("label") % 3)
    c = raster.label_components(fg.select("py", "px", "cls"), raster.EIGHT, by="cls")
    return c.groupBy("cls").agg(F.count_distinct("component").alias("islands"))


@query(f"WITH {ad.PIX}, fg AS (SELECT py, px FROM pix WHERE label > 0) SELECT DISTINCT py + dy AS py, px + dx AS px FROM fg, (VALUES (0,0),(0,1),(1,0),(0,-1),(-1,0)) o(dy, dx)")
def dilate(spark, d):
    return raster.dilate(_fg(spark, d))


@query(f"""WITH {ad.PIX}, fg AS (SELECT py, px FROM pix WHERE label > 0) SELECT py, px FROM fg WHERE (SELECT count(*) FROM fg n WHERE abs(n.py - fg.py) + abs(n.px - fg.px) = 1) = 4""")
def erode(spark, d):
    return raster.erode(_fg(spark, d))


@query(f"WITH {ad.PIX} SELECT py, px FROM pix WHERE label > 0 AND (py + px) % 3 = 0")
def mask_and(spark, d):
    p = _pix(spark, d)
    return _fg(spark, d).join(p.where("(py + px) % 3 = 0").select("py", "px"), ["py", "px"], "left_semi")


@query(f"WITH {ad.PIX} SELECT py, px, CASE WHEN label % 4 = 3 THEN 255 ELSE r END AS r FROM pix")
def mask_omit(spark, d):
    p = _pix(spark, d)
    clot = p.where("label % 4 = 3").select("py", "px", F.lit(True).alias("omit"))
    return p.join(clot, ["py", "px"], "left").select("py", "px", F.when(F.col("omit"), 255).otherwise(F.col("r")).alias("r"))


@query(f"WITH {ad.PIX} SELECT py, px, label FROM pix WHERE label > 0 AND label NOT IN (2, 3, 7)")
def exclude_components(spark, d):
    p = _pix(spark, d).where("label > 0").select("py", "px", "label")
    ids = spark.createDataFrame([(2,), (3,), (7,)], "label int")
    return p.join(F.broadcast(ids), "label", "left_anti").select("py", "px", "label")


@query(f"""WITH {ad.PIX}, p AS (SELECT py, px, label % 3 AS v FROM pix), n AS (SELECT py, px, v, coalesce(lag(v) OVER c, lead(v) OVER c, v) AS a, coalesce(lead(v) OVER c, lag(v) OVER c, v) AS b,
  coalesce(lag(v) OVER r, lead(v) OVER r, v) AS c, coalesce(lead(v) OVER r, lag(v) OVER r, v) AS d FROM p WINDOW c AS (PARTITION BY px ORDER BY py), r AS (PARTITION BY py ORDER BY px))
  SELECT py, px, CAST((a<>1)::INT + (b<>1)::INT + (c<>1)::INT + (d<>1)::INT - (a=b AND b<>1)::INT - (a=c AND c<>1)::INT - (a=d AND d<>1)::INT - (b=c AND c<>1)::INT - (b=d AND d<>1)::INT - (c=d AND d<>1)::INT AS INT) AS border FROM n WHERE v = 1""")
def border_length(spark, d):
    return raster.border_length(_pix(spark, d).withColumn("v", F.col("label") % 3), 1, "v")


def _density_sql() -> str:
    frame = {8: "RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING", 32: "RANGE BETWEEN 16 PRECEDING AND 15 FOLLOWING"}
    sums = ", ".join(f"sum({v}) OVER w{w} AS {v}{w}" for v in "nt" for w in frame)
    again = ", ".join(f"sum({v}{w}) OVER w{w} AS {v}{w}" for v in "nt" for w in frame)
    along = lambda a, b: ", ".join(f"w{w} AS (PARTITION BY {a} ORDER BY {b} {f})" for w, f in frame.items())
    share = lambda w: f"CASE WHEN t{w} / {w * w}.0::DOUBLE < 0.25 THEN -1.0::DOUBLE ELSE t{w} / {w * w}.0::DOUBLE END AS s{w}"
    return f"""WITH {ad.PIX}, p AS (SELECT py, px, CAST(label > 0 AS INT) AS n, CAST(least(r, g, b) <= 200 AND greatest(r, g, b) > 0 AS INT) AS t FROM pix),
  across AS (SELECT py, px, {sums} FROM p WINDOW {along("py", "px")}),
  boxes AS (SELECT py, px, {again} FROM across WINDOW {along("px", "py")}),
  shares AS (SELECT *, {share(8)}, {share(32)} FROM boxes),
  d AS (SELECT *, n8 / (s8 * 0.5e-6::DOUBLE * 64) AS l, n32 / (s32 * 0.5e-6::DOUBLE * 1024) AS r FROM shares)
  SELECT py, px, round(l, 3) + 0.0 AS local, round(r, 3) + 0.0 AS regional, round(s8, 6) AS tissue_share,
    round(CASE WHEN s8 < 0 OR r = 0 THEN 0 ELSE greatest(l / r, 0) END, 6) + 0.0 AS relative FROM d"""


@query(_density_sql())
def density_window(spark, d):
    p = _pix(spark, d)
    tissue = scalar.is_tissue(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("tissue")
    out = raster.density_windows(p.select("py", "px", (F.col("label") > 0).cast("int").alias("nucleus"), tissue), 8, 32)
    # a whole round needs + 0.0: minus zero and zero are one value
    places = {"local": 3, "regional": 3, "tissue_share": 6, "relative": 6}
    return out.select("py", "px", *[(F.round(c, k) + 0.0).alias(c) for c, k in places.items()])


@query(f"""WITH {ad.PIX}, e AS (SELECT max(py) + 1 AS h FROM pix), g AS (SELECT i, j FROM e, (SELECT DISTINCT py AS i FROM pix) a, range(60) b(j) WHERE i < h // 2)
  SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, label FROM g, e JOIN pix ON py = i * h // (h // 2) AND px = j * {W} // 60""")
def resize_nearest(spark, d):
    p = _pix(spark, d).select("py", "px", "label")
    h = p.agg(F.max("py")).first()[0] + 1
    return raster.resize_nearest(p, h, W, h // 2, 60).select("i", "j", "label")


@query(f"""WITH {ad.PIX}, e AS (SELECT max(py) + 1 AS h FROM pix), g AS (SELECT a.py AS i, b.px AS j, least(greatest((a.py + 0.5::DOUBLE) * h / (h * 2) - 0.5, 0), h - 1) AS y, least(greatest((b.px + 0.5::DOUBLE) * {W} / 200 - 0.5, 0), {W - 1}) AS x
    FROM e, (SELECT DISTINCT py FROM pix UNION SELECT py + (SELECT h FROM e) FROM pix) a, (SELECT range AS px FROM range(200)) b),
  n AS (SELECT i, j, CAST(floor(y) AS INT) + dy AS py, CAST(floor(x) AS INT) + dx AS px, (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w
    FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx))
  SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(w * g) / sum(w), 6) AS g FROM n JOIN pix USING (py, px) WHERE w > 0 GROUP BY 1, 2""")
def resize_bilinear(spark, d):
    p = _pix(spark, d).select("py", "px", "g")
    h = p.agg(F.max("py")).first()[0] + 1
    return raster.resize_bilinear(p, "g", h, W, 2 * h, 200).select("i", "j", F.round("g", 6).alias("g"))


@query(f"""WITH {ad.PIX}, e AS (SELECT max(py) + 1 AS h FROM pix), s AS (SELECT py * (h // 3) / CAST(h AS DOUBLE) AS y0, (py + 1) * (h // 3) / CAST(h AS DOUBLE) AS y1, px * 40 / {W}.0::DOUBLE AS x0, (px + 1) * 40 / {W}.0::DOUBLE AS x1, h // 3 AS n, g FROM pix, e),
  t AS (SELECT i, j, g, (least(y1, i + 1) - greatest(y0, i)) * (least(x1, j + 1) - greatest(x0, j)) AS w FROM s JOIN (SELECT DISTINCT py AS i FROM pix) a ON i < n AND i < y1 AND i + 1 > y0 JOIN range(40) b(j) ON j < x1 AND j + 1 > x0)
  SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(w * g) / sum(w), 4) AS g FROM t WHERE w > 1e-9 GROUP BY 1, 2""")
def resize_area(spark, d):
    p = _pix(spark, d).select("py", "px", "g")
    h = p.agg(F.max("py")).first()[0] + 1
    return raster.resize_area(p, "g", h, W, h // 3, 40).select("i", "j", F.round("g", 4).alias("g"))


@query(f"""WITH {ad.PIX} SELECT py, px, label FROM pix WHERE py // 25 < (SELECT max(py // 25) FROM pix) AND px // 25 < (SELECT max(px // 25) FROM pix)""")
def stitch(spark, d):
    p = _pix(spark, d)
    t = p.select(F.expr("int(py div 25)").alias("tile_row"), F.expr("int(px div 25)").alias("tile_col"), (F.col("py") % 25).alias("y"), (F.col("px") % 25).alias("x"), "label")
    return raster.stitch(t, 25, inclusive=False)


@query(f"""WITH {ad.PIX}, b AS (SELECT label, count(*) AS area, avg(py) AS cy, avg(px) AS cx, min(py) AS min_row, min(px) AS min_col, max(py) + 1 AS max_row, max(px) + 1 AS max_col,
    var_pop(py) + 1.0 / 12 AS myy, var_pop(px) + 1.0 / 12 AS mxx, covar_pop(px, py) AS mxy FROM pix WHERE label > 0 GROUP BY 1),
  x AS (SELECT *, sqrt((mxx - myy) ** 2 + 4 * mxy ** 2) AS s FROM b), y AS (SELECT *, (mxx + myy + s) / 2 AS l1, (mxx + myy - s) / 2 AS l2 FROM x)
  SELECT label, area, round(cy, 4) AS cy, round(cx, 4) AS cx, min_row, min_col, max_row, max_col, round(4 * sqrt(l1), 4) AS major_axis, round(4 * sqrt(greatest(l2, 0)), 4) AS minor_axis,
    round(sqrt(4 * area / pi()), 4) AS equivalent_diameter FROM y""")
def region_props(spark, d):
    r = raster.region_properties(_pix(spark, d).where("label > 0"))
    r = r.withColumns({c: F.round(c, 4) for c in ("cy", "cx", "major_axis", "minor_axis", "equivalent_diameter")})
    return r.drop("euler", "eccentricity")


@query(f"""WITH {ad.PIX}, fg AS (SELECT DISTINCT py, px FROM pix WHERE label > 0), ext AS (SELECT max(py) + 1 AS h, {W} AS w FROM pix),
  s AS (SELECT k, 2 ** (0.01 + 9.99 * k / 10) AS s FROM range(10) r(k)), n AS (SELECT s.*, CAST(ceil(w / s) AS INT) - 1 AS ny, CAST(ceil(h / s) AS INT) - 1 AS nx FROM s, ext),
  ok AS (SELECT * FROM n WHERE k < coalesce((SELECT min(k) FROM n WHERE ny <= 0 OR nx <= 0), 99)),
  c AS (SELECT s, count(DISTINCT (least(floor(py / s), ny - 1), least(floor(px / s), nx - 1))) AS boxes FROM ok, fg WHERE py <= ny * s AND px <= nx * s GROUP BY 1)
  SELECT round(-regr_slope(ln(boxes), ln(s)), 6) AS dimension FROM c""")
def fractal_dim(spark, d):
    p = _pix(spark, d)
    h = p.agg(F.max("py")).first()[0] + 1
    n = raster.box_counts(_fg(spark, d), h, W, raster.scales())
    return raster.box_dimension(n).select(F.round("dimension", 6).alias("dimension"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS s FROM part)
  SELECT id, y AS py, x AS px FROM p, range(0, 60) a(y), range(0, 60) b(x) WHERE y < s AND x < s AND y >= 0 AND x > 0
  AND x < s - y""")
def polygon_pixels(spark, d):
    p = table(spark, d, "part")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, s = F.lit(0.5), F.col("p_size")
    ring = F.array(corner(zero, F.lit(0)), corner(s, F.lit(0)), corner(zero, s - 0.5))
    return raster.polygon_pixels(p.select(F.col("p_partkey").alias("id"), ring.alias("ring"))).select("id", "py", "px")


@query(f"WITH {ad.PIX} SELECT round(sum(CAST(label > 0 AS INT) * CAST(g < 100 AS INT)) / sum(CAST(label > 0 AS INT)), 9) AS ratio FROM pix")
def mask_overlap(spark, d):
    p = _pix(spark, d)
    a, b = (F.col("label") > 0).cast("int"), (F.col("g") < 100).cast("int")
    return p.agg(F.round(tables.overlap_ratio(a, b), 9).alias("ratio"))


@query(f"WITH {ad.PIX}, c AS (SELECT label, median(r) AS m FROM pix WHERE label > 0 GROUP BY 1) SELECT CAST(trunc(median(m) / 255 * 100) AS INT) AS cellularity FROM c")
def cellularity_score(spark, d):
    c = _pix(spark, d).where("label > 0").groupBy("label").agg(F.median("r").alias("m"))
    return c.agg((F.median("m") / 255 * 100).cast("int").alias("cellularity"))


@query(f"WITH {ad.NUC}, {ad.PIX} SELECT image_id, nid, label FROM nuc LEFT JOIN pix ON py = CAST(trunc(y * 0.0125) AS INT) AND px = CAST(trunc(x * 0.0125) AS INT)")
def fragment_label(spark, d):
    n = ad.nuclei(spark, d)
    return tables.point_lookup(n, _pix(spark, d), 0.0125, "label").select("image_id", "nid", "label")


@query(f"WITH {ad.PIX}, m AS (SELECT label, CAST(label % 5 AS INT) AS cluster FROM (SELECT DISTINCT label FROM pix)) SELECT py, px, cluster FROM pix JOIN m USING (label)")
def rescale_mask(spark, d):
    p = _pix(spark, d)
    m = materialize(p.select("label").distinct().withColumn("cluster", F.col("label") % 5))
    return p.join(broadcast_if_small(m), "label").select("py", "px", "cluster")


@query(f"""WITH {ad.PIX} SELECT label, py, px FROM pix WHERE label IN (SELECT label FROM pix WHERE label > 0 GROUP BY 1 HAVING count(*) > 100) AND px > 10 AND px < 110""")
def aggregate_pixels(spark, d):
    p = _pix(spark, d)
    big = p.where("label > 0").groupBy("label").count().where("count > 100").select("label")
    return p.where("px > 10 AND px < 110").join(big, "label", "left_semi").select("label", "py", "px")


@query()
def otsu_fragments(spark, d):
    fg = raster.otsu_mask(_pix(spark, d), "g").where("NOT above").select("py", "px")
    c = materialize(raster.label_components(fg, raster.EIGHT))
    return c.groupBy("component").count().select("component.py", "component.px", "count")


@query(f"""WITH {ad.PIX} SELECT label, py, px FROM pix p WHERE label > 0 AND (SELECT count(*) FROM pix q WHERE q.label = p.label AND abs(q.py - p.py) + abs(q.px - p.px) = 1) < 4""")
def contour_pixels(spark, d):
    return stains.boundary(_pix(spark, d).where("label > 0"))


@query("""SELECT DISTINCT p_partkey AS id, CAST(trunc(p_size * (k / 199.0::DOUBLE)) AS INT) AS py, CAST(trunc(3 + (p_size % 20 - 3) * (k / 199.0::DOUBLE)) AS INT) AS px
  FROM part, range(200) r(k)""")
def line_pixels(spark, d):
    s = F.col("p_size")
    lines = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.lit(3).alias("x0"), F.lit(0).alias("y0"), (s % 20).alias("x1"), s.alias("y1")
    )
    return stains.line_pixels(lines, 200)


def _axis(k: int) -> str:
    l, m, s = (f"log10(greatest({' + '.join(f'{v} * {c}' for v, c in zip(row, 'rgb'))}, 1.0))" for row in stains._LMS)
    return [f"({l} + {m} + {s}) / sqrt(3)", f"({l} + {m} - 2 * {s}) / sqrt(6)", f"({l} - {m}) / sqrt(2)"][k]


@query(f"""WITH {ad.PIX}, a AS (SELECT *, {_axis(0)} AS l, {_axis(1)} AS a, {_axis(2)} AS o FROM pix), t AS (
  SELECT avg(l) AS ml, stddev_pop(l) AS sl, avg(a) AS ma, stddev_pop(a) AS sa, avg(o) AS mo, stddev_pop(o) AS so FROM a WHERE least(r, g, b) <= 200 AND greatest(r, g, b) > 0)
  SELECT py, px, round((l - ml) / sl * 0.4 + 3.5, 5) AS l, round((a - ma) / sa * 0.1 + 0.05, 5) AS a, round((o - mo) / so * 0.02 + 0.03, 5) AS o FROM a, t""")
def color_match(spark, d):
    out = stains.match_moments(_pix(spark, d), [3.5, 0.05, 0.03], [0.4, 0.1, 0.02])
    return out.select("py", "px", *[F.round(c, 5).alias(c) for c in "lao"])


@query()
def stain_basis(spark, d):
    return spark.createDataFrame([tuple(map(float, v)) for v in stains.stain_vectors(_pix(spark, d))], "r double, g double, b double")


@query()
def superpixels(spark, d):
    return stains.superpixels(_pix(spark, d), 15, rounds=3).select("py", "px", "spx")


@query(f"WITH {ad.NUC}, {ad.PIX} SELECT image_id, nid, label FROM nuc JOIN pix ON py = y // 80 AND px = x // 80 WHERE label > 0")
def nuclei_superpixel(spark, d):
    return tables.point_lookup(ad.nuclei(spark, d), _pix(spark, d), 0.0125, "label").where("label > 0").select("image_id", "nid", "label")


@query(f"""WITH {ad.PIX}, n AS (SELECT label % 4 AS cls, label, count(*) AS n FROM pix WHERE label > 0 GROUP BY 1, 2),
  c AS (SELECT cls, n, row_number() OVER (PARTITION BY cls ORDER BY n DESC) AS r FROM (SELECT DISTINCT cls, n FROM n))
  SELECT n.cls, label, n.n FROM n JOIN c ON c.cls = n.cls AND r = 2 WHERE n.n < c.n""")
def below_second_largest(spark, d):
    n = _pix(spark, d).where("label > 0").groupBy((F.col("label") % 4).alias("cls"), "label").agg(F.count("*").alias("n"))
    return stains.second_largest(n, "cls", "n")


@query(f"""WITH {ad.PIX}, b AS (SELECT label, avg(py) AS cy, avg(px) AS cx, 4 * sqrt((var_pop(py) + var_pop(px) + 2.0 / 12 + sqrt((var_pop(px) - var_pop(py)) ** 2 + 4 * covar_pop(px, py) ** 2)) / 2) AS m
  FROM pix WHERE label > 0 GROUP BY 1) SELECT label, round(avg(CASE WHEN (py - cy) ** 2 + (px - cx) ** 2 <= (m / 2) ** 2 THEN 1.0 ELSE 0.0 END), 6) AS fill FROM pix JOIN b USING (label) GROUP BY 1""")
def ellipse_fill(spark, d):
    p = _pix(spark, d).where("label > 0")
    return stains.ellipse_fill(p, raster.region_properties(p)).withColumn("fill", F.round("fill", 6))
