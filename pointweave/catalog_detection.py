"""Queries of nuclei detection, outlines and texture."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import contours, detection, raster, texture
from .sources import adapters as ad

QUERIES: dict = {}
#: The level of the green channel alone as the nuclear stain of the raster of discs.
GREEN = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _regions(spark, d):
    return ad.pixels(spark, d).where("label > 0").select("label", "py", "px")


_FG = f"WITH RECURSIVE {ad.PIX}, fg AS (SELECT label, py, px FROM pix WHERE label > 0)"
#: Squared ways of at most 12 pixels: no disc is deeper.
_NEAR = "(SELECT CAST(a.range AS INT) AS dy, CAST(b.range AS INT) AS dx FROM range(-12, 13) a, range(-12, 13) b) o"


@query(f"""{_FG}, e AS (SELECT min(py) AS y0, max(py) AS y1, min(px) AS x0, max(px) AS x1 FROM pix), whole AS (SELECT py, px, label FROM pix)
  SELECT fg.py, fg.px, min(dy * dy + dx * dx) AS d2 FROM fg CROSS JOIN {_NEAR} CROSS JOIN e LEFT JOIN whole w ON w.py = fg.py + dy AND w.px = fg.px + dx
  WHERE coalesce(w.label, 0) = 0 GROUP BY 1, 2""")
def distance_transform(spark, d):
    return detection.distance_transform(_regions(spark, d))


@query(f"""{_FG}, disk AS (SELECT dy, dx FROM {_NEAR} WHERE dy * dy + dx * dx <= 9), speck AS (SELECT py, px FROM pix WHERE label > 0 AND r > 0 AND (g * 7 + b) % 3 > 0)
  SELECT py + dy AS py, px + dx AS px FROM speck, disk WHERE (py + dy, px + dx) IN (SELECT (py, px) FROM pix) GROUP BY 1, 2 HAVING count(*) >= 15""")
def median_disk(spark, d):
    p = ad.pixels(spark, d)
    return detection.median_disk(p.where("label > 0 AND r > 0 AND (g * 7 + b) % 3 > 0").select("py", "px"), p)


@query(f"""WITH {ad.PIX}, h AS (SELECT label, g AS v, count(*) AS n FROM pix GROUP BY 1, 2), c AS (
    SELECT label, v, CAST(sum(n) OVER u AS DOUBLE) AS w1, CAST(sum(n * v) OVER u AS DOUBLE) AS s1, CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) AS w, CAST(sum(n * v) OVER (PARTITION BY label) AS DOUBLE) AS s
    FROM h WINDOW u AS (PARTITION BY label ORDER BY v ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT label, v, w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) * (s1 / w1 - (s - s1) / (w - w1)) AS score FROM c WHERE w > w1)
  SELECT label, first(v ORDER BY score DESC, v) AS threshold FROM f GROUP BY 1""")
def object_otsu(spark, d):
    return detection.grouped_otsu(ad.pixels(spark, d).select("label", "g"), "label", "g")


@query(f"""{_FG}, four AS (SELECT dy, dx FROM {_NEAR} WHERE dy * dy + dx * dx = 1), border AS (SELECT * FROM fg WHERE (
    SELECT count(*) FROM four, fg f WHERE f.label = fg.label AND f.py = fg.py + dy AND f.px = fg.px + dx) < 4),
  n AS (SELECT b.label, b.py, b.px, count(*) FILTER (WHERE abs(b.py - c.py) + abs(b.px - c.px) = 1) AS a, count(*) FILTER (WHERE abs(b.py - c.py) + abs(b.px - c.px) = 2) AS d
    FROM border b JOIN border c ON b.label = c.label AND abs(b.py - c.py) <= 1 AND abs(b.px - c.px) <= 1 GROUP BY 1, 2, 3)
  SELECT label, round(sum(CASE 1 + 2 * a + 10 * d WHEN 5 THEN 1 WHEN 7 THEN 1 WHEN 15 THEN 1 WHEN 17 THEN 1 WHEN 25 THEN 1 WHEN 27 THEN 1 WHEN 21 THEN sqrt(2) WHEN 33 THEN sqrt(2)
    WHEN 13 THEN (1 + sqrt(2)) / 2 WHEN 23 THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM n GROUP BY 1""")
def region_perimeter(spark, d):
    return detection.perimeters(_regions(spark, d)).select("label", F.round("perimeter", 6).alias("perimeter"))


#: Holes are cut into the discs where the colours say so.
_HOLED = "pix WHERE label > 0 AND (b < 40 OR b % 5 > 0)"
_RINGS = f"""WITH RECURSIVE {ad.PIX}, fg AS (SELECT label, py, px FROM {_HOLED}), way(dir, sy, sx, ey, ex, oy, ox) AS (VALUES (0, 0, 0, 0, 1, -1, 0), (1, 0, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1, 0), (3, 1, 0, 0, 0, 0, -1)),
  side AS MATERIALIZED (SELECT f.label, f.py, f.px, dir, f.py + sy AS sy, f.px + sx AS sx, f.py + ey AS ey, f.px + ex AS ex, ((CAST(f.py AS BIGINT) + 536870912) * 1073741824 + f.px + 536870912) * 4 + dir AS side
    FROM fg f CROSS JOIN way WHERE NOT EXISTS (SELECT 1 FROM fg g WHERE g.label = f.label AND g.py = f.py + oy AND g.px = f.px + ox)),
  link AS MATERIALIZED (SELECT a.label, a.side, a.dir, a.ey, a.ex, arg_min(b.side, CASE WHEN (a.py, a.px) = (b.py, b.px) THEN 0 ELSE 1 END) AS nxt, arg_min(b.dir, CASE WHEN (a.py, a.px) = (b.py, b.px) THEN 0 ELSE 1 END) AS to_dir
    FROM side a JOIN side b ON a.label = b.label AND a.ey = b.sy AND a.ex = b.sx GROUP BY ALL),
  walk(start, cur, n) AS (SELECT side, side, 0 FROM link UNION ALL SELECT start, nxt, n + 1 FROM walk JOIN link ON side = cur WHERE nxt <> start),
  ring AS (SELECT start, min(cur) AS ring FROM walk GROUP BY 1),
  corner AS (SELECT l.label, w.start AS ring, row_number() OVER (PARTITION BY w.start ORDER BY n) - 1 AS place, l.ey AS y, l.ex AS x
    FROM walk w JOIN ring r ON r.start = w.start AND r.ring = w.start JOIN link l ON l.side = w.cur WHERE l.dir <> l.to_dir)"""


def _holed(spark, d):
    return ad.pixels(spark, d).where("label > 0 AND (b < 40 OR b % 5 > 0)").select("label", "py", "px")


@query(f"{_RINGS} SELECT label, ring, place, y, x FROM corner")
def contour_points(spark, d):
    return contours.contour_points(_holed(spark, d))


@query(f"""{_RINGS}, pair AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM corner WINDOW w AS (PARTITION BY ring ORDER BY place)),
  one AS (SELECT label, ring, count(*) AS n_points, sum(x * y2 - x2 * y) AS twice FROM pair GROUP BY 1, 2 HAVING count(*) > 4), cut AS (SELECT n_points FROM (SELECT DISTINCT n_points FROM one) ORDER BY 1 DESC LIMIT 1 OFFSET 1)
  SELECT label, ring, n_points, twice < 0 AS hole, abs(twice) / 2.0 AS area FROM one WHERE n_points < coalesce((SELECT n_points FROM cut), 1000000000)""")
def outline_rings(spark, d):
    rings = contours.below_largest(contours.contour_rings(_holed(spark, d)))
    return rings.select("label", "ring", F.size("points").alias("n_points"), "hole", "area")


_PLOG = "-sum(CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END)"


@query(f"""WITH {ad.PIX}, q AS (SELECT label, py, px, g * 16 // 256 AS v FROM pix), o(dy, dx) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1)), n AS (
    SELECT a.label, a.v AS a, b.v AS b FROM q a JOIN o ON TRUE JOIN q b ON b.label = a.label AND b.py = a.py + dy AND b.px = a.px + dx),
  t AS (SELECT label, a AS i, b AS j FROM n UNION ALL SELECT label, b, a FROM n), p AS (SELECT label, i, j, count(*) / sum(count(*)) OVER (PARTITION BY label) AS p FROM t GROUP BY 1, 2, 3),
  m AS (SELECT label, i AS k, sum(p) AS m FROM p GROUP BY 1, 2), mm AS (SELECT label, sum(k * m) AS mu, sum(k * k * m) AS sq, {_PLOG.format("m")} AS hx FROM m GROUP BY 1),
  s AS (SELECT label, sum(k * m) AS sa, sum(k * k * m) AS ss, {_PLOG.format("m")} AS se FROM (SELECT label, i + j AS k, sum(p) AS m FROM p GROUP BY 1, 2) GROUP BY 1),
  d AS (SELECT label, sum(k * m) AS da, sum(k * k * m) AS ds, {_PLOG.format("m")} AS de FROM (SELECT label, abs(i - j) AS k, sum(p) AS m FROM p GROUP BY 1, 2) GROUP BY 1),
  w AS (SELECT p.label, sum(p * p) AS asm, sum(p / (1 + (i - j) * (i - j))) AS idm, sum(i * j * p) AS ij, {_PLOG.format("p")} AS e, -sum(p * log2(x.m * y.m)) AS hxy1 FROM p JOIN m x ON x.label = p.label AND x.k = i JOIN m y ON y.label = p.label AND y.k = j GROUP BY 1)
  SELECT label, round(asm, 6) AS asm, round(ds, 6) AS contrast, round(CASE WHEN abs(sq - mu * mu) < 1e-12 THEN 0 ELSE (ij - mu * mu) / (sq - mu * mu) END, 6) AS correlation, round(sq - mu * mu, 6) AS sum_of_squares, round(idm, 6) AS idm,
    round(sa, 6) AS sum_average, round(ss - sa * sa, 6) AS sum_variance, round(se, 6) AS sum_entropy, round(e, 6) AS entropy, round(ds - da * da, 6) AS difference_variance, round(de, 6) AS difference_entropy,
    round(CASE WHEN hx < 1e-12 THEN 0 ELSE (e - hxy1) / hx END, 6) AS imc1, round(sqrt(greatest(1 - exp(-2 * (2 * hx - e)), 0)), 6) AS imc2
  FROM w JOIN mm USING (label) JOIN s USING (label) JOIN d USING (label)""")
def superpixel_haralick(spark, d):
    out = texture.haralick(ad.pixels(spark, d), "label", "g")
    return out.select("label", *[F.round(c, 6).alias(c) for c in texture.NAMES])


@query(f"""WITH {ad.PIX}, g AS (SELECT label, (lead(g, 1, g) OVER c - lag(g, 1, g) OVER c) / CAST(lead(py, 1, py) OVER c - lag(py, 1, py) OVER c AS DOUBLE) AS y,
    (lead(g, 1, g) OVER r - lag(g, 1, g) OVER r) / CAST(lead(px, 1, px) OVER r - lag(px, 1, px) OVER r AS DOUBLE) AS x FROM pix WINDOW c AS (PARTITION BY px ORDER BY py), r AS (PARTITION BY py ORDER BY px)),
  s AS (SELECT label, sqrt(coalesce(y, 0) * coalesce(y, 0) + coalesce(x, 0) * coalesce(x, 0)) AS s FROM g)
  SELECT label, round(avg(s), 6) AS gradient_mean, round(stddev_samp(s), 6) AS gradient_std, round(max(s), 6) AS gradient_max FROM s GROUP BY 1""")
def superpixel_gradient(spark, d):
    g = texture.gradient(ad.pixels(spark, d), "g").groupBy("label")
    return g.agg(*[F.round(f("gradient"), 6).alias(f"gradient_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))])


def _smooth(spark, d):
    """The raster of discs with the mean of green over 5 x 5 pixels, so that levels change slowly as a stain does."""
    p = raster.box_sum(raster.box_sum(ad.pixels(spark, d).withColumn("one", F.lit(1)), "g", 5), "one", 5)
    return p.select("py", "px", "label", "r", F.expr("int(g_5 div one_5)").alias("g"), "b")


@query()
def local_foreground(spark, d):
    return detection.local_foreground(detection.stain_level(_smooth(spark, d), GREEN))


@query()
def watershed_regions(spark, d):
    level = detection.stain_level(_smooth(spark, d), GREEN)
    fg = _regions(spark, d).select("py", "px")
    grown = detection.watershed(level.join(fg.hint("merge"), ["py", "px"], "left_semi"), detection.nucleus_markers(fg, level))
    return grown.groupBy("label").agg(F.count("*").alias("n"), F.min("py").alias("min_row"), F.min("px").alias("min_col"))


@query()
def detect_nuclei(spark, d):
    found = detection.detect_nuclei(_smooth(spark, d), GREEN)
    shape = raster.region_properties(found).join(detection.perimeters(found), "label")
    return shape.select("label", "area", "cy", "cx", "major_axis", "minor_axis", "eccentricity", "euler", "perimeter")
