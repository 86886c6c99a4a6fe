"""Queries on cohort features, job logs and model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .operators import cohort, ml, tables
from .sources import adapters as ad
from .sources.storage import closed_ring, geojson_feature, materialize, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


FEATURES = ["axis_ratio", "nuclei_fill", "nuclei_density", "mean_nucleus_area", "nuclei_per_axis"]
RATIOS = """f AS (SELECT *, CAST(major_axis AS DOUBLE) / minor_axis AS axis_ratio, CAST(nuclei_area AS DOUBLE) / convex_area AS nuclei_fill,
  CAST(num_nuclei AS DOUBLE) / convex_area AS nuclei_density, CAST(nuclei_area AS DOUBLE) / num_nuclei AS mean_nucleus_area,
  CAST(num_nuclei AS DOUBLE) / major_axis AS nuclei_per_axis FROM cohort)"""
ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in FEATURES)


def _features(spark, d):
    return cohort.scene_features(ad.cohort(spark, d))


def _rounded(df, columns=FEATURES, n=8):
    return df.withColumns({c: F.round(c, n) for c in columns})


@query(f"WITH {ad.COHORT}, {RATIOS} SELECT scene_id, aggregate_id, {ROUNDED} FROM f")
def wsi_features(spark, d):
    return _rounded(_features(spark, d)).select("scene_id", "aggregate_id", *FEATURES)


@query(f"""WITH {ad.COHORT}, s AS (SELECT scene_id, dtfe_threshold, count(*) AS num_aggregates, max(num_nuclei) AS most FROM cohort WHERE scene_id % 2 = 0 GROUP BY 1, 2)
  SELECT c.scene_id, c.dtfe_threshold, aggregate_id, num_nuclei, project, coalesce(num_aggregates, 0) AS num_aggregates, coalesce(most, 0) AS most
  FROM cohort c LEFT JOIN s ON s.scene_id = c.scene_id AND s.dtfe_threshold = c.dtfe_threshold WHERE project IN ('BUILDING', 'MACHINERY')""")
def wsi_union(spark, d):
    c = ad.cohort(spark, d)
    s = c.where("scene_id % 2 = 0").groupBy("scene_id", "dtfe_threshold").agg(F.count("*").alias("num_aggregates"), F.max("num_nuclei").alias("most"))
    parts = {p: c.where(F.col("project") == p).select("scene_id", "dtfe_threshold", "aggregate_id", "num_nuclei") for p in ("BUILDING", "MACHINERY")}
    return cohort.scene_union(parts, s, ["scene_id", "dtfe_threshold"])


MAXED = ", ".join(f"round(max({c}), 8) AS {c}" for c in FEATURES)


@query(f"WITH {ad.COHORT}, {RATIOS} SELECT y, scene_id, dtfe_threshold, edge_range, min_nuclei, {MAXED} FROM f GROUP BY ALL")
def group_max(spark, d):
    return _rounded(cohort.group_max(_features(spark, d), ["y", "scene_id", *cohort.PARAMETERS], FEATURES))


@query(f"WITH {ad.COHORT} SELECT scene_id, aggregate_id FROM cohort WHERE dtfe_threshold = 0.0284 AND edge_range = 50 AND min_nuclei = 30")
def param_slice(spark, d):
    return cohort.parameter_slice(ad.cohort(spark, d), 0.0284, 50, 30).select("scene_id", "aggregate_id")


@query(f"WITH {ad.COHORT} SELECT DISTINCT dtfe_threshold, edge_range, min_nuclei FROM cohort")
def distinct_params(spark, d):
    return ad.cohort(spark, d).select(*cohort.PARAMETERS).distinct()


@query("SELECT t, e, n, s_suppkey FROM (VALUES (0.01::DOUBLE), (0.02::DOUBLE)) a(t), (VALUES (50)) b(e), (VALUES (10), (30)) c(n), supplier")
def param_grid(spark, d):
    grid = F.broadcast(spark.createDataFrame([(t, 50, n) for t in (0.01, 0.02) for n in (10, 30)], "t double, e int, n int"))
    return table(spark, d, "supplier").select("s_suppkey").crossJoin(grid)


@query(f"WITH {ad.COHORT}, {RATIOS} SELECT project, " + ", ".join(
    f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}, round(max({c}) - min({c}), 6) AS range_{c}, round(skewness({c}), 6) AS skew_{c}, round(kurtosis({c}), 6) AS kurt_{c}"
    for c in ("axis_ratio", "nuclei_fill")) + ", count(*) AS count FROM f GROUP BY 1")
def superpixel_moments(spark, d):
    m = tables.moments(_features(spark, d), ["project"], ["axis_ratio", "nuclei_fill"])
    return _rounded(m, [c for c in m.columns if c not in ("project", "count")], 6)


@query(f"WITH {ad.COHORT} SELECT project, round(count(*) / (0.5 * 3.0 + 1e-8), 6) AS density FROM cohort GROUP BY 1")
def superpixel_density(spark, d):
    return ad.cohort(spark, d).groupBy("project").agg(F.round(F.count("*") / (0.5 * 3.0 + 1e-8), 6).alias("density"))


@query(f"""WITH {ad.COHORT}, g AS (SELECT aggregate_id, CASE WHEN aggregate_id % 5 <> 0 THEN major_axis END AS m FROM cohort)
  SELECT aggregate_id, round(coalesce(m, avg(m) OVER ()), 6) AS m FROM g""")
def impute_mean(spark, d):
    g = ad.cohort(spark, d).select("aggregate_id", F.when(F.col("aggregate_id") % 5 != 0, F.col("major_axis").cast("double")).alias("m"))
    return _rounded(tables.impute_mean(g, ["m"]), ["m"], 6)


@query(f"WITH {ad.COHORT}, {RATIOS} " + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS target, round(corr({a}, {b}), 6) AS r FROM f" for a in FEATURES[:2] for b in ("num_nuclei", "y")))
def feature_corr(spark, d):
    return _rounded(tables.correlations(_features(spark, d), FEATURES[:2], ["num_nuclei", "y"]), ["r"], 6)


@query("SELECT event_type AS job_type, round(median(value), 6) AS median_minutes, round(stddev_samp(value), 6) AS std_minutes FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def job_stats(spark, d):
    j = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "error")).select(F.col("event_type").alias("job_type"), F.col("value").alias("minutes"))
    return _rounded(cohort.job_statistics(j), ["median_minutes", "std_minutes"], 6)


@query("""SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN (user_id * 10 + 5) / 1e6 WHEN 1 THEN (user_id * 10 + 5) / 1e3 END, 9) AS gb,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events""")
def job_log_parse(spark, d):
    e = table(spark, d, "events")
    text = F.concat((F.col("user_id") * 10 + 5).cast("string"), F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("G")), (F.col("event_id") % 3 + 1).cast("int")))
    return e.select("event_id", F.round(scalar.memory_gb(text), 9).alias("gb"), F.from_json("props", "k long")["k"].alias("k"))


PRED = """pred AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS y, CAST((o_orderkey * 7 + o_custkey) % 4 AS INT) AS pred FROM orders)"""


def _pred(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("y"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 4).cast("int").alias("pred")
    )


@query(f"WITH {PRED} SELECT y, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 9) AS share FROM pred GROUP BY 1, 2")
def confusion(spark, d):
    return _rounded(cohort.confusion(_pred(spark, d)), ["share"], 9)


@query(f"WITH {PRED} SELECT y, round(avg(CASE WHEN abs(y - pred) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS share FROM pred GROUP BY 1")
def confusion_tolerant(spark, d):
    return _rounded(cohort.within(_pred(spark, d), 1), ["share"], 9)


@query("""WITH s AS (SELECT CAST(o_orderkey % 3 = 0 AS INT) AS y, (o_custkey % 97 + (o_orderkey % 3 = 0)::INT * 20) AS score FROM orders),
  g AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM s GROUP BY 1), r AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0) AS w FROM g)
  SELECT round(CAST(sum(w) AS DOUBLE) / CAST(sum(p) * sum(q) AS DOUBLE), 9) AS auc FROM r""")
def roc_auc(spark, d):
    y = (F.col("o_orderkey") % 3 == 0).cast("int")
    s = table(spark, d, "orders").select(y.alias("y"), (F.col("o_custkey") % 97 + y * 20).alias("score"))
    return _rounded(cohort.roc_auc(s), ["auc"], 9)


@query(f"""WITH {PRED}, t AS (SELECT sum((y = 1 AND pred = 1)::INT)::DOUBLE AS a, sum((y <> 1 AND pred = 1)::INT)::DOUBLE AS b, sum((y = 1 AND pred <> 1)::INT)::DOUBLE AS c, sum((y <> 1 AND pred <> 1)::INT)::DOUBLE AS e FROM pred)
  SELECT round((a + e) / (a + b + c + e), 9) AS accuracy, round(2 * a / (2 * a + b + c), 9) AS f1,
    round((a*(a-1) + b*(b-1) + c*(c-1) + e*(e-1)) / sqrt(((a+c)*(a+c-1) + (b+e)*(b+e-1)) * ((a+b)*(a+b-1) + (c+e)*(c+e-1))), 9) AS fm FROM t""")
def f1_fm(spark, d):
    p = _pred(spark, d)
    return _rounded(cohort.scores(p.select((F.col("y") == 1).cast("int").alias("y"), (F.col("pred") == 1).cast("int").alias("pred"))), ["accuracy", "f1", "fm"], 9)


@query("""SELECT o_orderkey AS id, round(1.0 - p0, 9) AS class_0, round(p0 - p1, 9) AS class_1, round(p1, 9) AS class_2
  FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS p0, (o_custkey % 80) / 100.0 AS p1 FROM orders)""")
def ordinal_proba(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100 / 100.0).alias("p0"), (F.col("o_custkey") % 80 / 100.0).alias("p1"))
    return _rounded(cohort.ordinal_probabilities(p, 3), ["class_0", "class_1", "class_2"], 9).select("id", "class_0", "class_1", "class_2")


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS y FROM orders), n AS (SELECT y, count(*) AS n FROM x GROUP BY 1), t AS (SELECT y, greatest((SELECT max(n) FROM n) // n, 1) AS t FROM n)
  SELECT o_orderkey, y, CAST(unnest(range(1, t + 1)) AS INT) AS copy FROM x JOIN t USING (y)""")
def oversample(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0).alias("y"))
    return cohort.oversample(x, "y")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders")
def label_binarize(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus AS y, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
  SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY h, o_orderkey) - 1) % 5 AS INT) AS fold FROM x""")
def kfold(spark, d):
    return cohort.stratified_folds(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y")), "y", "o_orderkey", 5)


KNN = """e AS (SELECT vec_id, label, [CAST(round(x * 1000) AS BIGINT) for x in embedding] AS v FROM embeddings), p AS (
  SELECT q.vec_id AS q_id, b.vec_id AS b_id, b.label, list_sum([(q.v[i] - b.v[i]) * (q.v[i] - b.v[i]) for i in range(1, 65)]) AS d2
  FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, b_id) AS k FROM p)"""


@query(f"WITH {KNN}, v AS (SELECT q_id, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1, 2) SELECT q_id, CAST(min(label) AS INT) AS pred FROM v WHERE (q_id, n) IN (SELECT (q_id, max(n)) FROM v GROUP BY q_id) GROUP BY 1")
def knn_predict(spark, d):
    from .operators.spatial import knn

    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    e = materialize(table(spark, d, "embeddings").select("vec_id", "label", v.alias("v")))
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"))
    b = e.select(F.col("vec_id").alias("b_id"), "label", "v")
    votes = knn(q, b, 5).groupBy("q_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("q_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"))


@query(f"WITH {ad.COHORT} SELECT project, min(min_nuclei) AS min_nuclei, max(n) AS n FROM (SELECT project, min_nuclei, count(*) AS n FROM cohort GROUP BY 1, 2) WHERE (project, n) IN (SELECT (project, max(n)) FROM (SELECT project, min_nuclei, count(*) AS n FROM cohort GROUP BY 1, 2) GROUP BY project) GROUP BY project")
def largest_cluster(spark, d):
    return tables.largest_group(ad.cohort(spark, d), "project", "min_nuclei")


@query("SELECT c_custkey, c_name, o_orderkey AS first_order, o_orderstatus AS status FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1")
def clean_records(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), F.col("o_orderstatus").alias("status"))
    return tables.first_match(c, o, "c_custkey", "first_order")


@query("""WITH i AS (SELECT 'S' || c_nationkey || '-' || c_custkey % 10 AS id, c_custkey FROM customer), k AS (
  SELECT DISTINCT 'S' || c_nationkey || '-0' || c_custkey % 10 || CASE WHEN c_custkey % 4 = 1 THEN 'V0' ELSE '' END AS known_id FROM customer WHERE c_custkey % 3 = 0)
  SELECT c_custkey, id, coalesce(a.known_id, b.known_id) AS known_id FROM i LEFT JOIN k a ON a.known_id = replace(id, '-', '-0') LEFT JOIN k b ON b.known_id = replace(id, '-', '-0') || 'V0'""")
def match_ids(spark, d):
    c = table(spark, d, "customer")
    named = lambda dash: F.concat(F.lit("S"), "c_nationkey", F.lit(dash), F.col("c_custkey") % 10)
    ids = c.select("c_custkey", named("-").alias("id"))
    known = c.where("c_custkey % 3 = 0").select(F.concat(named("-0"), F.when(F.col("c_custkey") % 4 == 1, "V0").otherwise("")).alias("known_id"))
    return ids.join(tables.match_ids(ids.select("id").distinct(), known), "id")


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 5000 AS DOUBLE) / 60 END AS minutes,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey / 8.0::DOUBLE END AS score, regexp_replace('00' || o_orderkey, '^0', '') AS code, 'a' || o_orderkey || 'b' AS line,
  round(o_orderkey % 900 / (0.25::DOUBLE * 0.5) * (5.0::DOUBLE / 20) ** 2, 6) AS low_area, round(o_orderkey % 900 * (0.25::DOUBLE * 0.5), 6) AS um2, round(o_orderkey % 900 * sqrt((0.0625::DOUBLE + 0.25) / 2), 6) AS um,
  round(o_orderkey % 900 / 0.25::DOUBLE, 6) AS px, least(greatest(o_orderkey % 900, 100.0::DOUBLE), 500) AS clipped,
  format('rgb({},{},{})', CAST(trunc(least(o_orderkey % 900 / 512.0::DOUBLE, 1) * 250) AS INT), CAST(trunc(20 + least(o_orderkey % 900 / 512.0::DOUBLE, 1) * 80) AS INT), CAST(trunc(255 - least(o_orderkey % 900 / 512.0::DOUBLE, 1) * 255) AS INT)) AS color
  FROM orders""")
def field_formulas(spark, d):
    k = F.col("o_orderkey")
    v = (k % 900).cast("double")
    return table(spark, d, "orders").select(
        "o_orderkey",
        scalar.minutes(F.when(k % 7 == 0, "na").otherwise((k % 5000).cast("string"))).alias("minutes"),
        scalar.number_or_null(F.when(k % 5 == 0, "na").otherwise((k / 8.0).cast("string"))).alias("score"),
        scalar.strip_zero(F.concat(F.lit("00"), k)).alias("code"),
        scalar.one_line(F.concat(F.lit("a\r\n"), k, F.lit("\nb"))).alias("line"),
        F.round(scalar.um2_to_px_area(v, 0.25, 0.5, 5 / 20), 6).alias("low_area"),
        F.round(scalar.px_area_to_um2(v, 0.25, 0.5), 6).alias("um2"),
        F.round(scalar.px_to_um(v, 0.25, 0.5), 6).alias("um"),
        F.round(scalar.um_to_px(v, 0.25), 6).alias("px"),
        scalar.clip(v, 100.0, 500.0).alias("clipped"),
        scalar.ramp_color(v / 512.0, (0, 20, 255), (250, 100, 0)).alias("color"),
    )


@query("SELECT c_custkey, r_name AS donor FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def donor_map(spark, d):
    r = F.broadcast(table(spark, d, "region").where("r_name <> 'ASIA'").select("r_regionkey", F.col("r_name").alias("donor")))
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "donor")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "donor")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 END AS grade FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def inflam_map(spark, d):
    grades = F.create_map(*[F.lit(x) for kv in {"BUILDING": 0, "MACHINERY": 1, "HOUSEHOLD": 2}.items() for x in kv])
    return table(spark, d, "customer").select("c_custkey", F.try_element_at(grades, F.col("c_mktsegment")).alias("grade")).where("grade IS NOT NULL")


@query("SELECT o_orderkey, s_name FROM orders JOIN supplier ON s_suppkey = o_custkey % 50")
def knee_records(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return table(spark, d, "orders").join(s, F.col("o_custkey") % 50 == F.col("s_suppkey")).select("o_orderkey", "s_name")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 5 = 0)
  SELECT 'left' AS side, id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', id FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def id_set_ops(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return cohort.id_sets(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 5 = 0"), "id")


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def tile_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1")
def patient_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@query(f"WITH {ad.NUC} SELECT image_id, nid FROM nuc WHERE (image_id, nid) NOT IN (SELECT (image_id, nid) FROM nuc WHERE eccentricity < 0.8 AND solidity > 0.9 AND area < 50)")
def nuclei_removed(spark, d):
    n = ad.nuclei(spark, d).select("image_id", "nid", "eccentricity", "solidity", "area")
    return n.select("image_id", "nid").join(tables.shape_filter(n).select("image_id", "nid"), ["image_id", "nid"], "left_anti")


@query("""WITH i AS (SELECT 'f' || (o_orderkey % 12) AS feature, CAST(o_custkey % 1000 AS DOUBLE) / 1000 AS importance FROM orders)
  SELECT feature, round(avg(importance), 9) AS importance FROM i GROUP BY 1 ORDER BY avg(importance) DESC, feature LIMIT 5""")
def importance_topk(spark, d):
    i = table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 12).alias("feature"), (F.col("o_custkey") % 1000 / 1000.0).alias("importance"))
    return _rounded(cohort.top_features(i, 5), ["importance"], 9)


@query("""SELECT p_partkey, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],[' || p_size || '.0,0.0],[' || p_size || '.0,10.0],[0.0,0.0]]]},"properties":{"size":' || p_size || '}}' AS feature,
  0.0::DOUBLE AS min_x, CAST(p_size AS DOUBLE) AS max_x FROM part""")
def geojson_bbox(spark, d):
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s = F.col("p_size")
    p = table(spark, d, "part").withColumn("ring", F.array(at(F.lit(0), F.lit(0)), at(s, F.lit(0)), at(s, F.lit(10))))
    x = F.transform(closed_ring(F.col("ring")), lambda q: q["x"])
    return p.select("p_partkey", geojson_feature(F.col("ring"), size=s).alias("feature"), F.array_min(x).alias("min_x"), F.array_max(x).alias("max_x"))


@query("""WITH c AS (SELECT CAST(p_size % 10 AS DOUBLE) / 10 AS x, max(p_retailprice) AS v FROM part GROUP BY 1), g AS (SELECT k / 100.0::DOUBLE AS g FROM range(101) r(k)),
  b AS (SELECT g, (SELECT max(x) FROM c WHERE x <= g) AS x0, (SELECT min(x) FROM c WHERE x >= g) AS x1 FROM g)
  SELECT g, round(CASE WHEN x0 = x1 THEN a.v WHEN e.v IS NULL THEN a.v ELSE a.v + (e.v - a.v) * ((g - x0) / (x1 - x0)) END, 6) AS value FROM b LEFT JOIN c a ON a.x = x0 LEFT JOIN c e ON e.x = x1""")
def curve_interpolation(spark, d):
    c = table(spark, d, "part").groupBy((F.col("p_size") % 10 / 10.0).alias("x")).agg(F.max("p_retailprice").alias("v"))
    return _rounded(cohort.interpolate(c, "x", "v"), ["value"], 6)


@query("""SELECT p_partkey, r, g, b, CAST(trunc(CASE WHEN h < 0 THEN h + 1 ELSE h END * 255) AS INT) AS h, CAST(trunc(CASE WHEN t > 0 THEN CAST(t - l AS DOUBLE) * 255 / t ELSE 0 END) AS INT) AS s, CAST(t AS INT) AS v FROM (
  SELECT *, CASE WHEN t = l THEN 0 WHEN r = t THEN CAST(g - b AS DOUBLE) / (t - l) WHEN g = t THEN 2 + CAST(b - r AS DOUBLE) / (t - l) ELSE 4 + CAST(r - g AS DOUBLE) / (t - l) END / 6.0::DOUBLE AS h FROM (
  SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part)))""")
def rgb_to_hsv(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", (k * 7 % 256).alias("r"), (k * 13 % 256).alias("g"), (k * 29 % 256).alias("b"))
    h, s, v = scalar.hsv(F.col("r"), F.col("g"), F.col("b"))
    return p.select("*", h.alias("h"), s.alias("s"), v.alias("v"))


@query("""SELECT e.label AS exper, e.n AS num_spx, b.total AS border_sums FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) e JOIN (SELECT CAST(p_size % 12 AS INT) AS label, sum(p_size) AS total FROM part GROUP BY 1) b ON e.label = b.label""")
def experiment_summary(spark, d):
    e = table(spark, d, "embeddings").groupBy(F.col("label").alias("exper")).agg(F.count("*").alias("num_spx"))
    b = table(spark, d, "part").groupBy((F.col("p_size") % 12).alias("exper")).agg(F.sum("p_size").alias("border_sums"))
    return e.join(b, "exper")


def _embedded(spark, d):
    return ml.vectors(table(spark, d, "embeddings").withColumn("y", F.col("label").cast("double")), array="embedding")


@query()
def pca(spark, d):
    out, _ = ml.principal_components(ml.standardized(_embedded(spark, d)), 3)
    return out.select("vec_id", "pca")


@query()
def gmm(spark, d):
    reduced, _ = ml.principal_components(ml.standardized(_embedded(spark, d)), 3)
    out, _ = ml.gaussian_mixture(reduced.drop("features").withColumn("features", ml.array_to_vector("pca")), 5)
    return out.select("vec_id", "cluster")


@query()
def gmm_threshold(spark, d):
    return ml.mixture_threshold(ad.cohort(spark, d), "nuclei_area", 1.0, use_variance=False)


COLUMNS = ["num_nuclei", "nuclei_area", "convex_area", "major_axis", "minor_axis"]


@query()
def rf(spark, d):
    train, test = ml.hash_split(ad.cohort(spark, d), "aggregate_id")
    model = ml.random_forest(ml.vectors(train, COLUMNS), "y")
    return model.transform(ml.vectors(test, COLUMNS)).select("aggregate_id", "y", F.col("prediction").cast("int").alias("pred"))


@query()
def logistic(spark, d):
    train, test = ml.hash_split(_embedded(spark, d), "vec_id")
    return ml.logistic(train, "y").transform(test).select("vec_id", "y", F.col("prediction").cast("int").alias("pred"))


@query()
def permutation_importance(spark, d):
    train, test = ml.hash_split(ad.cohort(spark, d), "aggregate_id")
    model = ml.random_forest(ml.vectors(train, COLUMNS), "y")
    return ml.permutation_importance(model, test.select("aggregate_id", *COLUMNS, "y"), COLUMNS, "y")


@query()
def lda(spark, d):
    train, test = ml.hash_split(ad.cohort(spark, d), "aggregate_id")
    return ml.discriminant(train, COLUMNS, "y")(test).select("aggregate_id", "y", "pred")


@query()
def ordinal_models(spark, d):
    data = ad.cohort(spark, d).withColumn("grade", (F.col("num_nuclei") / 75).cast("int"))
    train, test = ml.hash_split(data, "aggregate_id")
    scored = ml.ordinal_models(train, COLUMNS[1:], "grade", 3)(test)
    return cohort.ordinal_probabilities(scored, 3).select("aggregate_id", "grade", "class_0", "class_1", "class_2")
