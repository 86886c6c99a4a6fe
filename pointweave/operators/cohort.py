"""Cohort features and the metrics of classifiers on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import broadcast_if_small, materialize

PARAMETERS = ["dtfe_threshold", "edge_range", "min_nuclei"]


def scene_features(rows: DataFrame) -> DataFrame:
    """Aggregate rows with derived ratios; a quotient by zero is missing."""
    q = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return rows.withColumns(
        {
            "axis_ratio": q("major_axis", "minor_axis"),
            "nuclei_fill": q("nuclei_area", "convex_area"),
            "nuclei_density": q("num_nuclei", "convex_area"),
            "mean_nucleus_area": q("nuclei_area", "num_nuclei"),
            "nuclei_per_axis": q("num_nuclei", "major_axis"),
        }
    )


def slide_ratios(rows: DataFrame) -> DataFrame:
    """Rows of slides with their tissue and the eight measures that are relative to it or to the whole slide.

    A quotient by zero is missing.
    """
    q = lambda a, b: F.try_divide(F.col(a), F.col(b))
    rows = rows.withColumn("total_tissue", F.col("avg_tissue_per_tile") * F.col("num_tiles"))
    to_tissue = {
        "nuclei_density": "original_num_nuclei", "nuclei_density_aggregates": "num_nuclei_total", "nuclei_density_dtfe": "num_nuclei_dtfe_only",
        "norm_pixels_max_cluster": "num_pixels_cluster", "norm_nuclei_max_cluster": "num_nuclei_cluster", "norm_num_clusters": "num_clusters",
        "norm_bc_frac_dim_dtfe_wsi": "bc_frac_dim_dtfe_wsi",
    }
    ratios = {name: q(c, "total_tissue") for name, c in to_tissue.items()}
    return rows.withColumns({**ratios, "bc_frac_dim_wsi_ratio": q("bc_frac_dim_dtfe_wsi", "bc_frac_dim_full_wsi")})


def scene_union(parts: dict[str, DataFrame], summary: DataFrame, on: list[str]) -> DataFrame:
    """Aggregate tables of several projects, each left-joined with its scenes' summary, tagged and filled with 0."""
    out = None
    for project, df in parts.items():
        one = df.join(summary, on, "left").withColumn("project", F.lit(project))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.na.fill(0)


def group_max(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in features])


def parameter_slice(df: DataFrame, threshold: float, edge: int, nuclei: int) -> DataFrame:
    at = (F.bround("dtfe_threshold", 4) == threshold) & (F.col("edge_range") == edge) & (F.col("min_nuclei") == nuclei)
    return df.where(at)


def confusion(pred: DataFrame) -> DataFrame:
    """(y, pred, n, share): counts and shares of each true class."""
    n = pred.groupBy("y", "pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def within(pred: DataFrame, tolerance: int) -> DataFrame:
    """Share of predictions at most tolerance grades from the truth, for each true class."""
    hit = F.avg((F.abs(F.col("y") - F.col("pred")) <= tolerance).cast("double"))
    return pred.groupBy("y").agg(hit.alias("share"))


def auc_by(scored: DataFrame, keys: list[str], cuts: int = 64) -> DataFrame:
    """(keys, auc): area under the curve of (y, score) in each group by rank sums; ties count half.

    Counts by score are summed first. Distinct scores are numbered within ranges whose sums are known before, so no group
    is ordered in one task; where the ranges are cut changes nothing. A group of one class has no area (null).
    """
    by = materialize(scored.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")))
    edges = by.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.percentile_approx("score", [i / cuts for i in range(1, cuts)]).alias("_cuts"))
    same = lambda left: [left[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    ranged = by.join(edges, same(by)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).select(*by.columns, "_range")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("q").alias("_q")).withColumn("_start", F.coalesce(F.sum("_q").over(before), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_in"), "_start")
    within = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_below", F.coalesce(F.sum("q").over(within), F.lit(0)))
    placed = placed.join(totals, [*same(placed), placed["_range"] == F.col("_in")])
    won = F.col("p") * (F.col("_start") + F.col("_below") + F.col("q") / 2.0)
    return placed.groupBy(*keys).agg(F.try_divide(F.sum(won), F.sum("p") * F.sum("q")).alias("auc"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row, auc, of all rows (y, score); null without rows of both classes."""
    return auc_by(scored.select("y", "score", F.lit(0).alias("_all")), ["_all"]).agg(F.max("auc").alias("auc"))


def macro_auc(scored: DataFrame, k: int) -> DataFrame:
    """One row, auc: the mean over ordered pairs of classes i, j of the area that p_i has between rows of i and of j.

    scored: y, a class from 0 to k - 1, and the class probabilities p0 ... p(k-1). Pairs without rows of both classes are
    left out.
    """
    mine = F.coalesce(*[F.when(F.col("y") == i, F.col(f"p{i}")) for i in range(k)])
    as_i = [F.struct(F.col("y").alias("i"), F.lit(j).alias("j"), F.lit(1).alias("hit"), mine.alias("score")) for j in range(k)]
    as_j = [F.struct(F.lit(i).alias("i"), F.col("y").alias("j"), F.lit(0).alias("hit"), F.col(f"p{i}").alias("score")) for i in range(k)]
    pairs = scored.select(F.inline(F.array(*as_i, *as_j))).where("i <> j").withColumnRenamed("hit", "y")
    return auc_by(pairs, ["i", "j"]).agg(F.avg("auc").alias("auc"))


def scores(pred: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, F1 and the pair-based Fowlkes-Mallows index of binary predictions, of all or for each of keys."""
    c = lambda cond: F.sum(cond.cast("long"))
    y, p = F.col("y") == 1, F.col("pred") == 1
    t = pred.groupBy(*keys).agg(c(y & p).alias("tp"), c(~y & p).alias("fp"), c(y & ~p).alias("fn"), c(~y & ~p).alias("tn"))
    pairs = lambda *n: sum(F.col(x) * (F.col(x) - 1) for x in n)
    both = pairs("tp", "fp", "fn", "tn")
    rows = sum((F.col(a) + F.col(b)) * (F.col(a) + F.col(b) - 1) for a, b in (("tp", "fn"), ("fp", "tn")))
    cols = sum((F.col(a) + F.col(b)) * (F.col(a) + F.col(b) - 1) for a, b in (("tp", "fp"), ("fn", "tn")))
    return t.select(
        *keys,
        ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
        F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.try_divide(both.cast("double"), F.sqrt(rows.cast("double") * cols)).alias("fm"),
    )


def ordinal_probabilities(cumulative: DataFrame, k: int) -> DataFrame:
    """Class probabilities from P(y > 0) ... P(y > k - 2) in columns p0 ...; differences may be negative."""
    p = [F.lit(1.0), *[F.col(f"p{i}") for i in range(k - 1)], F.lit(0.0)]
    return cumulative.withColumns({f"class_{i}": p[i] - p[i + 1] for i in range(k)})


def _dealt(df: DataFrame, y: str, order: str, salt: str = "") -> DataFrame:
    """df with _place, from 0, of each row of a class in the order of a hash of salt and key.

    Rows are numbered in hash buckets of a class whose sizes are summed before, so no class is one group.
    """
    b = df.withColumn("_h", F.md5(F.concat(F.lit(salt), F.col(order).cast("string")).cast("binary"))).withColumn("_b", F.substring("_h", 1, 2))
    n = b.groupBy(y, "_b").count()
    upto = Window.partitionBy(y).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select(F.col(y).alias("_y"), F.col("_b").alias("_c"), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_s"))
    at = F.row_number().over(Window.partitionBy(y, "_b").orderBy("_h", order)) - 1
    placed = b.withColumn("_at", at).join(start, (F.col(y) == F.col("_y")) & (F.col("_b") == F.col("_c")))
    return placed.withColumn("_place", F.col("_at") + F.col("_s")).select(*df.columns, "_place")


def stratified_folds(df: DataFrame, y: str, order: str, k: int) -> DataFrame:
    """df with fold: rows of each class are dealt in turn, in the order of a hash of their key."""
    return _dealt(df, y, order).withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place")


def stratified_split(df: DataFrame, y: str, order: str, share: float = 0.5, salt: str = "") -> DataFrame:
    """df with train: the first share of each class (rounded down) in the order of a salted hash of their key.

    The same salt gives the same split on every run; rows without a class are left out. Counts of each class by the
    first digits of the hash tell in which of 65,536 ranges its cut lies; only that range's rows are ordered, all others
    are decided in their row. Keys may repeat.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(salt), F.col(order).cast("string")).cast("binary"))).withColumn("_b", F.substring("_h", 1, 4))
    sums = Window.partitionBy(y, "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = materialize(hashed.groupBy(y, "_b").count().withColumn("_c", F.substring("_b", 1, 2)))
    over = Window.partitionBy(y).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    size = n.groupBy(y, "_c").agg(F.sum("count").alias("_n"))
    size = size.select(F.col(y).alias("_y"), F.col("_c").alias("_d"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_s"), F.floor(F.sum("_n").over(Window.partitionBy(y)) * F.lit(share)).alias("_take"))
    placed = n.withColumn("_in", F.coalesce(F.sum("count").over(sums), F.lit(0))).join(size, (F.col(y) == F.col("_y")) & (F.col("_c") == F.col("_d")))
    start = F.col("_s") + F.col("_in")
    holds = F.when((start <= F.col("_take")) & (F.col("_take") < start + F.col("count")), F.struct(F.col("_b").alias("at"), (F.col("_take") - start).alias("left")))
    cut = materialize(placed.groupBy("_y").agg(F.max(holds).alias("_cut")))
    met = hashed.where("_b IS NOT NULL").join(broadcast_if_small(cut), F.col(y) == F.col("_y"))
    rest = F.col("_cut.at").eqNullSafe(F.col("_b"))
    clear = met.where(~rest).select(*df.columns, F.coalesce(F.col("_b") < F.col("_cut.at"), F.lit(True)).alias("train"))
    place = F.row_number().over(Window.partitionBy(y).orderBy("_h", order))
    return clear.unionByName(met.where(rest).select(*df.columns, (place <= F.col("_cut.left")).alias("train")))


def stratified_splits(df: DataFrame, y: str, order: str, share: float, salts: list[str]) -> DataFrame:
    """df with train, an array: for each salt what stratified_split says, from one count of all of them.

    Rows in the range of the hash that holds a salt's cut, some 65,536th of all, are ordered; all others are decided in
    their row.
    """
    hashed = lambda s: F.md5(F.concat(F.lit(s), F.col(order).cast("string")).cast("binary"))
    range_of = lambda s: F.substring(hashed(s), 1, 4)
    each = df.where(F.col(y).isNotNull()).select(F.col(y).alias("_y"), F.posexplode(F.array(*[range_of(s) for s in salts])).alias("_k", "_b"))
    n = materialize(each.groupBy("_k", "_y", "_b").count().withColumn("_c", F.substring("_b", 1, 2)))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    size = n.groupBy("_k", "_y", "_c").agg(F.sum("count").alias("_n"))
    before = F.coalesce(F.sum("_n").over(upto(Window.partitionBy("_k", "_y").orderBy("_c"))), F.lit(0))
    size = size.select("_k", "_y", "_c", before.alias("_s"), F.floor(F.sum("_n").over(Window.partitionBy("_k", "_y")) * F.lit(share)).alias("_take"))
    inner = F.coalesce(F.sum("count").over(upto(Window.partitionBy("_k", "_y", "_c").orderBy("_b"))), F.lit(0))
    placed = n.withColumn("_in", inner).join(size, ["_k", "_y", "_c"])
    start = F.col("_s") + F.col("_in")
    holds = (start <= F.col("_take")) & (F.col("_take") < start + F.col("count"))
    cut = placed.groupBy("_y", "_k").agg(F.max(F.when(holds, F.struct(F.col("_b").alias("at"), (F.col("_take") - start).alias("left")))).alias("c"))
    cuts = materialize(cut.groupBy("_y").agg(F.map_from_entries(F.collect_list(F.struct("_k", "c"))).alias("_cuts")))
    met = df.where(F.col(order).isNotNull()).join(broadcast_if_small(cuts), F.col(y) == F.col("_y"))
    at = lambda k: F.col("_cuts")[k]["at"]
    met = met.withColumn("train", F.array(*[F.when(at(k).isNull(), True).when(range_of(s) != at(k), range_of(s) < at(k)) for k, s in enumerate(salts)]))
    open_ = F.exists("train", lambda t: t.isNull())
    rest = materialize(met.where(open_).withColumn("_id", F.monotonically_increasing_id()))
    ties = rest.select("_id", y, F.col(order).alias("_o"), F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), F.col("train")[k].alias("_t"), hashed(s).alias("_h"), F.col("_cuts")[k]["left"].alias("_left")) for k, s in enumerate(salts)]))).where("_t IS NULL")
    place = F.row_number().over(Window.partitionBy("_k", y).orderBy("_h", "_o"))
    told = ties.select("_id", "_k", (place <= F.col("_left")).alias("_t")).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_t"))).alias("_told"))
    settled = F.transform("train", lambda t, k: F.coalesce(t, F.element_at("_told", k)))
    rest = rest.join(told.withColumnRenamed("_id", "_i"), F.col("_id") == F.col("_i")).select(*df.columns, settled.alias("train"))
    return met.where(~open_).select(*df.columns, "train").unionByName(rest)


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns less their mean, over their population deviation; a constant column becomes 0, nulls stay."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    value = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).withColumns({c: value(c) for c in columns}).select(*df.columns)


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns moved and stretched to 0 to 1; a constant column becomes 0, nulls stay."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"_{k}_{c}") for c in columns for k, f in (("a", F.min), ("b", F.max))])
    span = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}")
    value = lambda c: (F.col(c) - F.col(f"_a_{c}")) / F.when(span(c) > 0, span(c)).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).withColumns({c: value(c) for c in columns}).select(*df.columns)


def oversample(df: DataFrame, y: str) -> DataFrame:
    """Each row of the smaller classes as often as the largest class goes whole into it, once at least."""
    n = df.groupBy(y).agg(F.count("*").alias("_n"))
    top = n.agg(F.max("_n").alias("_top"))
    times = n.crossJoin(top).select(F.col(y).alias("_y"), F.greatest(F.expr("_top div _n"), F.lit(1)).cast("int").alias("_t"))
    return (
        df.join(F.broadcast(times), F.col(y) == F.col("_y"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t"))))
        .drop("_y", "_t")
    )


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The n features with the highest mean importance; names order equals."""
    return importance.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(
        F.desc("importance"), "feature"
    ).limit(n)


def job_statistics(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type").agg(
        F.median("minutes").alias("median_minutes"), F.stddev_samp("minutes").alias("std_minutes")
    )


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): ids only in a, only in b and in both."""
    a, b = a.select(key), b.select(key)
    tag = lambda df, s: df.select(F.lit(s).alias("side"), key)
    return tag(a.subtract(b), "left").unionAll(tag(b.subtract(a), "right")).unionAll(tag(a.intersect(b), "both"))


def interpolate(points: DataFrame, x: str, y: str, steps: int = 100) -> DataFrame:
    """Values of a curve at steps + 1 even places from 0 to 1, linear between its points."""
    grid = points.sparkSession.range(steps + 1).select((F.col("id") / float(steps)).alias("g"))
    both = points.select(F.col(x).alias("g"), F.col(y).alias("v"), F.lit(0).alias("wanted")).unionAll(
        grid.select("g", F.lit(None).cast("double"), F.lit(1))
    )
    w = Window.orderBy("g", "wanted")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.col("g"))
    x0, y0 = F.last(known, True).over(back), F.last("v", True).over(back)
    x1, y1 = F.first(known, True).over(ahead), F.first("v", True).over(ahead)
    value = F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * F.try_divide(F.col("g") - x0, x1 - x0))
    return both.select("g", "wanted", F.coalesce(value, y0, y1).alias("value")).where("wanted = 1").drop("wanted")
