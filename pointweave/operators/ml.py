"""Fitted models on feature tables, by MLlib."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import broadcast_if_small, materialize, release
from . import cohort

#: Repeats whose splits and scores are made in the same jobs, and fits that run side by side.
AT_ONCE, FITS = 20, 4


def vectors(df: DataFrame, columns: list[str] | None = None, array: str | None = None) -> DataFrame:
    if array:
        return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def standardized(df: DataFrame) -> DataFrame:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return scaler.fit(df).transform(df).drop("features").withColumnRenamed("scaled", "features")


def principal_components(df: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """df with pca (an array of k values, signs undetermined) and the shares of variance."""
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(df)
    return model.transform(df).withColumn("pca", vector_to_array("_pca")).drop("_pca"), list(model.explainedVariance)


def gaussian_mixture(df: DataFrame, k: int, seed: int = 1) -> tuple[DataFrame, dict[str, float]]:
    """df with cluster (from 1) and the log-likelihood, BIC and AIC of the mixture."""
    model = GaussianMixture(k=k, seed=seed).fit(df)
    n, d = df.count(), len(df.first()["features"])
    free = k * (d + d * (d + 1) / 2) + k - 1
    ll = model.summary.logLikelihood
    return (
        model.transform(df).withColumn("cluster", F.col("prediction") + 1),
        {"log_likelihood": ll, "bic": free * math.log(n) - 2 * ll, "aic": 2 * free - 2 * ll},
    )


def mixture_threshold(df: DataFrame, column: str, n: float, use_variance: bool = True, seed: int = 1) -> DataFrame:
    """Two normal components of log(column); exp(mean -+ n spreads) of the upper one, the spread a variance by default."""
    data = vectors(df.where(F.col(column) > 0).select(F.log(column).alias("v")), ["v"])
    top = max(GaussianMixture(k=2, seed=seed).fit(data).gaussians, key=lambda g: g.mean[0])
    var = top.cov.toArray()[0, 0]
    spread = var if use_variance else math.sqrt(var)
    row = [(math.exp(top.mean[0] - n * spread), math.exp(top.mean[0] + n * spread))]
    return df.sparkSession.createDataFrame(row, "low double, high double")


def balanced(df: DataFrame, y: str) -> DataFrame:
    """df with weight: rows over classes times rows of the class."""
    n = df.groupBy(y).agg(F.count("*").alias("_n")).withColumnRenamed(y, "_y")
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    w = n.crossJoin(total).select("_y", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(broadcast_if_small(w), F.col(y) == F.col("_y")).drop("_y")


def random_forest(train: DataFrame, y: str, trees: int = 10, depth: int = 5, seed: int = 1):
    return RandomForestClassifier(labelCol=y, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(balanced(train, y))


def logistic(train: DataFrame, y: str):
    return LogisticRegression(labelCol=y, weightCol="weight", regParam=0.01).fit(balanced(train, y))


def hash_split(df: DataFrame, key: str, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of their key: the same split on every run."""
    h = F.pmod(F.xxhash64(key), F.lit(100))
    return df.where(h < percent), df.where(h >= percent)


def _numbered(df: DataFrame, groups: list[str], key: str, buckets: int = 256) -> DataFrame:
    """df with _rank, the place from 0 of each row in the order of the hash key within its group.

    Rows are numbered in hash buckets whose sizes are summed before, so no group is ordered in one task and every place
    is taken once.
    """
    dealt = df.withColumn("_b", F.pmod(key, F.lit(buckets)))
    upto = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*groups, "_b").count().select(*groups, "_b", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*groups, "_b").orderBy(key, "_id")
    ranked = dealt.withColumn("_in", F.row_number().over(within) - 1).join(broadcast_if_small(materialize(starts)), [*groups, "_b"])
    return ranked.withColumn("_rank", F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def permutation_importance(model, test: DataFrame, columns: list[str], y: str, seed: int = 1, repeats: int = 10) -> DataFrame:
    """(feature, importance, spread): fall of the accuracy when a column's values are dealt out anew among all rows.

    importance and spread are the mean and the sample deviation over so many repeats. Each row meets, for each feature and
    repeat, the value of the row at its own place in another seeded order; every row gets one value. The values for a place
    travel alone and meet the row once; its dealt copies exist in the row's task only.
    """
    rows = materialize(test.select(*columns, y).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*columns, y])).withColumn("_id", F.monotonically_increasing_id()))
    rate = MulticlassClassificationEvaluator(labelCol=y, metricName="accuracy")
    base = rate.evaluate(model.transform(vectors(rows, columns)))
    draws = [(c, k) for c in columns for k in range(repeats)]
    placed = _numbered(rows.withColumn("_h", F.xxhash64(F.lit(seed), "_id")), [], "_h").drop("_h", "_id")
    value = lambda c, k: F.struct(F.lit(draws.index((c, k))).alias("_d"), F.col(c).cast("double").alias("_value"), F.xxhash64(F.lit(seed + 1), F.lit(c), F.lit(k), "_id").alias("_h"))
    each = rows.select("_id", F.inline(F.array(*[value(*d) for d in draws])))
    given = _numbered(each, ["_d"], "_h").select("_rank", "_d", "_value")
    given = given.repartition("_rank").groupBy("_rank").agg(F.collect_list(F.struct("_d", "_value")).alias("_given"))
    dealt = placed.join(given.hint("merge"), "_rank").select(y, *columns, F.inline("_given"))
    changed = lambda c: (F.col("_d") >= draws.index((c, 0))) & (F.col("_d") < draws.index((c, 0)) + repeats)
    dealt = dealt.select("_d", y, *[F.when(changed(c), F.col("_value")).otherwise(F.col(c)).alias(c) for c in columns])
    right = model.transform(vectors(dealt, columns)).groupBy("_d").agg(F.avg((F.col("prediction") == F.col(y)).cast("int")).alias("a"))
    fall = F.lit(base) - F.col("a")
    feature = F.element_at(F.array(*[F.lit(c) for c in columns]), F.expr(f"int(_d div {repeats})") + 1)
    return right.groupBy(feature.alias("feature")).agg(F.avg(fall).alias("importance"), F.stddev_samp(fall).alias("spread"))


def backward_elimination(fit, train: DataFrame, test: DataFrame, columns: list[str], y: str, sizes=(6, 5, 4, 3), repeats: int = 10) -> DataFrame:
    """(n_features, features, accuracy) of models fit(train with features, y) on ever fewer columns.

    Each step keeps the most important columns of the model before, ties by name; at most as many rows as columns reach
    the driver.
    """
    rate, out = MulticlassClassificationEvaluator(labelCol=y, metricName="accuracy"), []
    for size in (len(columns), *[n for n in sizes if n < len(columns)]):
        if size < len(columns):
            found = permutation_importance(model, test, columns, y, repeats=repeats).orderBy(F.desc("importance"), "feature").limit(size)
            columns = sorted(r["feature"] for r in found.collect())
        model = fit(vectors(train, columns), y)
        out.append((size, list(columns), rate.evaluate(model.transform(vectors(test, columns)))))
    return train.sparkSession.createDataFrame(out, "n_features int, features array<string>, accuracy double")


def repeated_scores(fit, data: DataFrame, columns: list[str], y: str, key: str, repeats: int = 100, share: float = 0.75) -> DataFrame:
    """(score, mean, spread) of auc, accuracy, f1 and fm over repeated stratified splits of data, y being 0 or 1.

    fit(train with features, y) gives a model with probabilities. Each repeat is one split by its own salt. AT_ONCE repeats
    share the jobs of their splits and scores and are fitted side by side, since a fit is many short jobs; one row of
    scores a repeat reaches the driver.
    """
    rows = materialize(data.select(key, *columns, y).dropna(subset=columns))
    names, out = ("auc", "accuracy", "f1", "fm"), []
    for first in range(0, repeats, AT_ONCE):
        salts = [f"{k}:" for k in range(first, min(first + AT_ONCE, repeats))]
        split = materialize(cohort.stratified_splits(rows, y, key, share, salts))
        parts = lambda k, held, split=split: vectors(split.where(F.col("train")[k] == held).drop("train"), columns)
        with ThreadPool(min(FITS, len(salts))) as pool:
            models = pool.map(inheritable_thread_target(data.sparkSession)(lambda k, parts=parts: fit(parts(k, True), y)), range(len(salts)), 1)
        tested = None
        for k, model in enumerate(models):
            one = model.transform(parts(k, False))
            one = one.select(F.lit(k).alias("k"), F.col(y).cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score"))
            tested = one if tested is None else tested.unionAll(one)
        tested = materialize(tested)
        area = cohort.auc_by(tested.select("k", "y", "score"), ["k"])
        for row in cohort.scores(tested, ("k",)).join(area, "k", "left").orderBy("k").collect():
            out += [(c, None if row[c] is None else float(row[c])) for c in names]
        release(split, tested)
    each = data.sparkSession.createDataFrame(out, "score string, v double")
    return each.groupBy("score").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("spread"))


def pipeline(columns: list[str], y: str) -> Pipeline:
    """Assemble, scale and classify; save and load with MLlib's own writer."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            RandomForestClassifier(labelCol=y, numTrees=10, seed=1),
        ]
    )


def discriminant(train: DataFrame, columns: list[str], y: str):
    """Linear discriminant analysis in closed form: class means and the pooled covariance are grouped sums.

    Returns a function that adds pred to a table; only the sums of classes x columns come to the driver.
    """
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    rows = train.groupBy(y).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).orderBy(y).collect()
    total = sum(r["n"] for r in rows)
    cov = np.zeros((len(columns), len(columns)))
    for r in rows:
        for i, j in pairs:
            cov[i, j] += r["n"] * r[f"c{i}_{j}"] / total
            cov[j, i] = cov[i, j]
    inverse = np.linalg.pinv(cov)
    scores = []
    for r in rows:
        m = np.array([r[f"m{i}"] for i in range(len(columns))])
        w = inverse @ m
        bias = math.log(r["n"] / total) - float(m @ w) / 2
        scores.append((r[y], sum((float(a) * F.col(c) for a, c in zip(w, columns, strict=True)), F.lit(bias))))

    def predict(df: DataFrame) -> DataFrame:
        best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(v).alias("v")) for v, s in scores]))
        return df.withColumn("pred", best["v"])

    return predict


def ordinal_models(train: DataFrame, columns: list[str], y: str, k: int):
    """k - 1 binary models of y > i; returns a function that adds p0 ... p(k-2). k must be over 2, classes 0 to k - 1."""
    if k < 3:
        raise ValueError("an ordinal model needs three classes or more")
    data = vectors(train, columns)
    models = [logistic(data.withColumn("over", (F.col(y) > i).cast("double")), "over") for i in range(k - 1)]

    def predict(df: DataFrame) -> DataFrame:
        df = vectors(df, columns)
        for i, m in enumerate(models):
            out = m.transform(df).withColumn(f"p{i}", vector_to_array("probability")[1])
            df = out.drop("rawPrediction", "probability", "prediction")
        return df.drop("features")

    return predict
