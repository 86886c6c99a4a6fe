"""Splits, scores and pixel classifiers on small fixtures."""

import itertools
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pointweave.operators import cohort, ml, pixels, tables


def test_areas_do_not_depend_on_cuts(spark):
    rng = random.Random(2)
    rows = [(k % 3, rng.randrange(2), rng.randrange(40) / 8) for k in range(400)] + [(7, 1, 0.5), (7, 1, 0.25), (None, 0, 1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g int, y int, score double")
    want = {}
    for g in {r[0] for r in rows}:
        won = [(p > q) + (p == q) / 2 for p in [r[2] for r in rows if r[:2] == (g, 1)] for q in [r[2] for r in rows if r[:2] == (g, 0)]]
        want[g] = sum(won) / len(won) if won else None
    for cuts in (2, 5, 64):
        assert {r["g"]: r["auc"] for r in cohort.auc_by(df, ["g"], cuts).collect()} == pytest.approx(want)
    assert cohort.roc_auc(df.where("g = 7")).collect()[0]["auc"] is None
    assert cohort.roc_auc(df.limit(0)).collect()[0]["auc"] is None


def test_macro_area_is_the_mean_over_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), *(rng.randrange(9) / 8 for _ in range(4))) for _ in range(90)]
    areas = []
    for i, j in itertools.permutations(range(3), 2):
        won = [(a[1 + i] > b[1 + i]) + (a[1 + i] == b[1 + i]) / 2 for a in rows if a[0] == i for b in rows if b[0] == j]
        areas.append(sum(won) / len(won))
    df = spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double, p3 double")
    # no row is of class 3: its pairs are left out
    assert cohort.macro_auc(df, 4).first()["auc"] == pytest.approx(sum(areas) / 6)


def test_split_is_stratified_and_repeatable(spark):
    df = spark.createDataFrame([(k, "a" if k % 10 else "b") for k in range(305)] + [(999, None)], "k int, y string")
    one = cohort.stratified_split(df, "y", "k", 0.5, "1:").collect()
    count = lambda y, t: sum(r["y"] == y and r["train"] == t for r in one)
    assert [count("a", True), count("a", False), count("b", True), count("b", False)] == [137, 137, 15, 16] and len(one) == 305
    assert sorted(one) == sorted(cohort.stratified_split(df.repartition(7), "y", "k", 0.5, "1:").collect())
    assert {r["k"] for r in one if r["train"]} != {r["k"] for r in cohort.stratified_split(df, "y", "k", 0.5, "2:").collect() if r["train"]}
    assert cohort.stratified_split(df.limit(0), "y", "k").count() == 0


def test_scaling_of_nulls_and_constants(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (2, 4.0, 5), (3, None, 5)], "k int, a double, c int")
    rows = lambda f: [tuple(r) for r in f(df, ["a", "c"]).orderBy("k").collect()]
    assert rows(cohort.standard_scaled) == [(1, -1.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0)]
    assert rows(cohort.min_max_scaled) == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0)]


def test_repeated_scores_of_parted_classes(spark):
    df = spark.createDataFrame([(k, float(k % 2 * 9 + k % 5), float(k % 3), k % 2) for k in range(200)], "k int, a double, b double, y int")
    got = {r["score"]: (r["mean"], r["spread"]) for r in ml.repeated_scores(ml.logistic, df, ["a", "b"], "y", "k", repeats=3).collect()}
    assert got == dict.fromkeys(("auc", "accuracy", "f1", "fm"), (1.0, 0.0))


def test_pixel_classifier_survives_saving(spark, tmp_path):
    """A red block of 6 x 6, a red speck of 2 x 2 and green all round: the block alone is larger than the area."""
    rows = [(y, x, *((200, 20 + y, 30) if y < 6 and x < 6 or 9 <= y < 11 and 9 <= x < 11 else (40, 150 + x, 60))) for y in range(14) for x in range(14)]
    pix = spark.createDataFrame(rows, "py int, px int, r int, g int, b int")
    marked = pixels.labelled_pixels(pix, pix.where("r > 100")).withColumn("at", F.concat_ws(",", "py", "px"))
    model, rest = pixels.train_pixel_classifier(marked, "at", trees=5)
    assert rest.count() == 98 and pixels.classify_pixels(rest.drop("h", "s", "v"), model).where("pred <> y").isEmpty()
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    places = lambda m, area: sorted((r["py"], r["px"]) for r in pixels.marked_regions(pix, m, area).collect())
    assert places(model, 4) == places(again, 4) == [(y, x) for y in range(6) for x in range(6)]
    assert len(places(again, 3)) == 40 and places(again, 36) == []


def test_numbers_do_not_depend_on_cuts(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, None]), v) for v in rng.sample(range(-500, 500), 300)]
    df = spark.createDataFrame(rows, "g int, v long")
    want = {(g, v): 1 + sum(g == h and w < v for h, w in rows) for g, v in rows}
    for cuts in (2, 7, 64):
        assert {(r["g"], r["v"]): r["n"] for r in tables.numbered(df, ["g"], "v", "n", cuts).collect()} == want


def test_lookup_fails_at_a_miss(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = lambda ks: sorted(tuple(r) for r in tables.lookup(spark.createDataFrame([(k,) for k in ks], "k int"), known, "k").collect())
    assert rows([2, 1, 1]) == [(1, "a"), (1, "a"), (2, "b")]
    for missing in (3, None):
        with pytest.raises(Exception, match="no row for k"):
            rows([1, missing])


def test_splits_of_all_salts_equal_those_of_each(spark):
    """Keys of one hash on both sides of a cut, classes of few rows, keys and classes that are null."""
    rows = [(k // 3, k % 5 % 3) for k in range(900)] + [(7, 9), (8, 9), (None, 1), (3, None)] + [(1, 5)] * 7
    df = spark.createDataFrame(rows, "k int, y int")
    salts = [f"{k}:" for k in range(12)]
    got = cohort.stratified_splits(df, "y", "k", 0.75, salts).collect()
    assert sum(len(r["train"]) == 12 and None not in r["train"] for r in got) == len(rows) - 2
    for k, salt in enumerate(salts):
        want = cohort.stratified_split(df, "y", "k", 0.75, salt).collect()
        assert sorted((r["y"], r["k"], r["train"]) for r in want) == sorted((r["y"], r["k"], r["train"][k]) for r in got)


def test_repeats_share_the_jobs_of_their_splits_and_scores(spark):
    """Jobs besides those of the fits do not follow the number of repeats."""
    df = spark.createDataFrame([(k, float(k % 10), float(k * 7 % 31), int(k % 10 > 6)) for k in range(400)], "k int, a double, b double, y int")
    model, tracker, jobs = ml.logistic(ml.vectors(df, ["a", "b"]), "y"), spark.sparkContext.statusTracker(), []
    for repeats in (2, 6):
        spark.sparkContext.setJobGroup(f"repeats {repeats}", "")
        assert ml.repeated_scores(lambda *_: model, df, ["a", "b"], "y", "k", repeats=repeats).count() == 4
        jobs.append(len(tracker.getJobIdsForGroup(f"repeats {repeats}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] <= jobs[0] + 4
