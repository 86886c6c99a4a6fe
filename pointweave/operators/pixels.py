"""Classifiers of single pixels by colour, and the regions that they find."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources.storage import broadcast_if_small, materialize
from . import cohort, raster

COLOURS = ["r", "g", "b", "h", "s", "v"]


def colour_features(pix: DataFrame) -> DataFrame:
    """pix (..., r, g, b) with hue, saturation and value as h, s, v."""
    h, s, v = scalar.hsv(F.col("r"), F.col("g"), F.col("b"))
    return pix.withColumns({"h": h, "s": s, "v": v})


def labelled_pixels(tissue: DataFrame, marked: DataFrame) -> DataFrame:
    """tissue (py, px, ...) with y: 1 where marked (py, px) has the pixel, else 0."""
    return tissue.join(marked.select("py", "px", F.lit(1).alias("y")).distinct(), ["py", "px"], "left").na.fill(0, ["y"])


def train_pixel_classifier(pix: DataFrame, key: str, depth: int = 2, trees: int = 100, seed: int = 44) -> tuple[PipelineModel, DataFrame]:
    """A forest that tells pixels of y 1 from those of y 0 by colour, and the half of pix that it did not learn from.

    pix: key, y, r, g, b. The halves are stratified by y; the smaller class of the first is repeated as often as it goes
    whole into the larger. The model is saved with model.write() and read with PipelineModel.load.
    """
    parts = materialize(cohort.stratified_split(colour_features(pix), "y", key, 0.5, f"{seed}:"))
    train = cohort.oversample(parts.where("train"), "y")
    forest = RandomForestClassifier(labelCol="y", maxDepth=depth, numTrees=trees, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=COLOURS, outputCol="features"), forest]).fit(train), parts.where("NOT train").drop("train")


def classify_pixels(tissue: DataFrame, model) -> DataFrame:
    """tissue (py, px, r, g, b, ...) with pred, 1 or 0, by a model of train_pixel_classifier or any on COLOURS."""
    out = model.transform(colour_features(tissue))
    return out.select(*tissue.columns, F.col("prediction").cast("int").alias("pred"))


def large_regions(fg: DataFrame, area: float) -> DataFrame:
    """(py, px, component) of the four-connected regions of fg (py, px) that are larger than area pixels."""
    labelled = materialize(raster.label_components(fg.select("py", "px")))
    large = labelled.groupBy("component").count().where(F.col("count") > area).select("component")
    return labelled.join(broadcast_if_small(materialize(large)), "component", "left_semi").select("py", "px", "component")


def marked_regions(tissue: DataFrame, model, area: float) -> DataFrame:
    """(py, px, component) of the regions of tissue pixels that the model takes for class 1, larger than area pixels."""
    return large_regions(classify_pixels(tissue, model).where("pred = 1"), area)
