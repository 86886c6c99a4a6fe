"""The flagship plan: nuclei of tissue tiles to dense aggregates with their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spatial, tables
from ..sources.storage import materialize


def aggregate_nodes(points: DataFrame, edge_range: float, min_nuclei: int, min_neighbours: int = 3) -> DataFrame:
    """Points (image_id, nid, x, y, ...) with component, of the components with enough nuclei.

    Radius graph, one pruning pass, connected components, size filter. The graph's edges, which grow with the density,
    are never made: squares within the range stand for their points. A point without a link is no component.
    """
    kept = materialize(spatial.well_linked(points, edge_range, min_neighbours))
    return spatial.label_linked(kept, edge_range, max(min_nuclei, 2))


def describe(members: DataFrame) -> DataFrame:
    """One row for each aggregate: count, centroid, box, axes from second moments."""
    key = ["image_id", "component"]
    m = members.groupBy(*key).agg(
        F.count("*").alias("num_nuclei"),
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        F.sum("area").alias("nuclei_area"),
        F.min("x").alias("bb_min_col"),
        F.min("y").alias("bb_min_row"),
        F.max("x").alias("bb_max_col"),
        F.max("y").alias("bb_max_row"),
        F.var_pop("x").alias("mxx"),
        F.var_pop("y").alias("myy"),
        F.covar_pop("x", "y").alias("mxy"),
    )
    spread = F.sqrt((F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) + 4 * F.col("mxy") * F.col("mxy"))
    axis = lambda s: F.bround(4 * F.sqrt(F.greatest((F.col("mxx") + F.col("myy") + s) / 2, F.lit(0.0))), 4)
    return (
        m.withColumn("major_axis_length", axis(spread)).withColumn("minor_axis_length", axis(-spread))
        .withColumn("centroid_x", F.bround("centroid_x", 4)).withColumn("centroid_y", F.bround("centroid_y", 4))
        .drop("mxx", "myy", "mxy")
    )


def detect_aggregates(nuclei: DataFrame, tiles: DataFrame, edge_range: float, min_nuclei: int) -> DataFrame:
    return describe(aggregate_nodes(tables.density_input(nuclei, tiles), edge_range, min_nuclei))


def threshold_sweep(density: DataFrame, thresholds: list[float], edge_range: float, min_nuclei: int, min_neighbours: int = 3) -> DataFrame:
    """(threshold, n_threshold, n_clustered, n_total, ...) of all thresholds in one plan.

    An image under a threshold counts as an image of its own, so the components of all are found at once.
    """
    spark = density.sparkSession
    grid = F.broadcast(spark.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "t int, threshold double"))
    total = density.count()
    passing = materialize(density.select("image_id", "nid", "x", "y", "dtfe").where(F.col("dtfe") > min(thresholds)))
    over = lambda v, i: F.count_if(F.col(v) > thresholds[i])
    every = range(len(thresholds))
    each = F.explode(F.array_compact(F.array(*[F.when(F.col("dtfe") > thresholds[i], F.lit(i)) for i in every])))
    each = passing.where("image_id IS NOT NULL").select("image_id", "nid", "x", "y", each.alias("t"))
    kept = materialize(spatial.well_linked(each.select(F.struct("image_id", "t").alias("image_id"), "nid", "x", "y"), edge_range, min_neighbours))
    sizes = spatial.label_squares(kept, edge_range).groupBy("image_id", "component").agg(F.sum("n").alias("size"))
    sizes = sizes.where(F.col("size") >= max(min_nuclei, 2))
    clustered = sizes.groupBy(F.col("image_id.t").alias("t")).agg(F.sum("size").alias("n_clustered"))
    passed = passing.agg(*[over("dtfe", i).alias(f"n{i}") for i in every])
    passed = passed.select(F.inline(F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"n{i}").alias("n_threshold")) for i in every])))
    return (
        grid.join(passed, "t", "left").join(clustered, "t", "left").na.fill(0).select("threshold", "n_threshold", "n_clustered")
        .withColumn("n_total", F.lit(total)).withColumn("edge_range", F.lit(float(edge_range)))
        .withColumn("min_nuclei", F.lit(min_nuclei))
    )
