"""Connected components and spanning forests of edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import materialize, release


def _settled(edges: DataFrame) -> bool:
    """Every child has one parent and no parent is a child."""
    roles = edges.select(F.col("child").alias("node"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionAll(
        edges.select("parent", F.lit(0), F.lit(1))
    )
    seen = roles.groupBy("node").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
    return seen.where((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0))).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(child, parent) for every node that is not the least of its component; parent is that least node.

    edges: columns a and b of one orderable type. Each round reattaches the neighbours above a node to the least node
    around it, then a node's own parents to their least. Rounds are written to the shared folder; their number grows
    with the logarithm of the longest path, and the least neighbour is a partial aggregate, so hubs stay cheap. Nodes
    that are structs meet in shuffled joins: a broadcast of such keys, in every round, takes a whole memory page of the
    driver however few its rows; one of longs takes what its rows need and is left to the planner.
    """
    met = lambda df: df.hint("merge") if isinstance(edges.schema["a"].dataType, T.StructType) else df
    out = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _settled(out):
            return out
        up = out.select(F.col("parent").alias("u"), F.col("child").alias("v"))
        least = up.unionAll(out.select("child", "parent")).groupBy("u").agg(F.min("v").alias("m"))
        large = up.join(met(least), "u").select(F.col("v").alias("child"), F.least("u", "m").alias("parent"))
        small = large.join(met(large.groupBy("child").agg(F.min("parent").alias("m"))), "child")
        moved = small.where("parent <> m").select(F.col("parent").alias("child"), "m")
        before = out
        out = materialize(small.select("child", F.col("m").alias("parent")).unionAll(moved).distinct())
        release(before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merge_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """components, (child, parent) as connected_components gives it, after further edges (a, b).

    Only edges between different components count: the rounds run over the components that they join.
    """

    def top(df, column):
        up = components.select(F.col("child").alias(column), F.col("parent").alias("_up"))
        return df.join(up, column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")

    between = materialize(top(top(edges.select("a", "b"), "a"), "b").where("a <> b"))
    if between.isEmpty():
        return components
    joined = connected_components(between)
    raised = joined.select(F.col("child").alias("parent"), F.col("parent").alias("_top"))
    return materialize(
        components.join(raised, "parent", "left").select("child", F.coalesce("_top", "parent").alias("parent")).unionAll(joined)
    )


def label_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (image_id, nid, ...) with component, the least nid that edges (image_id, src, dst) reach from nid."""
    key = lambda c: F.struct("image_id", F.col(c).alias("nid"))
    found = connected_components(edges.select(key("src").alias("a"), key("dst").alias("b")))
    found = found.select(
        F.col("child.image_id").alias("image_id"), F.col("child.nid").alias("nid"), F.col("parent.nid").alias("component")
    )
    return nodes.join(found, ["image_id", "nid"], "left").withColumn("component", F.coalesce("component", "nid"))


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Minimum spanning forest of edges (image_id, src, dst, weight) by Boruvka rounds; ties by (src, dst).

    Each round keeps the lightest edge that leaves each component and contracts what it joins, so components halve.
    """
    columns = edges.columns
    live = materialize(edges.withColumn("cu", F.col("src")).withColumn("cv", F.col("dst")))
    forest = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        order = F.struct("weight", "src", "dst")
        sides = live.select("image_id", F.explode(F.array("cu", "cv")).alias("c"), order.alias("e"))
        best = sides.groupBy("image_id", "c").agg(F.min("e").alias("e")).select("image_id", "e.*").distinct()
        chosen = materialize(live.join(best, ["image_id", "src", "dst", "weight"], "left_semi"))
        forest = chosen.select(*columns) if forest is None else forest.unionByName(chosen.select(*columns))
        key = lambda c: F.struct("image_id", F.col(c).alias("nid"))
        up = connected_components(chosen.select(key("cu").alias("a"), key("cv").alias("b"))).select(
            F.col("child.image_id").alias("image_id"), F.col("child.nid").alias("nid"), F.col("parent.nid").alias("top")
        )
        for c in ("cu", "cv"):
            live = live.join(up.withColumnRenamed("nid", c), ["image_id", c], "left").withColumn(
                c, F.coalesce("top", c)
            ).drop("top")
        live = materialize(live.where("cu <> cv").select(*columns, "cu", "cv"))
    return edges.limit(0) if forest is None else forest
