"""Domain tables from the star schema, in integer arithmetic; the SQL texts beside them give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

TILE = 1024
PIX_WIDTH = 125


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem as nuclei of eight images; nid numbers an image's rows without one ordered window of them all."""
    from ..operators.tables import numbered

    li = table(spark, sf_dir, "lineitem").withColumn("image_id", F.col("l_suppkey") % 8)
    li = li.select("image_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    return (
        numbered(li, ["image_id"], "l_orderkey", "nid", then=("l_linenumber", "l_partkey", "l_suppkey"))
        .select(
            "image_id",
            "nid",
            ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 8192).alias("x"),
            ((F.col("l_partkey") * 6151 + F.col("l_orderkey") * 389 + F.col("l_linenumber") * 31) % 8192).alias("y"),
            F.col("l_quantity").alias("area"),
            F.round(F.col("l_discount") * 10, 2).alias("eccentricity"),
            F.round(1 - F.col("l_tax") * 2, 2).alias("solidity"),
        )
    )


NUC = """nuc AS (
  SELECT l_suppkey % 8 AS image_id,
         row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nid,
         (l_orderkey * 7919 + l_linenumber * 104729) % 8192 AS x,
         (l_partkey * 6151 + l_orderkey * 389 + l_linenumber * 31) % 8192 AS y,
         l_quantity AS area, round(l_discount * 10, 2) AS eccentricity, round(1 - l_tax * 2, 2) AS solidity
  FROM lineitem)"""


def tile_key(c: str):
    return F.expr(f"int({c} div {TILE})")


def tiles(nuc: DataFrame) -> DataFrame:
    key = ["image_id", "tile_row", "tile_col"]
    placed = nuc.withColumn("tile_row", tile_key("y")).withColumn("tile_col", tile_key("x"))
    return placed.groupBy(*key).agg(F.count("*").alias("num_nuclei")).select(
        *key,
        F.lit(TILE).alias("tile_size"),
        "num_nuclei",
        ((F.col("image_id") * 31 + F.col("tile_row") * 17 + F.col("tile_col") * 13) % 100 / 100.0).alias("tissue"),
    )


TILES = f"""tiles AS (
  SELECT image_id, CAST(y // {TILE} AS INT) AS tile_row, CAST(x // {TILE} AS INT) AS tile_col, {TILE} AS tile_size,
         count(*) AS num_nuclei,
         max(((image_id * 31 + y // {TILE} * 17 + x // {TILE} * 13) % 100) / 100.0) AS tissue
  FROM nuc GROUP BY 1, 2, 3)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(py, px, label, r, g, b): a raster of discs of three sizes, dark inside, light outside, some black."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    o = o.withColumn("py", F.expr(f"int(k div {PIX_WIDTH})")).withColumn("px", (F.col("k") % PIX_WIDTH).cast("int"))
    cx, cy = F.col("px") % 25 - 12, F.col("py") % 25 - 12
    by, bx = F.expr("py div 25"), F.expr("px div 25")
    inside = cx * cx + cy * cy <= 36 + 20 * ((by + bx) % 3)
    o = o.withColumn("label", F.when(inside, by * 5 + bx + 2).otherwise(0).cast("int"))
    dark, black = F.col("label") > 0, F.col("k") % 97 == 0
    channel = lambda a, m, base: F.when(black, 0).when(dark, 40 + F.col("k") * a % m).otherwise(base + F.col("k") * a % 40)
    return o.select(
        "py", "px", "label",
        channel(7, 90, 205).cast("int").alias("r"), channel(11, 60, 190).cast("int").alias("g"),
        channel(13, 110, 200).cast("int").alias("b"),
    )


def _channel(a: int, m: int, base: int) -> str:
    return f"CAST(CASE WHEN k % 97 = 0 THEN 0 WHEN label > 0 THEN 40 + k * {a} % {m} ELSE {base} + k * {a} % 40 END AS INT)"


PIX = f"""pix AS (
  SELECT py, px, label, {_channel(7, 90, 205)} AS r, {_channel(11, 60, 190)} AS g, {_channel(13, 110, 200)} AS b
  FROM (SELECT *, CAST(CASE WHEN (px % 25 - 12) * (px % 25 - 12) + (py % 25 - 12) * (py % 25 - 12)
                                 <= 36 + 20 * ((py // 25 + px // 25) % 3)
                            THEN py // 25 * 5 + px // 25 + 2 ELSE 0 END AS INT) AS label
        FROM (SELECT o_orderkey AS k, CAST(o_orderkey // {PIX_WIDTH} AS INT) AS py,
                     CAST(o_orderkey % {PIX_WIDTH} AS INT) AS px FROM orders)))"""


def positions(nuc: DataFrame) -> DataFrame:
    """Distinct positions of each image; a position keeps its least nid."""
    return nuc.groupBy("image_id", "x", "y").agg(F.min("nid").alias("nid"), F.min("area").alias("area"))


def graph_points(nuc: DataFrame) -> DataFrame:
    return nuc.select("image_id", "nid", "x", "y", "area")


GRAPH = "pts AS (SELECT image_id, nid, x, y, area FROM nuc)"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate rows of scenes: orders of customers under parameters derived from the order key."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("project"),
        F.col("o_custkey").alias("scene_id"),
        F.col("o_orderkey").alias("aggregate_id"),
        F.element_at(F.array(F.lit(0.0101), F.lit(0.0202), F.lit(0.0284)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("dtfe_threshold"),
        F.lit(50).alias("edge_range"),
        F.element_at(F.array(F.lit(10), F.lit(30), F.lit(50)), (F.expr("o_orderkey div 3") % 3 + 1).cast("int")).alias("min_nuclei"),
        (F.col("o_orderkey") % 211 + 10).alias("num_nuclei"),
        (F.col("o_orderkey") * 37 % 5000 + 100).alias("nuclei_area"),
        (F.col("o_orderkey") * 41 % 9000 + 5100).alias("convex_area"),
        (F.col("o_orderkey") * 17 % 300 + 20).alias("major_axis"),
        (F.col("o_orderkey") * 19 % 150 + 10).alias("minor_axis"),
        (F.col("o_orderkey") % 7 == 0).cast("int").alias("y"),
    )


COHORT = """cohort AS (
  SELECT c_mktsegment AS project, o_custkey AS scene_id, o_orderkey AS aggregate_id,
         [0.0101::DOUBLE, 0.0202::DOUBLE, 0.0284::DOUBLE][o_orderkey % 3 + 1] AS dtfe_threshold, 50 AS edge_range,
         [10, 30, 50][o_orderkey // 3 % 3 + 1] AS min_nuclei, o_orderkey % 211 + 10 AS num_nuclei,
         o_orderkey * 37 % 5000 + 100 AS nuclei_area, o_orderkey * 41 % 9000 + 5100 AS convex_area,
         o_orderkey * 17 % 300 + 20 AS major_axis, o_orderkey * 19 % 150 + 10 AS minor_axis,
         CAST(o_orderkey % 7 = 0 AS INT) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
