"""Queries on slide metadata, names and parameter texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .sources import adapters as ad
from .sources import metadata
from .sources.storage import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _ome(spark, d):
    """A document for each supplier: two objectives, two scenes of two levels; every fifth lacks the last image's plane."""
    image = """concat('<Image Name="s', s_suppkey, '_', i, '"><ObjectiveSettings ID="Objective:', s_suppkey % 2, '"/><Pixels SizeX="',
      (40000 + s_suppkey % 100) div (1 + 3 * (i % 2)), '" SizeY="3000" SizeZ="1" SizeC="3" SizeT="1" PhysicalSizeX="0.5" PhysicalSizeY="0.5">',
      if(i = 3 AND s_suppkey % 5 = 0, '', concat('<Plane PositionX="', i div 2 * 10.5D, '" PositionY="7.25"/>')), '</Pixels></Image>')"""
    xml = f"""concat('<OME xmlns="ome"><Instrument><Objective ID="Objective:0" NominalMagnification="20.0"/>',
      '<Objective ID="Objective:1" NominalMagnification="40.0"/></Instrument>', array_join(transform(sequence(0, 3), i -> {image}), ''), '</OME>')"""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.expr(xml).alias("xml"))


@query("""WITH i AS (SELECT s_suppkey AS k, CAST(i AS INT) AS i FROM supplier, range(4) r(i) WHERE i < 3 OR s_suppkey % 5 <> 0)
  SELECT k AS image_id, i // 2 AS scene, i % 2 AS level, i AS idx, 's' || k || '_' || i AS name, (40000 + k % 100) // (1 + 3 * (i % 2)) AS size_x,
    round((20 + 20 * (k % 2)) * ((40000 + k % 100) // (1 + 3 * (i % 2)))::DOUBLE / (40000 + k % 100), 6) AS magnification FROM i""")
def pyramid_stacks(spark, d):
    out = metadata.pyramid_stacks(metadata.ome_images(_ome(spark, d)))
    return out.select("image_id", "scene", "level", "idx", "name", "size_x", F.round("magnification", 6).alias("magnification"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS feature FROM part")
def literal_lists(spark, d):
    text = F.concat(F.lit("['"), F.regexp_replace("p_name", " ", "', '"), F.lit("']"))
    return table(spark, d, "part").select("p_partkey", F.explode(metadata.literal_list(text)).alias("feature"))


@query("SELECT page_id, 'scene__R' || page_id % 17 || '_C' || page_id % 40 || '_TS1024_OL0.jpg' AS name FROM pages")
def swapped_tile_names(spark, d):
    name = F.concat(F.lit("scene__R"), F.col("page_id") % 40, F.lit("_C"), F.col("page_id") % 17, F.lit("_TS1024_OL0.jpg"))
    return table(spark, d, "pages").select("page_id", metadata.swapped_tile_name(name).alias("name"))


@query("SELECT path FROM (SELECT url || '#' || page_id AS path FROM pages) ORDER BY path LIMIT 20")
def first_files(spark, d):
    files = table(spark, d, "pages").select(F.concat("url", F.lit("#"), "page_id").alias("path"))
    return metadata.first_files(files, 20)


@query(f"WITH {ad.PIX} SELECT label, string_agg(py || ':' || px, ',' ORDER BY py, px) AS pixels FROM pix WHERE label > 0 GROUP BY 1")
def pixels_of_labels(spark, d):
    place = lambda p: F.concat_ws(":", p["py"], p["px"])
    return metadata.pixels_of_labels(ad.pixels(spark, d)).select("label", F.array_join(F.transform("pixels", place), ",").alias("pixels"))
