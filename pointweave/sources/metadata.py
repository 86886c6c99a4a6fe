"""Slide metadata: OME-XML documents, pyramid stacks, parameter documents and names of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PIXELS = """struct<_SizeX: long, _SizeY: long, _SizeZ: long, _SizeC: long, _SizeT: long, _PhysicalSizeX: double, _PhysicalSizeY: double,
  Plane: array<struct<_PositionX: double, _PositionY: double>>>"""
_OME = f"""Instrument array<struct<Objective: array<struct<_ID: string, _NominalMagnification: double>>>>,
  Image array<struct<_Name: string, ObjectiveSettings: struct<_ID: string>, Pixels: {_PIXELS}>>"""


def ome_images(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Images of OME-XML documents (image_id, xml): image_id, idx, name, magnification, sizes, pixel sizes and position.

    idx is the image's place in its document, from 0. An image without objective, size, pixel size or plane is left out;
    so are null texts and those that are no XML. Of several planes the first counts, of equal objectives the last.
    """
    read = documents.select("image_id", F.from_xml(xml, _OME, {"mode": "PERMISSIVE"}).alias("d"))
    objectives = F.reverse(F.flatten(F.transform(F.coalesce("d.Instrument", F.array()), lambda i: i["Objective"])))
    each = read.select("image_id", objectives.alias("objectives"), F.posexplode("d.Image").alias("idx", "i"))
    own = F.get(F.filter("objectives", lambda o: o["_ID"] == F.col("i.ObjectiveSettings._ID")), F.lit(0))
    plane = F.get("i.Pixels.Plane", F.lit(0))
    sizes = [F.col(f"i.Pixels._Size{c}").alias(f"size_{c.lower()}") for c in "XYZCT"]
    pixel = [F.col(f"i.Pixels._PhysicalSize{c}").alias(f"pixel_{c.lower()}") for c in "XY"]
    at = [plane[f"_Position{c}"].alias(f"position_{c.lower()}") for c in "XY"]
    out = each.select("image_id", "idx", F.col("i._Name").alias("name"), own["_NominalMagnification"].alias("magnification"), *sizes, *pixel, *at)
    return out.dropna()


def pyramid_stacks(images: DataFrame) -> DataFrame:
    """images with scene and level, from 0: images at one place of a slide are the levels of one scene, by idx.

    Scenes are numbered by their first image; a level's magnification follows from its width against the first's.
    """
    place = Window.partitionBy("image_id", "position_x", "position_y")
    ordered = place.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = images.withColumn("_first", F.min("idx").over(place)).withColumn("level", F.row_number().over(place.orderBy("idx")) - 1)
    first = lambda c: F.first(c).over(ordered)
    out = out.withColumn("magnification", first("magnification") * F.col("size_x") / first("size_x"))
    return out.withColumn("scene", F.dense_rank().over(Window.partitionBy("image_id").orderBy("_first")) - 1).drop("_first")


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a line; each line is YAML as well."""
    df.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metadata or parameter documents: JSON files of one object or an array each, or one object a line."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"), F.input_file_name().alias("file"))
    lines = F.when(F.col("value").startswith("["), F.array("value")).otherwise(F.split("value", r"(?<=\})\s*\n\s*(?=\{)"))
    return whole.select(F.explode(lines).alias("line")).select(F.explode(F.from_json("line", f"array<struct<{schema}>>")).alias("d")).select("d.*")


def literal_list(text: Column | str) -> Column:
    """The strings of a list written as text, in single or double quotes; null where the text is no list."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def swapped_tile_name(name: Column | str) -> Column:
    """A tile's name with the numbers of row and column exchanged."""
    return F.regexp_replace(name, "_R([0-9]+)_C([0-9]+)_", "_R$2_C$1_")


def first_files(files: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first n files by path."""
    return files.orderBy(path).limit(n)


def pixels_of_labels(mask: DataFrame) -> DataFrame:
    """(label, pixels): the places (py, px) of each object above 0 in reading order; an object is as large as a nucleus."""
    return mask.where("label > 0").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("py", "px"))).alias("pixels"))
