"""Tables in, intermediate tables out."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back; a folder of this machine serves a local session only."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "pointweave-shared")
    path = f"{base.rstrip('/')}/pointweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def release(*written: DataFrame | None) -> None:
    """Remove tables that materialize wrote; nothing may read them afterwards."""
    for df in written:
        if df is not None:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint where df (already written) has at most max_rows rows, else one for a shuffled join: files that
    compress well look small to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number means missing: max, avg and joins must not see it as a value."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV table with header and a stated schema; columns that must keep their digits are declared as strings."""
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue="", nanValue="nan"))


def read_binary_tiles(spark: SparkSession, path: str, decode, pattern: str = "*") -> DataFrame:
    """(name, y, x, r, g, b) of image files; decode(bytes) -> height x width x 3 array runs inside tasks.

    No codec is part of this library: decode is the caller's.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches):
        import numpy as np

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                a = decode(content)
                y, x = np.indices(a.shape[:2])
                yield pd.DataFrame(
                    {"name": name, "y": y.ravel(), "x": x.ravel(), "r": a[..., 0].ravel(), "g": a[..., 1].ravel(),
                     "b": a[..., 2].ravel()}
                )

    return files.mapInPandas(run, "name string, y int, x int, r short, g short, b short")


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """Job records from a log of columns separated by runs of blanks; lines without a number in front are headers."""
    lines = spark.read.text(path).select(F.split(F.regexp_replace(F.trim("value"), " +", " "), " ").alias("v"))
    return lines.where(F.get("v", F.lit(0)).rlike("^[0-9]")).select(
        *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("job_id", "job_name", "exit_code", "state", "time", "memory"))]
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("line"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, ring) of the polygons of GeoJSON documents: the outer ring as points x, y."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs.select(F.posexplode("features").alias("feature", "f")).select(
        "feature",
        F.transform(
            F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
        ).alias("ring"),
    )


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Results by mode and parameters, one folder for each value."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def closed_ring(ring):
    """A ring that ends in its first point."""
    return F.concat(ring, F.slice(ring, 1, 1))


def geojson_feature(ring, **properties):
    """A GeoJSON polygon feature as text."""
    points = F.transform(closed_ring(ring), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            geometry.alias("geometry"),
            F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"),
        )
    )
