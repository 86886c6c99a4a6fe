"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import broadcast_if_small, materialize, release, table

__all__ = [
    "WORD", "WORD_GAP", "broadcast_if_small", "count_of", "fresh", "let", "materialize", "release", "sampled_labels", "shuffle_partitions",
    "table", "words",
]

#: Bytes that separate words: space and the ASCII controls 09 to 0D.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def count_of(text: Column, pattern: str) -> Column:
    """How many matches of a pattern a text has."""
    return F.regexp_count(text, F.lit(pattern))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled_labels(labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """(_id, _label) of at most so many labelled ids in a seeded order, without those whose crc32 mod 4 is 2."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return (
        labels.where(F.col(label).isNotNull() & learn)
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_label"))
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "_label")
        .limit(rows)
    )
