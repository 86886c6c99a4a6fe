"""Corpus pipeline: quality, near duplicates, decontamination, mixing and shards of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. Stages work on every row that their predecessor kept; all but the last return the columns of docs.
Rows that share a doc_id, or have none, are documents of their own in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import decontaminate, mixing, ngram_join, quality_model, sharding
from pointweave.llm.common import broadcast_if_small, fresh, materialize, table

#: Words of a shingle and least similarity in percent of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Doc ids to drop that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for good ones."""
    return quality_model.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram join: that of the least doc_id, then of the least hash of its text.

    Rows of one component may share a doc_id or have none; they are told apart by the hash of their text, and rows alike
    in both are one document.
    """
    joined = materialize(ngram_join.ngram_components(docs, NEAR_WORDS, NEAR_PERCENT).where("component IS NOT NULL"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = joined.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    group = joined.join(best, "component")
    text_key = fresh("_text_key", docs)
    keyed = docs.withColumn(text_key, F.xxhash64("text"))

    def listed(df, ids, how):
        few = broadcast_if_small(materialize(ids), BROADCAST_IDS)
        return df.join(few, (df[text_key] == few["_key"]) & df["doc_id"].eqNullSafe(few["_id"]), how)

    named = F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    kept = listed(keyed, group.where(place != F.col("best")).select(*named).distinct(), "left_anti")
    # rows of one doc_id and one text: all but one go
    twice = materialize(joined.groupBy(*named).count().where("count > 1").select("_id", "_key"))
    if twice.isEmpty():
        return kept.select(*docs.columns)
    one = listed(kept, twice, "left_semi").dropDuplicates(["doc_id", text_key])
    return listed(kept, twice, "left_anti").unionAll(one).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, as it is or re-parameterised.

    Each row is judged by its own text: rows are told apart by a hash of doc_id and text, so a clean row stays whatever
    its doc_id, and a row without one goes if it holds an item. Null and empty texts hold none.
    """
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.contaminated(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = broadcast_if_small(materialize(found.select(F.col("doc_id").alias("_gone")).distinct()), BROADCAST_IDS)
    return docs.join(gone, row == gone["_gone"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken in part counts from half of its words."""
    names = {c: fresh(f"_given_{c}", docs) for c in docs.columns if c.lower() in mixing.RESULTS}
    given = docs.withColumnsRenamed(names)
    mixed = mixing.mix(given, mixing.word_count(F.col("text")))
    return mixing.repeat_rows(mixed, given.columns).toDF(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every repetition: doc_id, size, text_crc32, shard, slot."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: No SQL expresses the quality network; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
