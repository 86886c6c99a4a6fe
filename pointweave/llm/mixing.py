"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize, table

#: Weights of the sources in the order of their names, repeated as often as needed.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Columns that mix adds.
RESULTS = ("size", "source_size", "target", "repeats", "extra")
SEED = "mix-1"
#: Hex digits of the seeded hash that make a bucket of a source: 4096 buckets each.
BUCKET_DIGITS = 3
#: Sources up to which the table of quotas is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_quotas(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size): target, the words the mix takes of each source.

    Water-filling: the shares of all words by weight, no source above max_epochs times its size, the excess
    shared by weight among the rest until none is above. In the order of cap by weight the clamped sources are a
    prefix, so one running sum over the sources (never over documents) finds the fixed point of the rounds.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    caps = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    clamped = F.col("cap") * F.col("weight_left") <= F.col("words_left") * F.col("weight")
    return (
        caps.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("words_left", F.col("all_words") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("clamped", clamped)
        .withColumn("free_words", F.col("all_words") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("free_weight", F.sum(F.when(~F.col("clamped"), F.col("weight")).otherwise(0)).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("clamped"), F.col("cap").cast("double"))
            .otherwise(F.try_divide(F.col("weight") * F.col("free_words"), F.col("free_weight")))
            .alias("target"),
        )
    )


def mix(docs: DataFrame, size, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, repeats (whole repetitions) and extra (words of one partial repetition).

    A source's target is so many whole repetitions of it and a rest; the rest goes to documents in the order of a
    seeded hash of doc_id, the last of them in part, so a source's words equal its target to the word and reruns
    agree. To find that last document without one task seeing a whole source, sizes are summed by hash bucket and
    only the rows of the one bucket where the rest ends are put in order. Null sources are a source of their own;
    null texts and documents without words take nothing. Extra columns are kept, but those called like a result give
    way to it; names starting with _mix are reserved. Rows of equal doc_id and size are interchangeable.
    """
    docs = docs.withColumn("_mix_size", size).drop(*RESULTS)
    given = [c for c in docs.columns if c != "_mix_size"]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = (
        docs.withColumnRenamed("_mix_size", "size")
        .withColumn("_mix_key", key)
        .withColumn("_mix_bucket", F.substring("_mix_key", 1, BUCKET_DIGITS))
    )
    buckets = materialize(rows.groupBy("source", "_mix_bucket").agg(F.sum("size").alias("words")))
    quotas = source_quotas(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    quotas = (
        quotas.withColumn("_mix_words", F.round("target").cast("long"))
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.expr("_mix_words div source_size")).otherwise(0))
        .withColumn("_mix_rest", F.col("_mix_words") - F.col("repeats") * F.col("source_size"))
    )
    running = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        buckets.withColumn("upto", F.sum("words").over(running))
        .join(
            quotas.select(F.col("source").alias("_s"), "_mix_rest"), F.col("source").eqNullSafe(F.col("_s"))
        )
        .where((F.col("upto") > F.col("_mix_rest")) & (F.col("upto") - F.col("words") <= F.col("_mix_rest")))
        .select(F.col("source").alias("_e"), F.col("_mix_bucket").alias("_mix_end"),
                (F.col("_mix_rest") - F.col("upto") + F.col("words")).alias("_mix_in_end"))
    )
    plan = materialize(
        quotas.join(ends, F.col("source").eqNullSafe(F.col("_e")), "left").select(
            F.col("source").alias("_mix_source"), "source_size", "target", "repeats", "_mix_end", "_mix_in_end"
        )
    )
    placed = rows.join(
        broadcast_if_small(plan, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_mix_source"))
    )
    columns = [*given, *RESULTS]
    last = F.col("_mix_bucket") == F.col("_mix_end")
    sure = placed.where(F.coalesce(~last, F.lit(True))).withColumn(
        "extra", F.when(F.col("_mix_bucket") < F.col("_mix_end"), F.col("size")).otherwise(0)
    )
    order = Window.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = placed.where(last).withColumn(
        "extra", F.least(F.col("size"), F.greatest(F.col("_mix_in_end") - before, F.lit(0)))
    )
    return sure.select(*columns).unionByName(split.select(*columns))


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each repetition of a document; a partial repetition counts from half of its words."""
    copies = F.col("repeats") + F.when(F.col("extra") * 2 >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0)
    return mixed.withColumn("_mix_copies", F.array_repeat(F.lit(0), copies.cast("int"))).select(
        *columns, F.explode("_mix_copies").alias("_mix_copy")
    ).drop("_mix_copy")


def op4_mix_sources(spark, sf_dir) -> DataFrame:
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n")))
    return mix(docs, F.col("n")).select(
        "doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("extra")).alias("taken")
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
  FROM d GROUP BY source
), c AS (
  SELECT *, [5, 2, 1][r % 3 + 1] AS w, source_size * {MAX_EPOCHS} AS cap FROM s
), p AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS words_left,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight_left, sum(source_size) OVER () AS all_words
  FROM c WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), q AS (
  SELECT *, cap * weight_left <= words_left * w AS clamped FROM p
), t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (all_words - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM q
), u AS (
  SELECT *, CAST(round(target) AS BIGINT) AS words FROM t
), o AS (
  SELECT d.doc_id, d.size, u.source_size, u.target,
         CASE WHEN u.source_size > 0 THEN u.words // u.source_size ELSE 0 END AS repeats, u.words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       CAST(repeats * size + least(size, greatest(words - repeats * source_size - before, 0)) AS BIGINT) AS taken
FROM o
"""
