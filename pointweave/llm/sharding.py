"""Contiguous shards of near-equal bytes from a distributed prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table

#: Bytes that a record takes besides its text.
RECORD_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs.

    Rows are put in the order of (doc_id, crc, size), nulls first, over range partitions; the bytes of each
    partition are summed, a running sum over those few totals gives each partition its offset, and a row's shard
    is where its first byte falls among n_shards equal cuts of all bytes. Only the partition totals (as many rows
    as partitions) meet in one place. Null texts have no bytes and crc 0. Rows alike in all three order columns
    are interchangeable. An empty table gives no rows; a shard may stay empty where one document is larger than
    a cut. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    parts = shuffle_partitions(spark)
    ranged = materialize(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        # one row for each range partition, so never more than `parts` rows
        ranged.join(F.broadcast(offsets), "part")
        .withColumn(
            "first_byte",
            F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
        )
        .withColumn("row_no", F.col("rows_before") + F.row_number().over(within) - 1)
        .withColumn(
            "shard",
            F.least(F.expr(f"first_byte * {n_shards} div all_bytes"), F.lit(n_shards - 1)).cast("int"),
        )
        .select("doc_id", "size", "text_crc32", "shard", "row_no")
    )
    placed = materialize(placed)
    starts = placed.groupBy("shard").agg(F.min("row_no").alias("shard_start"))
    # one row for each shard, so never more than n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("shard_start")).alias("slot")
    )


def op5_byte_shards(spark, sf_dir) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 in SQL: its 256-entry table from the reversed polynomial 0xEDB88320, then a fold over the bytes.
SQL = """
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), tab AS (
  SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(h, '..')]),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, tab
), p AS (
  SELECT doc_id, size, text_crc32,
         sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS first_byte,
         sum(size) OVER () AS all_bytes
  FROM c
), s AS (
  SELECT *, least(CAST(first_byte * 24 // all_bytes AS BIGINT), 23) AS shard FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law,
       CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
       CAST(NULL AS INT) AS grown_shard
FROM s
"""
