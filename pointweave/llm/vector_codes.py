"""Vector compression by product quantisation in integers; nearest entries are found through a VA-file."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, release, table

#: Fixed values of the contract.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of a cell number: entries' coordinates fall into 2^BITS cells in each dimension.
BITS = 3
#: Lookup cells that a task fills at once.
BLOCK_CELLS = 1 << 19
#: Labels that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


class CellFile:
    """The entries (k x d integers) of one codebook, with the cell of each coordinate.

    In each dimension the sorted coordinates are cut into cells of near equal numbers of entries; a cell's borders are
    its least and greatest coordinate.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        k, d = entries.shape
        cells = min(1 << bits, k)
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((k, d), np.int64)
        np.put_along_axis(self.cell, order, np.broadcast_to((np.arange(k) * cells // k)[:, None], (k, d)), 0)
        self.low, self.high = np.empty((cells, d), np.int64), np.empty((cells, d), np.int64)
        for c in range(cells):
            inside = self.cell == c
            self.low[c] = np.where(inside, entries, np.iinfo(np.int64).max).min(0)
            self.high[c] = np.where(inside, entries, np.iinfo(np.int64).min).max(0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (n x k) of the squared distances of queries (n x d), from one lookup table for each query."""
        n, d = q.shape
        below, above = self.low[None] - q[:, None, :], q[:, None, :] - self.high[None]
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        lower, upper = np.zeros((n, len(self.entries)), np.int64), np.zeros((n, len(self.entries)), np.int64)
        least *= least
        most *= most
        for j in range(d):
            lower += least[:, self.cell[:, j], j]
            upper += most[:, self.cell[:, j], j]
        return lower, upper

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, ties to the lower index.

        Only entries whose lower bound does not exceed the least upper bound are measured.
        """
        lower, upper = self.bounds(q)
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        gap = q[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = (gap * gap).sum(1)
        best = exact.argmin(1)
        return best, exact[np.arange(len(q)), best]


def component_limit(dims: int) -> int:
    """Greatest integer component for which every squared distance of dims components fits 63 bits."""
    return math.isqrt((2**63 - 1) // max(dims, 1)) // 2


def integer_vectors(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of the components of kept vectors, padded with zeros to dims."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit = component_limit(dims)
    whole = np.clip(np.floor(flat * SCALE), -limit, limit).astype(np.int64)
    lengths = np.diff(vectors.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    if n and (lengths == dims).all():
        return whole.reshape(n, dims)
    out = np.zeros((n, dims), np.int64)
    out[np.arange(dims)[None] < lengths[:, None]] = whole
    return out


def assign(vectors: np.ndarray, books: list[CellFile]) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (n x parts) and its squared distance."""
    n, width = len(vectors), books[0].entries.shape[1]
    codes, errors = np.empty((n, len(books)), np.int64), np.empty((n, len(books)), np.int64)
    step = max(1, BLOCK_CELLS // max(1, width * len(books[0].low)))
    for p, book in enumerate(books):
        for a in range(0, n, step):
            codes[a : a + step, p], errors[a : a + step, p] = book.nearest(vectors[a : a + step, p * width : (p + 1) * width])
    return codes, errors


def kept_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds neither null nor non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col), odd))


def round_sums(kept: DataFrame, books: list[np.ndarray], dims: int) -> list:
    """(part, entry, rows, sums) of the parts that each entry gets: one row for each entry and task, then summed."""
    files = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        held = [CellFile(b) for b in files.value]
        k, width = files.value[0].shape
        rows, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), np.int64)
        for batch in batches:
            vectors = integer_vectors(batch.column(0), dims)
            codes, _ = assign(vectors, held)
            for p in range(PARTS):
                rows[p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(sums[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(rows[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "rows", "sums"],
        )

    met = kept.select("_vector").mapInArrow(run, "part long, entry long, rows long, sums array<long>")
    width = dims // PARTS
    total = met.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    found = total.collect()  # at most PARTS x ENTRIES rows
    files.unpersist()
    return found


def fit_codebooks(kept: DataFrame, dims: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks (entries x dims / PARTS integers) of each part, after so many rounds of assignment and floored means.

    kept: _id, _vector. They start as the parts of the least ids, nulls after all others, ties by the vectors. Fewer rows
    than entries make as many entries. A round passes the table once and brings PARTS x entries sums to the driver.
    """
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).toArrow()
    start = integer_vectors(first.column("_vector"), dims)
    books = [start[:, p * dims // PARTS : (p + 1) * dims // PARTS].copy() for p in range(PARTS)]
    for _ in range(rounds if len(start) else 0):
        for r in round_sums(kept, books, dims):
            books[r["part"]][r["entry"]] = [r[f"s{j}"] // r["rows"] for j in range(dims // PARTS)]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
    """(rows, codebooks): vec_id, label, code and error of each kept row, and the codebooks that code it.

    code: the entry of each part as two hexadecimal digits; error: the squared distances to these entries, summed.
    Rows whose vector is null or holds null or non-finite components are left out. Shorter vectors are padded with zeros
    to the longest one, and that to a multiple of PARTS; components beyond component_limit count as that limit, since no
    squared distance of theirs fits a long. Rows of one id, or without one, are rows of their own. A table without kept
    rows gives no rows and empty codebooks. Other columns are ignored. Assignment works through CellFile in Arrow
    batches; nothing but sums and codebooks leaves a task before the last pass.
    """
    kept = kept_vectors(df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"), F.col(label_col).alias("_label")), "_vector")
    longest = kept.agg(F.max(F.size("_vector"))).first()[0] or 0
    dims = max(PARTS, -(-longest // PARTS) * PARTS)
    books = fit_codebooks(kept, dims)
    files = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        held = [CellFile(b) for b in files.value] if len(files.value[0]) else []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = assign(integer_vectors(batch.column(2), dims), held)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text), pa.array(errors.sum(1))], names=["vec_id", "label", "code", "error"]
            )

    kinds = dict(kept.dtypes)
    schema = f"vec_id {kinds['_id']}, label {kinds['_label']}, code string, error long"
    return kept.select("_id", "_label", "_vector").mapInArrow(run, schema), books


def op12_vector_codes(spark, sf_dir) -> DataFrame:
    coded, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    coded = materialize(coded)
    sums = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    met = coded.join(broadcast_if_small(sums, BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    floored = lambda s, n: f"({s} - (({s} % {n}) + {n}) % {n}) // {n}"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (
  SELECT v.rn, v.part, e.entry, sum((v.x - e.x) * (v.x - e.x)) AS d FROM v JOIN b{k} e USING (part, pos) GROUP BY ALL
), a{k} AS MATERIALIZED (
  SELECT rn, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM d{k} GROUP BY ALL
)""")
        if k < ROUNDS:
            steps.append(f"""
s{k} AS (
  SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{k} USING (rn, part) GROUP BY ALL
), b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE {floored("s", "n")} END AS x FROM b{k} LEFT JOIN s{k} USING (part, entry, pos)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rn, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), one AS (
  SELECT rn, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x,
         len(embedding) // {PARTS} AS width FROM kept
), v AS MATERIALIZED (
  SELECT rn, i // width AS part, i % width AS pos, x FROM one
), b0 AS MATERIALIZED (
  SELECT part, rn - 1 AS entry, pos, x FROM v WHERE rn <= {ENTRIES}
), {", ".join(steps)}, digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM b{ROUNDS}
), coded AS (
  SELECT rn, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY rn
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (rn), digest
"""


SQL = _sql()
