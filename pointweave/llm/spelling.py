"""Spelling variants: words one inserted, deleted or replaced letter apart, found by generating whole neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_partitions, table
from .tokens import mix64

#: Letters of a word: every code point is one byte of ISO 8859-1.
RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, TIMES = 5, 3, 2
#: One run in so many, by its checksum, loses a letter.
DAMAGE = 97
#: Bits of the vocabulary's filter for each word, and its greatest size.
WORD_BITS, FILTER_BYTES = 32, 1 << 26
#: Neighbours, or bytes of them, that a task makes at once.
BLOCK_CELLS = 1 << 19
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = "ISO-8859-1"


def damaged(runs: DataFrame) -> DataFrame:
    """(word) of runs (doc_id, run): run without its letter h % length where DAMAGE divides h, the crc32 of <doc_id>:<run>.

    A null doc_id is empty.
    """
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    hashed = runs.select("run", F.crc32(text.cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of doc_id and text with at least so many letters and occurrences, counted over all texts."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length)
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    return damaged(runs.select("doc_id", lowered.alias("run"))).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def observed_alphabet(words: DataFrame) -> bytes:
    """The letters of words (word binary), in order; at most 256 rows reach the driver."""
    letters = words.select(F.explode(F.split(F.decode("word", _BYTES), "")).alias("c")).where("c <> ''").distinct()
    return bytes(sorted(ord(r["c"]) for r in letters.collect()))


def filter_blocks(words: int) -> int:
    """Blocks of 64 bits of the filter for so many words: a power of two within FILTER_BYTES."""
    return 1 << min(max(words * WORD_BITS // 64, 1).bit_length(), FILTER_BYTES.bit_length() - 4)


def letter_keys(start: int, stop: int, alphabet: np.ndarray) -> np.ndarray:
    """A 64-bit number for each letter of alphabet at each place from start to stop; a word's hash is the xor of its own."""
    place = np.arange(start, stop, dtype=np.uint64)[:, None] << np.uint64(8)
    return mix64(mix64(place | alphabet[None].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


def filter_bits(h: np.ndarray) -> np.ndarray:
    """Four bits of a block that a hash sets and asks for."""
    one, out = np.uint64(1), np.uint64(0)
    for shift in (40, 46, 52, 58):
        out = out | (one << ((h >> np.uint64(shift)) & np.uint64(63)))
    return out


def word_filter(words: DataFrame, alphabet: bytes) -> np.ndarray:
    """A bitmap that holds every word (word binary): one block is set for each, and what is not in it is no word.

    The blocks are merged by Spark; at most FILTER_BYTES reach the driver and each task. A filter that more words fill
    lets more others pass, which the join drops.
    """
    blocks = filter_blocks(words.count())

    def run(batches):
        letters = np.frombuffer(alphabet, np.uint8)
        for batch in batches:
            for block, _ in by_length(batch.column(0).to_pylist()):
                at = np.searchsorted(letters, block)
                h = np.bitwise_xor.reduce(letter_keys(0, block.shape[1], letters)[np.arange(block.shape[1]), at], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64(blocks - 1)).view(np.int64)), pa.array(filter_bits(h).view(np.int64))], names=["block", "bits"])

    merged = words.select("word").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[merged.column("block").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    return out


def by_length(words: list[bytes], cells: int = 1) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes of n equally long words, their length); a block takes BLOCK_CELLS where a letter takes so many."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        same = np.frombuffer(b"".join(w for w in words if len(w) == length), np.uint8).reshape(-1, length)
        step = max(1, BLOCK_CELLS // ((length + 1) * max(cells, 1)))
        for a in range(0, len(same), step):
            yield same[a : a + step], length


def neighbours(words: np.ndarray, alphabet: np.ndarray, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, neighbour) arrays of all distinct deletions, replacements and insertions of words (n x length bytes).

    alphabet is sorted and holds the words' letters. Of equal results one is made: a letter is deleted at the first place
    of a run of it and inserted before such a run. known: a filter; what it does not hold is not spelled out. Hashes
    come from those of the letters before and behind an edit, so only what passes is written as bytes.
    """
    n, length = words.shape
    letter = np.searchsorted(alphabet, words)
    here = np.arange(length)
    keys = letter_keys(0, length + 1, alphabet)

    def behind(shift):
        """xor of the keys of the letters from each place on, moved by shift places."""
        moved = np.zeros((n, length + 1), np.uint64)
        # the first letter never moves down
        moved[:, :length] = keys[np.maximum(here + shift, 0), letter]
        return np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1]

    before = np.zeros((n, length + 1), np.uint64)
    np.bitwise_xor.accumulate(keys[here, letter], axis=1, out=before[:, 1:])

    def passed(h):
        if known is None:
            return True
        bits = filter_bits(h)
        return (known[(h & np.uint64(len(known) - 1)).astype(np.int64)] & bits) == bits

    def spelled(row, make, size):
        step = max(1, BLOCK_CELLS // max(size, 1))
        for a in range(0, len(row), step):
            cut = slice(a, a + step)
            yield row[cut], make(words[row[cut]], cut)

    first = np.ones((n, length), bool)
    first[:, 1:] = words[:, 1:] != words[:, :-1]
    row, at = np.nonzero(first & passed(before[:, :-1] ^ behind(-1)[:, 1:]))
    out = np.arange(length - 1)
    yield from spelled(row, lambda w, cut: np.take_along_axis(w, out + (out >= at[cut, None]), 1), length)

    kept, later = before[:, :-1] ^ behind(0)[:, 1:], before ^ behind(1)
    step = max(1, BLOCK_CELLS // max(n * len(alphabet), 1))
    for a in range(0, length, step):
        b = min(a + step, length)
        other = letter[:, a:b, None] != np.arange(len(alphabet))
        row, at, c = np.nonzero(other & passed(kept[:, a:b, None] ^ keys[None, a:b]))

        def replaced(w, cut, at=at + a, c=c):
            w[np.arange(len(w)), at[cut]] = alphabet[c[cut]]
            return w

        yield from spelled(row, replaced, length)
    for a in range(0, length + 1, step):
        b = min(a + step, length + 1)
        other = np.ones((n, b - a, len(alphabet)), bool)
        other[:, max(1 - a, 0) :] = letter[:, max(a - 1, 0) : b - 1, None] != np.arange(len(alphabet))
        row, at, c = np.nonzero(other & passed(later[:, a:b, None] ^ keys[None, a:b]))
        out = np.arange(length + 1)

        def inserted(w, cut, at=at + a, c=c, out=out):
            w = np.take_along_axis(w, np.minimum(out - (out > at[cut, None]), length - 1), 1)
            w[np.arange(len(w)), at[cut]] = alphabet[c[cut]]
            return w

        yield from spelled(row, inserted, length + 1)


def emit_neighbours(words: DataFrame, alphabet: bytes, known: np.ndarray) -> DataFrame:
    """(word, near): the neighbourhood of each word (word binary) as far as the filter known holds it."""
    sent = words.sparkSession.sparkContext.broadcast(known)

    def binary(a: np.ndarray) -> pa.Array:
        n, length = a.shape
        ends = np.arange(n + 1, dtype=np.int32) * np.int32(length)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(a))])

    def run(batches):
        letters = np.frombuffer(alphabet, np.uint8)
        for batch in batches:
            for block, _ in by_length(batch.column(0).to_pylist(), len(letters)):
                for row, near in neighbours(block, letters, sent.value):
                    yield pa.RecordBatch.from_arrays([binary(block[row]), binary(near)], names=["word", "near"])

    return words.select("word").mapInArrow(run, "word binary, near binary")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of different words of words (word binary, n) that are one edit apart.

    What is emitted and in the vocabulary is near, so no distance is computed. Before neighbours are joined by hash to the
    vocabulary, a filter of it drops nearly all that are no words.
    """
    alphabet = observed_alphabet(words)
    # words are few bytes and make a thousand times as many: deal them over all tasks
    dealt = words.select("word").repartition(shuffle_partitions(words.sparkSession), "word")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return emit_neighbours(dealt, alphabet, word_filter(words, alphabet)).join(known, "near").select("word", "near", "near_n")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word of forms (word, form), by doubling the way in each round.

    A form is TIMES as frequent as its word, so ways are short and without cycles.
    """
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(ways)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        ways = moved


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (doc_id, text); see vocabulary.

    n_near counts the words one edit apart; form is the most frequent of them, ties to the smallest, if it is at least
    times as frequent as the word, else null with form_n; root follows forms to the last, the word itself without form.
    Null and empty texts have no words, a null doc_id damages as an empty one, rows of one doc_id are texts of their own,
    and a table without words gives no rows. Other columns are ignored. Texts count whole, whatever their length.
    """
    words = materialize(vocabulary(docs.select("doc_id", "text"), min_length, min_count).select(F.encode("word", _BYTES).alias("word"), "n"))
    # bytes stand in the order of code points; negated counts put the most frequent first
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    met = words.join(near, "word", "left").withColumn("form_n", -F.col("best.m"))
    strong = F.col("form_n") >= times * F.col("n")
    found = materialize(
        met.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"),
        )
    )
    roots = follow_forms(found.where("form IS NOT NULL"))
    text = lambda c: F.decode(F.col(c), _BYTES).alias(c)
    out = found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select(text("word"), text("form"), text("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Letters beyond ASCII as other single bytes, so that the edit distance counts code points.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN = "".join(chr(c) for c in range(32, 97) if chr(c) != "'")

SQL = rf"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), tab AS (
  SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), r AS MATERIALIZED (
  SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY 1, 2
), c AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(hex(encode(concat(doc_id, ':', run))), '..')]),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM r, tab
), w AS MATERIALIZED (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[:CAST(h % length(run) AS INT)] || run[CAST(h % length(run) AS INT) + 2:] ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM c GROUP BY 1 HAVING length(word) >= {MIN_LENGTH} AND sum(n) >= {MIN_COUNT}
), v AS MATERIALIZED (
  SELECT word, n, length(word) AS l, translate(word, '{_WIDE}', '{_PLAIN}') AS p FROM w
), near AS (
  SELECT a.word, count(*) AS n_near, max(b.n) AS top, first(b.word ORDER BY b.n DESC, encode(b.word)) AS best
  FROM v a JOIN v b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND a.word <> b.word AND levenshtein(a.p, b.p) = 1 GROUP BY 1
), found AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {TIMES} * n THEN best END AS form, CASE WHEN top >= {TIMES} * n THEN top END AS form_n
  FROM v LEFT JOIN near USING (word)
), way(word, root, k) AS (
  SELECT word, word, 0 FROM found
  UNION ALL
  SELECT way.word, form, k + 1 FROM way JOIN found ON found.word = way.root WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM found JOIN (SELECT word, arg_max(root, k) AS root FROM way GROUP BY 1) USING (word)
"""
