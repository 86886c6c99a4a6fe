"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers, units and names become typed placeholders, other words are lower-cased
and stripped of punctuation. Windows of template tokens of the benchmark are hash-joined with those of the documents,
and the values that fill the placeholders are compared: in a re-parameterised question each benchmark value stands for
one value of the document throughout, and only some of these may coincide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table
from .tokens import core_spans, hash_spans, lower, mix64, pieces, windows, word_spans

WINDOW = 8
#: Literal tokens that a window needs to match by its template alone, so that placeholders alone never match.
MIN_LITERALS = 5
#: Share of an item's windows that consistent matches must cover.
COVERAGE = 0.5
#: Least number of different document values as a share of the different benchmark values that they stand for.
AGREEING = 0.5
#: Benchmark windows that are held against the documents in one pass; a larger benchmark takes several.
BLOCK_WINDOWS = 1_000_000
BROADCAST_ROWS = 1_000_000

UNITS = (
    "mm cm m km mg g kg t ml l s ms min h hr hour hours minute minutes second seconds day days week weeks month months"
    " year years inch inches ft feet foot yard yards mile miles oz lb lbs pound pounds dollar dollars euro euros cent"
    " cents usd eur percent mph kmh degree degrees watt watts volt volts byte bytes kb mb gb tb"
).split()

_DIGIT, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[[ord(c) for c in ".!?:"]] = True
#: Template values of the placeholders.
NUMBER, UNIT, NAME = (np.uint64(k) for k in (1, 2, 3))
#: Kinds of window keys.
STRONG, EXACT, LOOSE, OPEN_STRONG, OPEN_LOOSE = range(5)
_EXACT_SALT, _LOOSE_SALT, _OPEN_SALT = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _hash_of(words: list[str]) -> np.ndarray:
    flat = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    return np.sort(hash_spans(flat, *word_spans(flat)))


_UNIT_HASHES = _hash_of(UNITS)


def template(d: np.ndarray, doc_starts: np.ndarray):
    """Tokens of bytes: start and end of their core, template and word hash, whether a placeholder, whether an opener,
    first token of each text.

    A token with a digit is a number, a unit word directly after a number is a unit, and a capitalised word that does
    not open a line or sentence is a name. One that does open it is an opener: it may be a name or not. Tokens without
    letters and digits are left out.
    """
    s, e, cs, ce = core_spans(d)
    plain = hash_spans(lower(d), cs, ce)
    h = mix64(plain)
    first = np.searchsorted(s, doc_starts)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[d])])
    number = digits[ce] > digits[cs]
    at = np.minimum(np.searchsorted(_UNIT_HASHES, plain), len(_UNIT_HASHES) - 1)
    unit = (_UNIT_HASHES[at] == plain) & np.append(False, number[:-1])[: len(s)]
    opens = np.append(True, _STOP[d[e[:-1] - 1]])[: len(s)]
    opens[first[first < len(s)]] = True
    lines = np.concatenate([[0], np.cumsum(d == 10)])
    if len(s):
        opens[1:] |= lines[s[1:]] > lines[e[:-1]]
    capital = _UPPER[d[cs]] & ~number & ~unit
    if len(s):
        following = np.minimum(cs + 1, ce - 1)
        capital &= ~_UPPER[d[following]] | (ce - cs == 1)  # words all in capitals are shouting, not names
    name, opener = capital & ~opens, capital & opens
    slot = number | unit | name
    for mask, value in ((number, NUMBER), (unit, UNIT), (name, NAME)):
        h[mask] = value
    return cs, ce, h, plain, slot, opener, first


def matching_windows(df: DataFrame, id_col: str, wanted=None, size: int = WINDOW, short=()) -> DataFrame:
    """(id, place, total, key, slots, kind, size): the windows of each text, or those whose key is in wanted.

    A window of MIN_LITERALS literals or more is STRONG: its key is of its template. One of fewer has two keys: an EXACT
    one of its words as they are, and a LOOSE one of its template, which wanted lets pass only in a text with a strong
    match. A window with openers has a further key of its template with these as names: OPEN_STRONG or OPEN_LOOSE, by the
    literals that are left. total is the text's number of windows, size a window's tokens; slots holds the values of a window's placeholders. A text shorter
    than a window is one window; other texts also give windows of the lengths in short.
    """

    def run(batches):
        keys = None if wanted is None else wanted.value
        has = lambda k: np.ones(len(k), bool) if keys is None else _among(k, keys)
        for batch in batches:
            ids = batch.column(id_col)
            rows, place, total, key, slots, kinds, sizes = [], [], [], [], [], [], []
            for i, j, d, starts in pieces(batch.column("text")):
                cs, ce, h, plain, slot, opener, first = template(d, starts)
                wide, named = np.where(opener, NAME, h), slot | opener
                opened = np.concatenate([[0], np.cumsum(opener)])
                ends = np.append(first[1:], len(h))
                filled = np.concatenate([[0], np.cumsum(slot)])
                spans = [(n, (ends - first >= n) if n == size or n in short else (ends - first == n)) for n in range(MIN_LITERALS, size + 1)]
                for n, whole in spans:
                    whole = np.flatnonzero(whole)
                    inside = np.zeros(len(h) + 1, np.int64)
                    np.add.at(inside, first[whole], 1)
                    np.add.at(inside, ends[whole] - n + 1, -1)
                    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                    if not len(at):
                        continue
                    w = windows(h, n)[at]
                    w = w if n == WINDOW else mix64(w + np.uint64(n))
                    strong = n - (filled[at + n] - filled[at]) >= MIN_LITERALS
                    exact = mix64(windows(mix64(plain), n)[at] ^ _EXACT_SALT ^ np.uint64(n))
                    row = np.searchsorted(first, at, "right") - 1
                    hit = has(np.where(strong, w, exact))
                    loose = mix64(w ^ _LOOSE_SALT)
                    v = windows(wide, n)[at]
                    v = mix64((v if n == WINDOW else mix64(v + np.uint64(n))) ^ _OPEN_SALT)
                    openers = opened[at + n] - opened[at]
                    open_strong = (openers > 0) & (n - (filled[at + n] - filled[at]) - openers >= MIN_LITERALS)
                    open_hit = open_strong.copy()
                    open_hit[open_strong] = has(v[open_strong])
                    open_loose = mix64(v ^ _LOOSE_SALT)
                    anchored = np.isin(row, row[hit & strong | open_hit]) if keys is not None else np.ones(len(at), bool)
                    extra = ~strong & anchored
                    extra[extra] = has(loose[extra])
                    open_extra = (openers > 0) & ~open_strong & anchored
                    open_extra[open_extra] = has(open_loose[open_extra])
                    for kind, ok, value in (
                        (STRONG, hit & strong, w), (EXACT, hit & ~strong, exact), (LOOSE, extra, loose),
                        (OPEN_STRONG, open_hit, v), (OPEN_LOOSE, open_extra, open_loose),
                    ):
                        for m in np.flatnonzero(ok):
                            k, r = int(at[m]), int(row[m])
                            rows.append(i + r)
                            place.append(k - int(first[r]))
                            total.append(int(ends[r] - first[r] - n + 1))
                            key.append(value[m])
                            slots.append([] if kind == EXACT else _values(d, cs, ce, named if kind >= OPEN_STRONG else slot, k, k + n))
                            kinds.append(kind)
                            sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(place, pa.int64()), pa.array(total, pa.int64()),
                 pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(slots, pa.list_(pa.string())),
                 pa.array(kinds, pa.int32()), pa.array(sizes, pa.int32())],
                names=["id", "place", "total", "key", "slots", "kind", "size"],
            )

    return df.select(id_col, "text").mapInArrow(
        run, "id long, place long, total long, key long, slots array<string>, kind int, size int"
    )


def _among(k: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of k are in the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k if len(keys) else np.zeros(len(k), bool)


def _values(d, cs, ce, slot, lo, hi) -> list[str]:
    return [d[cs[k] : ce[k]].tobytes().decode("utf-8", "replace").lower() for k in range(lo, hi) if slot[k]]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, exact): documents that hold a benchmark item, as it is or re-parameterised.

    Matches of a document and an item are read along diagonals (place in the document less place in the item). On a
    diagonal, each benchmark value must meet one document value, else the diagonal is dropped. New values may coincide by
    chance, but at least AGREEING of them must differ. Coverage is the share of the item's windows on the rest, exact whether all their values are equal. Capitalised words that open a sentence
    count as names too; a diagonal that is consistent only without that is judged without. Windows of fewer than
    MIN_LITERALS literals count where they are the same word for word, and by their template on a
    diagonal that holds a match of a window with more. So an item without any window of MIN_LITERALS literals is found
    as it is but not re-parameterised. Null and empty texts match nothing. Items of fewer than MIN_LITERALS tokens are
    never matched. Repeated rows of a document or item count once.
    """
    spark = docs.sparkSession
    items = materialize(matching_windows(benchmark, "item_id"))
    blocks = max(1, -(-items.select("key").distinct().count() // BLOCK_WINDOWS))
    items = items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    short = [r[0] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect()]
    hits = None
    for block in range(blocks):
        part = items.where(F.col("block") == block).select("key").distinct().toPandas()["key"].to_numpy(np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(part.view(np.uint64)))
        found = matching_windows(docs, "doc_id", wanted, short=short).withColumn("block", F.lit(block))
        hits = found if hits is None else hits.unionAll(found)
    hits = materialize(hits.withColumnRenamed("id", "doc_id"))
    renamed = items.select(
        "key", "block", "kind", F.col("id").alias("item_id"), F.col("place").alias("item_place"),
        F.col("total").alias("item_total"), F.col("slots").alias("item_slots"),
    )
    is_loose, is_open = F.col("kind").isin(LOOSE, OPEN_LOOSE), F.col("kind").isin(OPEN_STRONG, OPEN_LOOSE).alias("open")
    sure = (
        hits.where(~is_loose)
        .select("doc_id", "place", "key", "block", "slots")
        .join(broadcast_if_small(renamed.where(~is_loose), BROADCAST_ROWS), ["key", "block"])
        .where(F.size("slots") == F.size("item_slots"))
        .withColumn("shift", F.col("place") - F.col("item_place"))
    )
    columns = ["doc_id", "item_id", "shift", "item_place", "item_total", "item_slots", "slots"]
    anchors = sure.where(F.col("kind").isin(STRONG, OPEN_STRONG)).select("doc_id", F.col("item_id").alias("_item"), "shift").distinct()
    loose = renamed.where(is_loose)
    expected = (
        anchors.join(broadcast_if_small(loose, BROADCAST_ROWS), F.col("_item").eqNullSafe(F.col("item_id")))
        .withColumn("_place", F.col("shift") + F.col("item_place"))
        .select(F.col("doc_id").alias("_doc"), "_place", F.col("key").alias("_key"), "shift", "item_id", "item_place", "item_total", "item_slots", "kind")
    )
    more = (
        hits.where(is_loose)
        .select("doc_id", "place", "key", "slots")
        .join(expected, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("place") == F.col("_place")) & (F.col("key") == F.col("_key")))
        .where(F.size("slots") == F.size("item_slots"))
    )
    met = sure.select(*columns, is_open, F.lit(True).alias("sure")).unionAll(more.select(*columns, is_open, F.lit(False)))
    values = met.select(
        "doc_id", "item_id", "shift", "item_place", "item_total", "open", "sure",
        F.explode_outer(F.arrays_zip("item_slots", "slots")).alias("v"),
    )
    # what a diagonal gathers is bounded by its item: once from all windows, once without those whose openers are names
    gathered = []
    for n, part in (("all", F.lit(True)), ("closed", ~F.col("open"))):
        sets = {"places": "item_place", "left": "v.item_slots", "right": "v.slots", "both": "v"}
        gathered += [F.collect_set(F.when(part, F.col(c))).alias(f"{k}_{n}") for k, c in sets.items()]
        gathered += [F.coalesce(F.bool_and(F.when(part, F.col("v.item_slots") == F.col("v.slots"))), F.lit(True)).alias(f"exact_{n}")]
        gathered += [F.coalesce(F.bool_or(F.when(part, F.col("sure"))), F.lit(False)).alias(f"sure_{n}")]
    diagonal = values.groupBy("doc_id", "item_id", "shift").agg(F.max("item_total").alias("item_total"), *gathered)

    def consistent(n: str):
        left, right, both = (F.size(f"{k}_{n}") for k in ("left", "right", "both"))
        return F.col(f"sure_{n}") & (both == left) & (right >= AGREEING * both)

    chosen = lambda k: F.when(consistent("all"), F.col(f"{k}_all")).when(consistent("closed"), F.col(f"{k}_closed")).alias(k)
    diagonal = diagonal.select("doc_id", "item_id", "item_total", chosen("places"), chosen("exact"))
    return (
        diagonal.where("places IS NOT NULL")
        .groupBy("doc_id", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
            F.max("item_total").alias("item_total"),
            F.bool_and("exact").alias("exact"),
        )
        .withColumn("coverage", F.least(F.col("covered") / F.col("item_total"), F.lit(1.0)))
        .where(F.col("coverage") >= coverage)
        .select("doc_id", "item_id", "coverage", "exact")
    )


def op1_template_windows(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
