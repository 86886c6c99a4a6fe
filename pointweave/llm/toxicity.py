"""Toxicity severity by cumulative-link (proportional odds) regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, ordered thresholds. The score of a text is
its expected grade, the sum of P(grade >= k) over k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled_labels, table
from .tokens import core_spans, hash_spans, lower, pieces

BUCKETS = 1 << 20
GRADES = 4
PREFIXES = (4, 5)
#: Labelled rows that are learned from at most, and the bytes of text up to which a row is; their features, all of
#: them, come to the driver.
TRAIN_ROWS, TRAIN_BYTES, SEED = 8000, 1 << 17, 11
#: Training documents that a feature needs, and the weight below which it is dropped before the rest is fitted again.
LEAST_DOCS, LEAST_WEIGHT = 5, 0.3
STEPS, AGAIN, RATE, RIDGE = 250, 60, 0.05, 2e-4
#: Training rows and share of their toxic ones from which a feature counts towards the grade.
MARKER_DOCS, MARKER_SHARE = 5, 0.6
THRESHOLD = 0.3


def features(texts: pa.Array, only: np.ndarray | None = None):
    """(row, distinct buckets) of each text; only: a mask of the buckets to keep.

    The features are words without case and outer punctuation, and the first 4 and 5 bytes of longer ones.
    """
    for i, j, d, starts in pieces(texts):
        d = lower(d)
        s, _, cs, ce = core_spans(d)
        row = np.searchsorted(starts, s, "right") - 1
        buckets, rows = [], []
        for tag, size in enumerate((None, *PREFIXES)):
            at = np.arange(len(s)) if size is None else np.flatnonzero(ce - cs > size)
            end = ce[at] if size is None else cs[at] + size
            bucket = ((hash_spans(d, cs[at], end) ^ np.uint64(tag << 44)) >> np.uint64(44)).astype(np.int64)
            keep = slice(None) if only is None else only[bucket]
            buckets.append(bucket[keep])
            rows.append(row[at][keep])
        key = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
        cut = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
        for r in range(j - i):
            yield i + r, key[cut[r] : cut[r + 1]] % BUCKETS


@dataclass
class Severity:
    weight: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= 1) for sums of weights."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -30, 30)))
        return above.sum(1), above[:, 0]


def grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Severity grades from binary labels: clean is 0, toxic is 1 to 3 by thirds of the number of markers.

    A marker is a feature of at least MARKER_DOCS training documents of which MARKER_SHARE or more are toxic.
    """
    seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, y in zip(rows, toxic, strict=True):
        seen[x] += 1
        bad[x] += y
    marker = (seen >= MARKER_DOCS) & (bad >= MARKER_SHARE * seen)
    count = np.array([marker[x].sum() for x in rows], int)
    found = count[toxic > 0]
    cuts = np.quantile(found, [1 / 3, 2 / 3]) if len(found) else [0, 0]
    return np.where(toxic > 0, 1 + (count > cuts[0]) + (count > cuts[1]), 0)


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> Severity:
    """Adam on the negative log-likelihood; thresholds are a first one and logarithms of their gaps."""
    weight = np.zeros(BUCKETS)
    if not len(rows):
        return Severity(weight, np.array([1.0, 2.0, 3.0]))
    y = grades(rows, toxic)
    lengths = np.array([len(x) for x in rows])
    row, col = np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows)
    often = np.bincount(col, minlength=BUCKETS) >= LEAST_DOCS
    row, col = row[often[col]], col[often[col]]
    used, col = np.unique(col, return_inverse=True)
    w, theta = np.zeros(len(used)), np.array([2.0, 0.0, 0.0])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, theta)]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n = len(y)
    kept = np.ones(len(used))
    for t in range(1, STEPS + AGAIN + 1):
        if t == STEPS + 1:
            kept = (np.abs(w) >= LEAST_WEIGHT).astype(float)
            w *= kept
        f = np.bincount(row, w[col], minlength=n)
        cut = np.cumsum([theta[0], *np.exp(theta[1:])])
        upper = np.where(y < GRADES - 1, sig(np.append(cut, 0)[y] - f), 1.0)
        below = np.where(y > 0, sig(np.insert(cut, 0, 0)[y] - f), 0.0)
        p = np.maximum(upper - below, 1e-9)
        du, db = upper * (1 - upper) / p, below * (1 - below) / p
        g_f = (du - db) / n
        g_cut = np.array([(-du[y == k].sum() + db[y == k + 1].sum()) / n for k in range(GRADES - 1)])
        g_theta = np.array([g_cut.sum(), np.exp(theta[1]) * g_cut[1:].sum(), np.exp(theta[2]) * g_cut[2]])
        g_w = np.bincount(col, g_f[row], minlength=len(used)) + RIDGE * w
        for value, (m, v), g in zip((w, theta), moments, (g_w, g_theta), strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w *= kept
    weight[used] = w
    return Severity(weight, np.cumsum([theta[0], *np.exp(theta[1:])]))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of the documents of at most TRAIN_ROWS labels in a seeded order, up to TRAIN_BYTES of text; crc32(doc_id) mod 4 = 2 stays unseen."""
    chosen = sampled_labels(labels, "toxic", TRAIN_ROWS, SEED)

    def run(batches):
        for batch in batches:
            got = [np.zeros(0, np.int64)] * batch.num_rows
            for r, x in features(batch.column("text")):
                got[r] = x
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array([x.astype("<i4").tobytes() for x in got], pa.binary())],
                names=["doc_id", "_label", "x"],
            )

    slim = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    found = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # repeated rows of an id teach too, in a seeded order and within the same bound
    found = found.orderBy(F.xxhash64(F.lit(SEED), "doc_id", "text"), "doc_id", "_label").limit(TRAIN_ROWS)
    got = [tuple(r) for r in found.mapInArrow(run, "doc_id long, _label double, x binary").collect()]
    got.sort()
    return [np.frombuffer(x, "<i4").astype(np.int64) for _, _, x in got], np.array([y for _, y, _ in got])


def severity_scores(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """keep, severity (expected grade, 0 to 3), p_toxic and toxic for every row of docs.

    Null, empty and wordless texts get the severity of no features. Every feature of a text counts once. Without labels
    all weights are 0 and every text gets the same severity. Columns of docs called like a result give way to it.
    """
    model = fit(*training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep and f.name.lower() not in ("severity", "p_toxic", "toxic")]

    def run(batches):
        model = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for r, x in features(batch.column("text"), model.weight != 0):
                score[r] = model.weight[x].sum()
            severity, p = model.expected(score)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in fields], pa.array(severity), pa.array(p)],
                names=[*[f.name for f in fields], "severity", "p_toxic"],
            )

    results = [T.StructField(c, T.DoubleType()) for c in ("severity", "p_toxic")]
    return docs.mapInArrow(run, T.StructType([*fields, *results])).withColumn(
        "toxic", F.col("p_toxic") >= THRESHOLD
    )


def op10_severity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return severity_scores(docs, table(spark, sf_dir, "labels"), ["doc_id"])
