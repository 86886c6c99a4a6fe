"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over the UTF-8 bytes of the whole document. A document is cut into overlapping chunks (each half of
a chunk belongs to two of them); each filter is max-pooled over a chunk, the pooled chunks are summed up as their mean
and their maximum, and a logistic layer combines both into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sampled_labels, table

WIDTH, STRIDE, FILTERS, HALF = 8, 2, 16, 256
#: Labelled rows that are learned from at most, and the bytes of text up to which a row is: the fit runs on the driver
#: and must stay bounded. Those rows are read whole; scoring reads every byte of every text.
TRAIN_ROWS, TRAIN_BYTES = 3000, 1 << 17
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.01, 7
THRESHOLD = 0.7
#: Bytes that one numpy step takes together.
STEP_BYTES = 1 << 18


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of HALF, each text filled up with at least WIDTH zeros; the first row of each text."""
    count = np.array([(len(t) + WIDTH + HALF - 1) // HALF for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(int(first[-1]) * HALF, np.uint8)
    for t, k in zip(texts, first, strict=False):
        flat[k * HALF : k * HALF + len(t)] = np.frombuffer(t, np.uint8)
    return flat, first


@dataclass
class ByteCnn:
    table: np.ndarray  # WIDTH x 256 x FILTERS: a one-hot convolution is a sum of table rows
    bias: np.ndarray
    weight: np.ndarray  # of the mean and of the maximum over chunks
    offset: float

    def responses(self, flat: np.ndarray) -> np.ndarray:
        """Filter responses at every STRIDE-th byte, before the bias."""
        x = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
        n = len(flat) // STRIDE
        out = np.take(self.table[0], x[0 : n * STRIDE : STRIDE], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.table[k], x[k : k + n * STRIDE : STRIDE], axis=0)
        return out

    def pooled(self, flat: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each half chunk."""
        per = HALF // STRIDE
        return self.responses(flat).reshape(-1, per, FILTERS).max(1)

    def features(self, half: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each text. half: maxima of the half chunks of all texts."""
        chunk = half.copy()
        if len(half) > 1:
            inner = np.ones(len(half), bool)
            inner[first[1:] - 1] = False  # the last half of a text has none after it
            at = np.flatnonzero(inner)
            chunk[at] = np.maximum(half[at], half[at + 1])
        chunk = np.maximum(chunk + self.bias, 0)
        starts = first[:-1]
        n = np.diff(first)[:, None]
        return np.concatenate(
            [np.add.reduceat(chunk, starts, axis=0) / n, np.maximum.reduceat(chunk, starts, axis=0)], axis=1
        )

    def scores(self, texts: list[bytes]) -> np.ndarray:
        flat, first = halves(texts)
        step = STEP_BYTES // HALF
        parts = []
        for k in range(0, int(first[-1]), step):
            # WIDTH further bytes complete the last windows of the step
            piece = flat[k * HALF : (k + step) * HALF]
            tail = flat[(k + step) * HALF : (k + step) * HALF + WIDTH]
            own = ByteCnn.pooled(self, piece)
            if len(tail):
                own[-1] = np.maximum(own[-1], self._crossing(piece, tail))
            parts.append(own)
        z = self.features(np.concatenate(parts), first) @ self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _crossing(self, piece: np.ndarray, tail: np.ndarray) -> np.ndarray:
        near = np.concatenate([piece[-WIDTH:], tail, np.zeros(WIDTH, np.uint8)])
        rows = [sum(self.table[k, near[i + k]] for k in range(WIDTH)) for i in range(0, WIDTH, STRIDE)]
        return np.max(rows, axis=0)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> ByteCnn:
    """Adam on the logistic loss; the gradient of a pooled filter goes to the bytes of its winning window."""
    rng = np.random.default_rng(seed)
    net = ByteCnn(
        rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        float(np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))) if len(labels) else 0.0,
    )
    if not len(texts):
        return net
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.table, net.bias, net.weight, np.zeros(1))]
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            flat, first = halves([texts[k] for k in pick])
            x = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
            per = HALF // STRIDE
            r = net.responses(flat).reshape(-1, per, FILTERS)
            win = r.argmax(1)
            half = np.take_along_axis(r, win[:, None], 1)[:, 0]
            at = win * STRIDE + (np.arange(len(half)) * HALF)[:, None]
            last = np.zeros(len(half), bool)
            last[first[1:] - 1] = True
            nxt = np.where(last, np.arange(len(half)), np.minimum(np.arange(len(half)) + 1, len(half) - 1))
            use_next = half[nxt] > half
            chunk = np.where(use_next, half[nxt], half)
            at = np.where(use_next, at[nxt], at)
            act = np.maximum(chunk + net.bias, 0)
            doc = np.repeat(np.arange(len(pick)), np.diff(first))
            n = np.diff(first)[:, None]
            mean = np.add.reduceat(act, first[:-1], axis=0) / n
            top = np.maximum.reduceat(act, first[:-1], axis=0)
            f = np.concatenate([mean, top], axis=1)
            p = 1 / (1 + np.exp(-np.clip(f @ net.weight + net.offset, -30, 30)))
            dz = (p - labels[pick]) / len(pick)
            g_act = dz[doc, None] * (net.weight[:FILTERS] / n[doc])
            best = act == top[doc]
            g_act += np.where(best, dz[doc, None] * net.weight[FILTERS:], 0)
            g_act = np.where(act > 0, g_act, 0).astype(np.float32)
            g_table = np.zeros_like(net.table)
            cols = np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(WIDTH):
                np.add.at(g_table[k], (x[at + k], cols), g_act)
            grads = [g_table + 1e-5 * net.table, g_act.sum(0), f.T @ dz + 1e-4 * net.weight, np.array([dz.sum()])]
            t += 1
            for (m, v), g, name in zip(moments, grads, ("table", "bias", "weight", "offset"), strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                if name == "offset":
                    net.offset -= float(move[0])
                else:
                    setattr(net, name, (getattr(net, name) - move).astype(np.float32))
    return net


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> tuple[list[bytes], np.ndarray]:
    """Whole texts of at most TRAIN_ROWS labels whose crc32(doc_id) mod 4 is not 2; rows above TRAIN_BYTES do not teach.

    The labels are chosen first, so their number bounds what is broadcast and no text is shuffled.
    """
    chosen = sampled_labels(labels, label, TRAIN_ROWS, SEED)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    found = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # repeated rows of an id teach too, in a seeded order and within the same bound
    found = found.orderBy(F.xxhash64(F.lit(SEED), "doc_id", "text"), "doc_id", "_label").limit(TRAIN_ROWS)
    got = sorted((r["doc_id"], r["text"], r["_label"]) for r in found.select("doc_id", "text", "_label").collect())
    return [t.encode() for _, t, _ in got], np.array([y for _, _, y in got])


def score_texts(docs: DataFrame, net: ByteCnn, keep: list[str], out: str = "score") -> DataFrame:
    """The columns keep of docs and out, the probability of each whole text; null texts count as empty.

    A column of docs called like out gives way to it.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    fields = [f for f in docs.schema.fields if f.name in keep and f.name.lower() != out.lower()]

    def run(batches):
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            ends, lo = np.cumsum(size, dtype=np.int64), 0
            while lo < batch.num_rows:
                # handed on step by step: filled nulls and whole batches would copy all texts
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + 4 * STEP_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                scores = model.value.scores([(t or "").encode() for t in part.column("text").to_pylist()])
                columns = [part.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*[f.name for f in fields], out])
                lo = hi

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """score (0 to 1, higher: good likelier) and predicted for every row of docs; labels teach, see training_rows.

    Empty and null texts get the score of the network for no bytes. Without labelled rows the score is that of an
    untrained network. Rows are never dropped; ties at the threshold count as good. Columns of docs called score or
    predicted give way to the results.
    """
    net = fit(*training_rows(docs, labels, "quality"))
    keep = [c for c in keep if c.lower() != "predicted"]
    return score_texts(docs, net, keep).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text the network scores at THRESHOLD or more."""
    score = fresh("_score", docs)
    scored = score_texts(docs, fit(*training_rows(docs, labels, "quality")), docs.columns, score)
    return scored.where(F.col(score) >= THRESHOLD).select(*docs.columns)


def op2_byte_cnn(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
