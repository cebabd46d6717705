"""Quality classification by a factorisation machine.

Features of a text: its distinct words (hashed), one bin for each structure statistic (shares of capitals, digits, marks, line ends,
spaces and repeated words, lengths), and one for the value of each metadata column that the caller names (numbers are best given
in bins).  The machine adds a weight for each feature and
an inner product of two low-rank vectors for each pair.  Scores take linear time, by the identity
sum over pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

Defined results: null text counts as empty; an empty text is scored by its statistics; if no label can be learned
the score is 0.5 everywhere; an empty table gives an empty result; repeated rows give repeated results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, labelled_sample, map_arrow, remainder, text_slices, utf8, words

#: Bound of what is fitted: labelled texts of each class.
TRAIN_PER_CLASS = 2500
RANK = 8
BITS = 16
EPOCHS = 12
RATE = 0.05
DECAY = 2e-4
SEED = 10
THRESHOLD = 0.3
#: Places after the hashed words: 64 bins for each statistic, and 4096 for hashed metadata.
STATS = 12
_STAT0 = 1 << BITS
_META0 = _STAT0 + 64 * STATS
SIZE = _META0 + 4096

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 13, 11, 12]] = 3
_KIND[32] = 4
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_KIND[128:] = 6


def features(text: pa.Array, meta: list[pa.Array] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of all rows, row after row, and where each row begins (one more at the end)."""
    data, offsets = utf8(text)
    n = len(text)
    hashes, starts, ends, first = words(data, offsets)
    total = np.diff(first)
    rows = np.repeat(np.arange(n), total)
    slots = np.unique((rows << BITS) | (hashes & U64((1 << BITS) - 1)).astype(np.int64))
    word_rows, word_ids = slots >> BITS, slots & ((1 << BITS) - 1)
    distinct = np.bincount(word_rows, minlength=n)
    size = np.diff(offsets)
    kind = _KIND[data]
    counts = []
    for k in range(1, 7):
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        counts.append(sums[offsets[1:]] - sums[offsets[:-1]])
    same = np.zeros(len(data) + 1, np.int64)
    same[2:] = np.cumsum(data[1:] == data[:-1]) if len(data) > 1 else 0
    pairs = same[offsets[1:]] - same[np.minimum(offsets[:-1] + 1, len(data))]
    share = lambda a, b, scale: np.clip(a * scale / np.maximum(b, 1), 0, 63)
    stats = [share(c, size, s) for c, s in zip(counts, (64, 128, 256, 128, 128, 128), strict=True)]
    stats += [share(pairs, size, 128), share(total - distinct, total, 63), share(size, total, 2), 3 * np.log2(size + 1), 3 * np.log2(total + 1), np.where(counts[2] > 0, 4 * np.log2(1 + size / np.maximum(counts[2], 1)), 0)]
    stat_ids = np.stack([_STAT0 + 64 * i + np.clip(s, 0, 63).astype(np.int64) for i, s in enumerate(stats)], axis=1)
    more = [np.array([_META0 + (zlib.crc32(f"{i}:{x}".encode()) & 4095) for x in m.to_pylist()], np.int64)[:, None] for i, m in enumerate(meta)]
    dense = np.concatenate([stat_ids, *more], axis=1)
    k = dense.shape[1]
    begin = np.concatenate([[0], np.cumsum(distinct + k)])
    ids, values = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.float32)
    at = np.arange(len(word_ids)) + k * word_rows
    ids[at], values[at] = word_ids, (1 / np.sqrt(np.maximum(distinct, 1)))[word_rows]
    at = (begin[1:, None] - k) + np.arange(k)
    ids[at], values[at] = dense, 0.3
    return ids, values, begin


def _score(ids, values, begin, bias, w, v) -> np.ndarray:
    """Logits; every row has features, so every stretch of reduceat is its own."""
    linear = np.add.reduceat(w[ids] * values, begin[:-1])
    xv = v[ids] * values[:, None]
    sums = np.add.reduceat(xv, begin[:-1], axis=0)
    squares = np.add.reduceat((xv * xv).sum(axis=1), begin[:-1])
    return bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)


def fit(parts: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors, by AdaGrad on the weighted logistic loss."""
    ids, values, begin = parts
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
    gw, gv, gb = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32), 1e-3
    prior = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    weight = weight / weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            length = np.diff(begin)[rows]
            take = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            i, x, own = ids[take], values[take], np.concatenate([[0], np.cumsum(length)])
            error = ((1 / (1 + np.exp(-_score(i, x, own, bias, w, v))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            sums = np.add.reduceat(v[i] * x[:, None], own[:-1], axis=0)
            e = np.repeat(error, length) * x
            uniq, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, e, len(uniq)).astype(np.float32) + DECAY * w[uniq]
            dv = np.zeros((len(uniq), RANK), np.float32)
            np.add.at(dv, back, e[:, None] * (np.repeat(sums, length, axis=0) - v[i] * x[:, None]))
            dv += DECAY * v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            gb += float(error.sum()) ** 2
            w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
            v[uniq] -= RATE * dv / np.sqrt(gv[uniq])
            bias -= RATE * float(error.sum()) / gb**0.5
    return bias, w, v


def _named(meta: list[Column]) -> list[Column]:
    return [m.cast("string").alias(f"_meta{i}") for i, m in enumerate(meta)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS, meta: list[Column] = ()):
    """Fits on a bounded sample of labelled documents; a document with several labels counts with each."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    # Only ids are joined for the choice of the sample; texts come for what is chosen.
    names = tuple(f"_meta{i}" for i in range(len(meta)))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("size"), *_named(meta)).join(marks, "doc_id")
    sample, counts = labelled_sample(rows, "label", per_class, SEED, names)
    if not counts:
        return None
    y = np.array([r["label"] for r in sample], np.float32)
    have = {k: max(1, int((y == k).sum())) for k in counts}
    weight = np.array([counts[int(k)] / have[int(k)] for k in y], np.float64)
    column = lambda c, i: pa.array([r[c] for r in sample[i : i + 500]], pa.string())
    parts = [features(column("text", i), [column(c, i) for c in names]) for i in range(0, len(sample), 500)]
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    begin = np.concatenate([*(p[2][:-1] + s for p, s in zip(parts, shift, strict=False)), shift[-1:]])
    return fit((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), begin), y, weight)


def predict(docs: DataFrame, model, meta: list[Column] = ()) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text and what meta, as in training, is made of)."""
    count = len(meta)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, "text"):
                value = np.full(piece.num_rows, 0.5)
                if held.value is not None:
                    value = 1 / (1 + np.exp(-np.clip(_score(*features(piece.column("text"), [piece.column(2 + i) for i in range(count)]), *held.value).astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(value, pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text", *_named(meta)), score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), threshold: float = THRESHOLD, meta: list[Column] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of rows with remainder held_out[1] are not read."""
    out_of = remainder("doc_id", held_out[0]) == held_out[1]
    model = train(docs.filter(~out_of), labels.filter(~out_of), meta=meta)
    return predict(docs, model, meta).select("doc_id", out_of.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
