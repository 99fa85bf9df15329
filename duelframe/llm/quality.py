"""Document quality by a factorisation machine.

Features of a text: hashed words (presence weighted by log counts, unit length), structure statistics
(capitals, punctuation, repeated and distinct words, word and line lengths, rare symbols) and the
metadata that a text carries itself (its length). Second-order weights are inner products of rows of a
low-rank matrix V; the score takes linear time by

    sum over pairs <v_i, v_j> x_i x_j = 1/2 * sum over factors ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The fit reads at most `rows` labelled documents (a documented bound: those with the smallest hashes);
scoring reads every whole text. Classes are weighted so that the score is centred between them.

Null and empty texts have zero features and get the score of the bias with the length features; rows
without a label or with a null doc_id are never learned from; repeated rows score alike; with no
labelled row, or labels of one class only, the score is the share of label 1 (0.5 with none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tokens import U

#: Word buckets, rank of the interactions, labelled rows that the fit may read, passes, step.
BUCKETS, RANK, ROWS, EPOCHS, STEP = 1024, 8, 6000, 60, 0.02
CUT = 0.3
STATS = 16


def _stats(buf: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    n, w = max(len(buf), 1), max(len(hashes), 1)
    c = np.bincount(buf, minlength=256)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    beyond, space, line = c[128:].sum(), c[32] + c[9], c[10]
    marks = len(buf) - upper - lower - digit - beyond - space - line
    plain = c[[44, 46, 39, 45]].sum()      # comma, full stop, apostrophe, hyphen
    distinct = len(np.unique(hashes))
    repeated = (hashes[1:] == hashes[:-1]).sum()
    pairs = len(np.unique(hashes[1:] * U(3) + hashes[:-1])) if len(hashes) > 1 else 0
    return np.array([np.log1p(len(buf)) / 10, np.log1p(len(hashes)) / 8, upper / n * 3, digit / n * 5, marks / n * 5, (marks - plain) / n * 10,
                     beyond / n, space / n * 3, np.log1p(line) / 5, distinct / w, repeated / w, pairs / w, min(n / w, 40) / 10,
                     c[33] / n * 20, c[124] / n * 20, float(len(hashes) < 20)], dtype=np.float32)


def features(column: pa.Array, buckets: int):
    """(first row, dense features) in blocks: word buckets, then statistics."""
    for lo, hi, buf, starts in tokens.pieces(column, tokens.PIECE // 2):
        x = np.zeros((hi - lo, buckets + STATS), dtype=np.float32)
        at, hashes = tokens.hash_words(buf, tokens.ALNUM)
        row = np.searchsorted(starts, at, "right") - 1
        words = np.bincount(row * buckets + (hashes >> U(40)).astype(np.int64) % buckets, minlength=(hi - lo) * buckets).reshape(hi - lo, buckets)
        x[:, :buckets] = np.log1p(words)
        x[:, :buckets] /= np.maximum(np.linalg.norm(x[:, :buckets], axis=1, keepdims=True), 1e-6)
        edge = np.searchsorted(at, np.append(starts, len(buf)))
        ends = np.append(starts[1:], len(buf)) - 1
        for k in range(hi - lo):
            x[k, buckets:] = _stats(buf[starts[k]:ends[k]], hashes[edge[k]:edge[k + 1]])
        yield lo, x


def margin(x: np.ndarray, model: dict) -> np.ndarray:
    """Bias, linear part and pairwise part by the sum-of-squares identity."""
    v = model["v"]
    return model["b"] + x @ model["w"] + 0.5 * ((x @ v) ** 2 - (x * x) @ (v * v)).sum(axis=1)


def _train(x: np.ndarray, y: np.ndarray, rank: int, epochs: int, step: float) -> dict:
    """Adagrad on the class-weighted logistic loss with a small L2 penalty."""
    draw = np.random.default_rng(3)
    d, n = x.shape[1], len(y)
    model = {"b": 0.0, "w": np.zeros(d, dtype=np.float32), "v": draw.normal(0, 0.05, (d, rank)).astype(np.float32), "prior": float(y.mean()) if n else 0.5}
    if n == 0 or y.min() == y.max():
        return model | {"constant": True}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    sums = {"b": 1e-6, "w": np.full(d, 1e-6, dtype=np.float32), "v": np.full((d, rank), 1e-6, dtype=np.float32)}
    for _ in range(epochs):
        order = draw.permutation(n)
        for lo in range(0, n, 256):
            i = order[lo:lo + 256]
            xb, v = x[i], model["v"]
            p = 1 / (1 + np.exp(-np.clip(margin(xb, model), -30, 30)))
            g = ((p - y[i]) * weight[i]).astype(np.float32) / len(i)
            xv = xb @ v
            grads = {"b": float(g.sum()), "w": xb.T @ g + 1e-5 * model["w"], "v": xb.T @ (g[:, None] * xv) - v * ((xb * xb).T @ g)[:, None] + 1e-5 * v}
            for k, grad in grads.items():
                sums[k] = sums[k] + grad * grad
                model[k] = model[k] - 5 * step * grad / np.sqrt(sums[k])
    return model | {"constant": False}


def sampled(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents, half of them of each label as far as there are.

    The ids are chosen on the ids alone, by hash; only their texts are fetched, by a join with at most `rows` ids. Of several labels of
    an id the larger one counts, of several texts the first by hash."""
    there = docs.select("doc_id").filter(~held_out())
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
             .join(there, "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id", F.lit(17))))
    chosen = [tuple(r) for label in (0, 1) for r in known.filter(F.col("label") == label).orderBy("order", "doc_id").limit(rows // 2).select("doc_id", "label").collect()]
    ids = docs.sparkSession.createDataFrame(chosen, docs.select(F.col("doc_id").alias("_id"), F.lit(0).alias("label")).schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.orderBy("doc_id").select("text", "label")


def fit(sample: DataFrame, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, step: float = STEP) -> dict:
    """Fit on a bounded sample of (text, label)."""
    found = sample.mapInArrow(_extract(buckets), "x binary, label int").collect()
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in found]) if found else np.zeros((0, buckets + STATS), dtype=np.float32)
    return _train(x, np.array([r["label"] for r in found], dtype=np.float32), rank, epochs, step) | {"buckets": buckets}


def _extract(buckets: int):
    def run(batches):
        for batch in batches:
            for lo, x in features(batch.column("text"), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("label").slice(lo, len(x))], names=["x", "label"])
    return run


def _score(sent, name: str):
    """Adds the score to all columns of a batch."""
    def run(batches):
        model = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, model["prior"])
            if not model["constant"]:
                for lo, x in features(batch.column("text"), model["buckets"]):
                    out[lo:lo + len(x)] = 1 / (1 + np.exp(-np.clip(margin(x, model), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])
    return run


def held_out() -> F.Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame, name: str = "score", rows: int = ROWS) -> DataFrame:
    """The documents with all their columns and their score; learned from the labelled documents that aren't held out."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sampled(docs, labels, rows)))
    return docs.mapInArrow(_score(model, name), docs.withColumn(name, F.lit(0.0)).schema)


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, score) per document."""
    return scored(docs.select("doc_id", "text"), labels, rows=rows).select("doc_id", "score")


def drop_rejected(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Documents whose score reaches `cut`, with all their columns, each judged by its own text. Rows without doc_id stay."""
    return scored(docs, labels, "_quality_score").filter((F.col("_quality_score") >= cut) | F.col("doc_id").isNull()).select(*docs.columns)
