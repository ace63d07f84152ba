"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct 3- to 5-grams of the lower-cased whole text, hashed to 2^20 buckets.  With p and q the smoothed shares of toxic
and other training texts that hold a bucket, a bucket's value is log(p/q) where present, else 0; a logistic regression with an
L2 penalty learns a weight for each of the ``FEATURES`` most telling buckets.  Presence, not counts, so one insult in a very long
text weighs what it does in a short one.

Training takes at most ``PER_CLASS`` texts of each label and ``CHARS`` characters in all, the ones of smallest text hash: the
documented bound.  Scoring reads whole texts and shuffles nothing.

Defined results: null and empty texts have no features and get the model's base score; labels that are null or not 0/1
and texts that are null are not learned from; a text labelled both ways counts once for each; with no labels, or labels of one
kind only, the model has no features and scores by the share of that kind (0 without labels); if both kinds are there but no bucket tells
them apart, it scores n1 / (n1 + n0 + 1), so that an even share of toxic texts doesn't reject everything; repeated rows stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm._common import small_batches
from moraine.llm.sampling import choose, text_hash, texts_of

BUCKETS = 20  # bits
SIZES = (3, 4, 5)
PER_CLASS, CHARS = 1500, 6_000_000
FEATURES = 4096
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    weights: np.ndarray  # float32 of 2^BUCKETS: weight times log-count ratio
    bias: float


def buckets_of(text: str | None):
    """For each n-gram size, the bucket of each position of the text."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = c
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            return
        h = h[:-1] * _STEP + c[n - 1 :]
        if n in SIZES:
            x = (h ^ (h >> np.uint64(31))) * _SPREAD
            yield (x >> np.uint64(64 - BUCKETS)).astype(np.int64)


def features_of(text: str | None) -> np.ndarray:
    parts = list(buckets_of(text))
    return np.unique(np.concatenate(parts)).astype(np.int32) if parts else np.empty(0, np.int32)


def fit(features: list[np.ndarray], labels: np.ndarray, rounds: int = 150, penalty: float = 1.0) -> Model:
    """Log-count ratios, then the penalised logistic regression by accelerated gradient descent.  Classes weigh the same."""
    weights, y = np.zeros(1 << BUCKETS, np.float32), np.asarray(labels, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Model(weights, 30.0 if n1 else -30.0)
    pos, neg = np.zeros(1 << BUCKETS), np.zeros(1 << BUCKETS)
    for f, label in zip(features, y):
        (pos if label else neg)[f] += 1  # a text's buckets are distinct
    ratio = np.log((pos + 1) / (n1 + 2)) - np.log((neg + 1) / (n0 + 2))
    # how far the two shares are apart, in standard errors
    share = (pos + neg) / len(y)
    z = np.abs(pos / n1 - neg / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z[pos + neg < 3] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] > 3]
    if not len(chosen):
        return Model(weights, math.log(n1 / (n0 + 1)))
    place = np.full(1 << BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    kept = [place[f[place[f] >= 0]] for f in features]
    rows, cols = np.repeat(np.arange(len(kept)), [len(f) for f in kept]), np.concatenate(kept)
    vals, each = ratio[chosen][cols], np.where(y > 0, 0.5 / n1, 0.5 / n0)
    w, b, lam = np.zeros(len(chosen)), 0.0, penalty / len(y)
    # a bound of the curvature: by power iteration
    v = np.ones(len(chosen))
    top = 1.0
    for _ in range(12):
        v = np.bincount(cols, weights=vals * (each * np.bincount(rows, weights=vals * v[cols], minlength=len(y)))[rows], minlength=len(chosen))
        top = max(float(np.linalg.norm(v)), 1e-12)
        v = v / top
    step = 1.0 / (0.3 * top + 1.0 + lam)
    wm, bm, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=vals * wm[cols], minlength=len(y)) + bm, -40, 40)))
        g = each * (p - y)
        w_new, b_new = wm - step * (np.bincount(cols, weights=vals * g[rows], minlength=len(chosen)) + lam * wm), bm - step * g.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wm, bm = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    weights[chosen] = (w * ratio[chosen]).astype(np.float32)
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str | None = None, per_class: int = PER_CLASS, chars: int = CHARS) -> Model:
    """A model from the rows of ``docs`` that ``labels`` (id, label) marks."""
    known = labels.select(F.col(label_id_col or id_col).alias("lid"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = rows.select("id", text_hash(F.col("text")).alias("h"), F.length("text").alias("size"))
    chosen = choose(rows.join(known, F.col("id") == F.col("lid")).select("h", "label", "size"), per_class, chars)
    if not chosen:
        return Model(np.zeros(1 << BUCKETS, np.float32), -30.0)

    def kernel(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features_of(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())], names=["h", "label", "features"])

    got = texts_of(docs, text_col, chosen, "int").transform(small_batches).mapInArrow(kernel, "h bigint, label int, features binary").dropDuplicates(["h", "label"]).collect()
    got.sort(key=lambda r: (r["h"], r["label"]))
    return fit([np.frombuffer(r["features"], np.int32) for r in got], np.array([r["label"] for r in got]))


def score_text(text: str | None, model_weights: np.ndarray, bias: float) -> float:
    found = []
    for b in buckets_of(text):
        w = model_weights[b]
        if w.any():
            found.append(b[w != 0])
    total = bias + (float(model_weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)) if found else 0.0)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if the score is 0.5 or more)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def kernel(batches):
        for batch in batches:
            s = np.array([score_text(t.as_py(), weights.value, bias) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return source.transform(small_batches).mapInArrow(kernel, f"id {source.schema['id'].dataType.simpleString()}, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged."""
    schema, weights, bias, at = docs.schema, docs.sparkSession.sparkContext.broadcast(model.weights), model.bias, docs.columns.index(text_col)

    def kernel(batches):
        for batch in batches:
            yield batch.filter(pa.array([score_text(t.as_py(), weights.value, bias) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.transform(small_batches).mapInArrow(kernel, schema)
