"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader.

Tokens are runs of letters and digits or runs of punctuation. Features are token unigrams and bigrams, and
unigrams to trigrams of token shapes (lower, capitalised, capitals, digits, punctuation, repeat of the token
before), all hashed into one space. A text's value of a feature is its share of the text's tokens, so a
score is one sparse dot product, computed for whole batches at once.

The model is fitted on at most ``LABELLED`` labelled rows outside the held-out fold (smallest id hashes);
every row is scored over its whole text. Defined cases: a null or empty text gets the model's bias; labels
that are null or without a document are ignored; of labels that repeat an id the largest counts, and of texts that
repeat a sampled id the least; with no labels every score is 0.5; repeated rows are answered one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, mix
from .learn import BUCKETS, Features, bucket, gather, held_out, logistic, sample, score, token_runs

#: Most labelled rows that the model is fitted on.
LABELLED = 6000
EPOCHS = 4
#: Step size, its smoothing, and the weights of the absolute and squared penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4

_KIND = np.full(256, 2, np.uint8)
_KIND[0x00] = _KIND[0x20] = _KIND[0x09:0x0E] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_SHAPES = 12


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = _KIND[data]
    begins, ends, first = token_runs(kinds, offsets)
    n = len(begins)
    size = np.diff(first)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64), size
    h = Spans(data).of(begins, ends)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    upper = upper[ends] - upper[begins]
    lead = data[begins]
    shape = np.where(upper >= 2, 2, upper)
    shape[(lead >= 0x30) & (lead <= 0x39)] = 3
    shape[kinds[begins] == 2] = 4
    shape[(kinds[begins] == 2) & (ends - begins > 1)] = 5
    follows = np.ones(n, bool)  # whether the token before is in the same row
    follows[first[:-1][first[:-1] < n]] = False
    again = follows.copy()
    again[1:] &= h[1:] == h[:-1]
    shape = (shape + 6 * again).astype(np.uint64)
    h1, s1 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    h1[1:], s1[1:] = h[:-1], shape[:-1] + np.uint64(1)
    h1[~follows], s1[~follows] = 0, 0
    s2 = np.zeros(n, np.uint64)
    s2[2:] = s1[1:-1]
    s2[~follows] = 0
    pair = s1 * np.uint64(32) + shape
    found = np.empty((n, 5), np.int64)
    found[:, 0] = bucket(h)
    found[:, 1] = bucket(mix(h * np.uint64(3) + h1))
    for k, x in enumerate((shape, pair + np.uint64(1 << 10), s2 * np.uint64(1024) + pair + np.uint64(1 << 20)), 2):
        found[:, k] = bucket(mix(x + np.uint64(0x5A5A5A5A)))
    return found.ravel(), first * 5, size


features = Features(_features, 5, _KIND > 0, keep=2)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. ``rows``: label, buckets, counts."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(7)

    def weight(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        return np.where(np.abs(zk) <= L1, 0.0, -(zk - np.sign(zk) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            label, k, x = rows[r]
            k, x = np.append(k, BUCKETS), np.append(x / max(x.sum() / 5, 1), 1.0)  # the last is the bias
            w = weight(k)
            g = (logistic(w @ x) - label) * x
            more = n[k] + g * g
            z[k] += g - (np.sqrt(more) - np.sqrt(n[k])) / ALPHA * w
            n[k] = more
    w = weight(np.arange(BUCKETS + 1))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", labelled: int = LABELLED) -> tuple[np.ndarray, float]:
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    sides = gather(docs, sample(known, labelled, 6), features)
    return fit([(label, k, n) for label in sorted(sides) for k, n in sides[label]])


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, bias = train(docs, labels)
    scored = score(docs, features, weights, bias, mean=True)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
