"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the other side is text of any kind, whose hidden positives are
allowed for: with the class prior p the negative risk is the unlabelled risk less p times the positives'
risk as negatives, and it is kept from going below zero by ascending whenever it does (the estimator of
Kiryo et al., 2017). The classifier is a linear model in numpy over hashed lower-cased words and their
beginnings of 4 to 6 bytes; a score sums the weights of a text's distinct words.

The model is fitted on at most ``POSITIVES`` and ``UNLABELLED`` rows outside the held-out fold (smallest id
hashes), of which only features that set the two sides apart are kept; every row is scored over its whole
text. Features are 32-bit hashes, of which the kept ones are a sorted vocabulary: any other word weighs nothing
instead of sharing a bucket with a kept one. Defined cases: a null or empty text gets the model's bias; labels that are null or without a document
are ignored; of labels that repeat an id the largest counts, and of texts that repeat a sampled id the least; with no positives every score is 0; repeated
rows are answered one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, mix, runs
from .learn import Features, Sample, gather, held_out, keep_below, logistic, sample, score

#: Most confirmed toxic rows, and most rows of any kind, that the model is fitted on.
POSITIVES, UNLABELLED = 2000, 4000
#: A feature is used if so many rows have it and the log of its rates' ratio is ``LEAST`` standard errors from zero. Its
#: values are scaled by its share of ``ERRORS`` standard errors, to this power, so what chance may give moves scores little.
#: Chosen by the area under the curve of cross-validation inside the training fold.
SUPPORT, LEAST, ERRORS, TRUST = 4, 1.5, 4.0, 3
ITERATIONS, RATE, DECAY = 300, 0.1, 1e-4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


#: A feature is so many bits of a hash.
_BITS = np.uint64((1 << 32) - 1)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & _BITS).astype(np.int64)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begins, ends, first = runs(_WORD[data], offsets)
    spans = Spans(_LOWER[data])
    whole = spans.of(begins, ends)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
    keep = np.sort(np.unique(whole + row * np.uint64(0xD6E8FEB86659FD93), return_index=True)[1])  # each word of a text once
    begins, ends, whole = begins[keep], ends[keep], whole[keep]
    first = np.searchsorted(keep, first)
    found = np.empty((len(begins), 4), np.int64)
    found[:, 0] = bucket(whole)
    for k, size in enumerate((4, 5, 6), 1):  # a shorter word gives its whole again, marked by the size
        found[:, k] = bucket(mix(spans.of(begins, np.minimum(begins + size, ends)) + np.uint64(size)))
    return found.ravel(), first * 4, np.diff(first)


features = Features(_features, 4, _WORD, once=True)


class Weights:
    """Weights by feature: of a sorted vocabulary's own, and 0 of any other."""

    def __init__(self, vocabulary: np.ndarray, own: np.ndarray):
        self.vocabulary, self.own = vocabulary, own

    def __getitem__(self, found: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(found), self.own.dtype)
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == found, self.own[at], 0)

    def astype(self, kind: type) -> Weights:
        return Weights(self.vocabulary, self.own.astype(kind))


def fit(positive: Sample, unlabelled: Sample, prior: float) -> tuple[Weights, float]:
    """Weights and bias of the classifier whose non-negative PU risk is least. Rows are (features, counts). ``prior`` is the
    most that the unlabelled side is taken to have of positives."""
    none = Weights(np.empty(0, np.int64), np.empty(0))
    if not positive or not unlabelled:
        return none, -40.0
    all_features = np.unique(np.concatenate([k for k, _ in (*positive, *unlabelled)]))
    seen = [np.bincount(np.searchsorted(all_features, np.concatenate([k for k, _ in side])), minlength=len(all_features)) for side in (positive, unlabelled)]
    rate_p, rate_u = ((n + 0.5) / (len(side) + 1) for n, side in zip(seen, (positive, unlabelled)))
    odds = np.log(rate_p / rate_u)
    errors = np.abs(odds) / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    used = np.flatnonzero((seen[0] + seen[1] >= SUPPORT) & (errors >= LEAST))
    if not len(used):
        return none, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    place = np.full(len(all_features), -1)
    place[used] = np.arange(len(used))

    trust = np.minimum(1, errors[used] / ERRORS) ** TRUST
    telling = (errors >= ERRORS) & (odds > 0)
    if telling.any():  # what sets positives apart occurs on the unlabelled side at least as often as its share of positives has it
        prior = min(prior, float(rate_u[telling].sum() / rate_p[telling].sum()))

    def matrix(side):
        r = np.repeat(np.arange(len(side)), [len(k) for k, _ in side])
        c, x = place[np.searchsorted(all_features, np.concatenate([k for k, _ in side]))], np.concatenate([n for _, n in side])
        ok = c >= 0
        return r[ok].astype(np.int32), c[ok].astype(np.int32), (np.minimum(x[ok], 3.0) * trust[c[ok]]).astype(np.float32), len(side)

    p, u = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    grown, grown_b = np.full(len(used), 1e-6), 1e-6

    def out(m):
        return np.bincount(m[0], m[2] * w[m[1]], m[3]) + b

    def back(m, g):
        return np.bincount(m[1], m[2] * g[m[0]], len(used)), g.sum()

    for _ in range(ITERATIONS):
        sp, su = logistic(out(p)), logistic(out(u))
        as_positive = prior * back(p, (sp - 1) / p[3])[0], prior * ((sp - 1) / p[3]).sum()
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gu, gp = back(u, su / u[3]), back(p, sp / p[3])
        g_neg, b_neg = gu[0] - prior * gp[0], gu[1] - prior * gp[1]
        if negative >= 0:
            g, gb = as_positive[0] + g_neg, as_positive[1] + b_neg
        else:  # over-fitted: undo
            g, gb = -g_neg, -b_neg
        g = g + DECAY * w
        grown += g * g
        grown_b += gb * gb
        w -= RATE * g / np.sqrt(grown)
        b -= RATE * gb / np.sqrt(grown_b)
    return Weights(all_features[used].astype(np.int64), w * trust), float(b)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> tuple[Weights, float]:
    """The class prior is that of the unlabelled side. Where none is given it is the labelled rows' share of toxic ones, and in
    either case no more than what the telling features allow, so a labelled part richer in toxic texts does no harm."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    prior = (known.agg(F.avg("label")).first()[0] or 0.0) if prior is None else prior
    prior = min(max(prior, 1e-4), 0.9)
    any_kind = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = sample(known.where("label = 1"), positives, 2).unionByName(sample(any_kind, unlabelled, 3).withColumn("label", F.lit(0)))
    sides = gather(docs, chosen, features)
    return fit(sides.get(1, []), sides.get(0, []), prior)


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, bias = train(docs, labels)
    scored = score(docs, features, weights, bias, mean=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``below``; the model learns from ``all_docs``."""
    return keep_below(docs, features, *train(all_docs, labels), mean=False, below=below)
