"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of words, word pairs and pairs with one word
between.  Each coordinate has its own learning rate; the L1 term keeps a weight at
exactly zero until its gradients agree, so the fitted model is a short list of
(bucket, weight) that is broadcast to the scoring tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import held_out, require
from storelens.llm.labelled import fitted, training_rows
from storelens.llm.wordhash import U64, WordHasher, alphanumeric, byte_slices, distinct, grams

SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: per-coordinate rate alpha / (beta + sqrt(sum of squared gradients));
    l1, l2: regularisation; bits: log2 of the number of buckets; rows: bound of the sample."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    bits: int = 20
    epochs: int = 3
    rows: int = 16_000


def features(hasher: WordHasher, texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word n-grams and skip-grams of a run of texts, and their rows (with repeats)."""
    words, _, at = hasher(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    sets = [(words, row), grams(words, row, 1), grams(words, row, 2)]
    return (np.concatenate([k for k, _ in sets]) >> U64(64 - bits)).astype("int64"), np.concatenate([r for _, r in sets])


def fit(sample: pa.Table, p: Ftrl) -> pa.RecordBatch:
    """One pass after another over the sample in rank order, one example at a time.
    Bucket -1 is the intercept, which has no L1 term."""
    hasher, size = WordHasher(alphanumeric()), (1 << p.bits) + 1
    text, label = sample.column("text").combine_chunks(), sample.column("label").to_numpy()
    examples = []
    for piece in byte_slices(text, SLICE_BYTES):
        bucket, row = distinct(*features(hasher, piece, p.bits))
        cut = np.searchsorted(row, np.arange(len(piece) + 1))
        examples += [np.append(bucket[a:b], size - 1).astype("int32") for a, b in zip(cut, cut[1:])]
    z, n, l1 = np.zeros(size), np.zeros(size), np.full(size, p.l1)
    l1[-1] = 0.0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i, y in zip(examples, label):
            w = weights(i)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[i] = ni + g * g
    w = weights(np.arange(size))
    kept = np.flatnonzero(w[:-1])
    return pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(w[kept], w[-1]))], names=["bucket", "weight"])


def with_toxicity(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), threshold: float = 0.3, out: str = "score") -> DataFrame:
    """``docs`` (doc_id, text) with ``out``, the probability that a text is toxic, and ``predicted``.

    Labels (doc_id, toxic) are learnt from at most ``params.rows`` rows whose
    crc32(doc_id as text) modulo 4 is not 2; only the text is scored.  Null and empty
    texts have no features and get the intercept's probability; without any usable
    label every score is 0.  Repeated rows score alike, an empty table stays empty;
    columns named ``out`` or ``predicted`` are replaced, others pass through.
    """
    require(docs, "doc_id", "text")
    model = fitted(training_rows(docs, labels, "toxic", params.rows), lambda t: fit(t, params), "bucket long, weight double")
    # bounded by 2**bits and short because of the L1 term
    shared = docs.sparkSession.sparkContext.broadcast([(r.bucket, r.weight) for r in model])
    bits = params.bits

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, weight, intercept = WordHasher(alphanumeric()), np.zeros(1 << bits), -math.inf
        for b, w in shared.value:
            if b < 0:
                intercept = w
            else:
                weight[b] = w
        for texts in batches:
            out = []
            for piece in byte_slices(texts, SLICE_BYTES):
                bucket, row = features(hasher, piece, bits)
                active = weight[bucket] != 0  # only these need be made distinct
                bucket, row = distinct(bucket[active], row[active])
                out.append(np.bincount(row, weight[bucket], len(piece)) + intercept)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out), -700, 700))) if out and math.isfinite(intercept) else np.zeros(len(texts)), pa.float64())

    return docs.withColumn(out, score("text")).withColumn("predicted", (F.col(f"`{out}`") >= threshold).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return with_toxicity(docs.select("doc_id", "text"), labels, **more).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
