"""Document quality: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): the
sum-of-squares identity gives all pairwise interactions in time linear in the
features.  Features are the distinct hashed words of a text (each with the same
share of a unit vector), its structure statistics in bins, and the metadata column
n_chars in bins; lang, source, doc_id and labels are never features.
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
from storelens.llm.wordhash import U64, WordHasher, alphanumeric, between_spaces, buffers, byte_slices, distinct

SLICE_BYTES = 4 << 20
BINS = 16
#: Shares of bytes (the first six) and of words, each cut into BINS bins on a square-root scale, and
#: three logarithms of counts: the structure statistics, then the metadata.
STATISTICS = ("upper case", "digits", "punctuation", "space", "line ends", "non-ASCII", "words after themselves",
              "distinct words", "words per chunk", "bytes per word", "words", "n_chars", "n_chars per byte")


@dataclass(frozen=True)
class Machine:
    """factors: rank of the interactions; bits: log2 of the word buckets; rate: AdaGrad step;
    l2: decay of what an example touches; rows: bound of the sample."""

    factors: int = 8
    bits: int = 16
    rate: float = 0.1
    l2: float = 1e-5
    epochs: int = 3
    rows: int = 12_000

    @property
    def size(self) -> int:
        return (1 << self.bits) + len(STATISTICS) * (BINS + 1)


def _byte_classes() -> np.ndarray:
    b = np.arange(256)
    upper, digit, ascii_letter = (b >= 65) & (b < 91), (b >= 48) & (b < 58), ((b >= 65) & (b < 91)) | ((b >= 97) & (b < 123))
    space, line = (b == 32) | ((b >= 9) & (b < 14)), (b == 10) | (b == 13)
    return np.stack([upper, digit, (b > 32) & (b < 127) & ~digit & ~ascii_letter, space, line, b >= 128])


class Features:
    """Turns a run of texts into (feature, row, value), ordered by row."""

    def __init__(self, p: Machine) -> None:
        self.p, self.hasher, self.chunks, self.classes = p, WordHasher(alphanumeric()), WordHasher(between_spaces()), _byte_classes()

    def __call__(self, texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, (raw, at) = len(texts), buffers(texts)
        words, length, first = self.hasher(texts)
        row = np.repeat(np.arange(n), np.diff(first))
        size, count = np.maximum(np.diff(at), 1), np.diff(first)
        stats = [np.diff(np.concatenate([[0], np.cumsum(c[raw], dtype="int64")])[at]) / size for c in self.classes]
        again = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n)
        bucket, brow = distinct((words >> U64(64 - self.p.bits)).astype("int64"), row)
        kinds, some = np.bincount(brow, minlength=n), np.maximum(count, 1)
        per_chunk = count / np.maximum(np.diff(self.chunks(texts)[2]), 1)
        shares = np.stack([*stats, again / some, kinds / some, per_chunk / 4])
        logs = np.stack([np.bincount(row, length, n) / some / 16, np.log2(count + 1) / 16,
                         np.log2(np.maximum(n_chars, 0) + 1) / 20, n_chars / size / 2])
        bins = np.concatenate([np.sqrt(np.clip(shares, 0, 1)), np.clip(logs, 0, 1)])  # a missing n_chars is NaN
        bins = np.where(np.isnan(bins), BINS, np.minimum(bins * BINS, BINS - 1)).astype("int64")
        stat = (1 << self.p.bits) + np.arange(len(STATISTICS))[:, None] * (BINS + 1) + bins
        feature = np.concatenate([bucket, stat.T.ravel()])
        rows = np.concatenate([brow, np.repeat(np.arange(n), len(STATISTICS))])
        value = np.concatenate([1 / np.sqrt(np.maximum(kinds, 1))[brow], np.full(stat.size, 1 / math.sqrt(len(STATISTICS)))])
        order = np.argsort(rows, kind="stable")
        return feature[order], rows[order], value[order]


def score(model: np.ndarray, intercept: float, feature: np.ndarray, row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Logits. model: a row per feature, its weight and then its factors."""
    scaled = model[feature] * value[:, None]
    out = np.bincount(row, scaled[:, 0], n) + intercept
    for f in range(1, model.shape[1]):
        out += 0.5 * (np.bincount(row, scaled[:, f], n) ** 2 - np.bincount(row, scaled[:, f] ** 2, n))
    return out


def fit(sample: pa.Table, p: Machine) -> pa.RecordBatch:
    """AdaGrad on the log loss, one example at a time in rank order. Feature -1 is the intercept."""
    make, examples = Features(p), []
    text, label = sample.column("text").combine_chunks(), sample.column("label").to_numpy()
    chars, done = sample.column("n_chars").to_numpy(zero_copy_only=False).astype(float), 0
    for piece in byte_slices(text, SLICE_BYTES):
        feature, row, value = make(piece, chars[done:done + len(piece)])
        cut = np.searchsorted(row, np.arange(len(piece) + 1))
        examples += [(feature[a:b], value[a:b]) for a, b in zip(cut, cut[1:])]
        done += len(piece)
    model = np.random.default_rng(7).normal(0, 0.1, (p.size, p.factors + 1))
    model[:, 0] = 0
    squares, intercept, isquare = np.full(model.shape, 1e-4), 0.0, 1e-4
    seen = np.zeros(p.size, bool)
    for _ in range(p.epochs):
        for (i, x), y in zip(examples, label):
            m = model[i]
            sums = x @ m[:, 1:]
            logit = intercept + x @ m[:, 0] + 0.5 * (sums @ sums - ((m[:, 1:] * x[:, None]) ** 2).sum())
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, logit)))) - y
            step = np.empty_like(m)
            step[:, 0] = g * x
            step[:, 1:] = (g * x)[:, None] * (sums - m[:, 1:] * x[:, None])
            step += p.l2 * m
            s = squares[i] + step * step
            squares[i] = s
            model[i] = m - p.rate * step / np.sqrt(s)
            isquare += g * g
            intercept -= p.rate * g / math.sqrt(isquare)
            seen[i] = True
    # features that no example has are left out, so they say nothing about a text
    kept = np.flatnonzero(seen)
    rows = [*model[kept].tolist(), [intercept] + [0.0] * p.factors]
    return pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(rows, pa.list_(pa.float64()))], names=["feature", "weights"])


def with_quality(docs: DataFrame, labels: DataFrame, params: Machine = Machine(), threshold: float = 0.7, out: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, n_chars) with ``out``, the probability of good quality, and ``predicted``.

    Labels (doc_id, quality) are learnt from at most ``params.rows`` rows whose
    crc32(doc_id as text) modulo 4 is not 2.  Null and empty texts have no words and
    are scored by their statistics; a null n_chars is a bin of its own; without any
    usable label every score is 0.  Repeated rows score alike, an empty table stays
    empty; columns named ``out`` or ``predicted`` are replaced, others pass through.
    """
    require(docs, "doc_id", "text", "n_chars")
    model = fitted(training_rows(docs, labels, "quality", params.rows, "n_chars"), lambda t: fit(t, params), "feature long, weights array<double>")
    # at most params.size rows of factors + 1 numbers
    found = {r.feature: r.weights for r in model}
    intercept = found.pop(-1, [None])[0]
    table = np.zeros((params.size, params.factors + 1), "f4")
    if found:
        table[list(found)] = list(found.values())
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        make, table = Features(params), shared.value
        for texts, chars in batches:
            if intercept is None:
                yield pa.array(np.zeros(len(texts)))
                continue
            out, done, chars = [np.zeros(0)], 0, chars.to_numpy(zero_copy_only=False).astype(float)
            for piece in byte_slices(texts, SLICE_BYTES):
                out.append(score(table, intercept, *make(piece, chars[done:done + len(piece)]), len(piece)))
                done += len(piece)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out), -700, 700))))

    scored = run(F.col("text"), F.col("n_chars").cast("double"))
    return docs.withColumn(out, scored).withColumn("predicted", (F.col(f"`{out}`") >= threshold).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return with_quality(docs.select("doc_id", "text", "n_chars"), labels, **more).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
