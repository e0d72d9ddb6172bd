"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .tokens import Vocabulary, hashed
from .training import training_sample

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the features and of the updates."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 3
    max_rows: int = 6_000  # labelled documents that the model is fitted on
    threshold: float = 0.7
    seed: int = 11


def features(text: str | None, bits: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the hashed n-grams of a text: shares of its tokens, and a bias.

    Of each token: its word, its shape, its bigram with the token before, the bigram of their
    shapes, and whether it repeats that token.
    """
    t = hashed(text, vocabulary)
    n = len(t)
    shift = np.uint64(64 - bits)
    length = np.array([n.bit_length() + 1], np.uint64) * _B
    if not n:
        return np.array([0, int(length[0] >> shift)], np.int64), np.array([1.0, 1.0])
    shape = t & np.uint64(0xFF)
    with np.errstate(over="ignore"):
        grams = np.concatenate(
            [
                (t | np.uint64(0xFF)) * _A,
                (shape + np.uint64(1)) * _B,
                ((t[:-1] ^ (t[1:] >> np.uint64(7))) * _A + t[1:]) * _B,
                ((shape[:-1] << np.uint64(8)) + shape[1:] + np.uint64(0x10000)) * _A,
                np.repeat(np.array([0xABCDEF], np.uint64) * _A, int((t[1:] == t[:-1]).sum())),
            ]
        )
    index, count = np.unique((grams >> shift).astype(np.int64), return_counts=True)
    return np.r_[index, 0, int(length[0] >> shift)], np.r_[count / np.sqrt(n) / 4, 1.0, 1.0]


def fit(rows: Iterator[tuple[int, str]], how: Ftrl) -> np.ndarray:
    """FTRL-proximal over the rows, ``epochs`` times in their order; the dense weights."""
    size = 1 << how.bits
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        return np.where(np.abs(zi) <= how.l1, 0.0, w)

    vocabulary = Vocabulary()
    examples = []
    for label, text in rows:
        i, x = features(text, how.bits, vocabulary)
        i, back = np.unique(i, return_inverse=True)
        examples.append((label, i.astype(np.int32), np.bincount(back, x).astype(np.float32)))
    for _ in range(how.epochs):
        for label, i, x in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / how.alpha * w
            n[i] += g2
    return weights(np.arange(size)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, how: Ftrl) -> np.ndarray | None:
    """Weights fitted in one task on a bounded sample; None where nothing is labelled."""
    sample = training_sample(docs, labels, label, how.max_rows, how.seed)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("order", "label", "text")), strict=True)]
        rows.sort(key=lambda r: (r[0], r[2] or ""))
        if rows:
            w = fit([r[1:] for r in rows], how)
            yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()]})

    found = sample.repartition(1).mapInArrow(fitted, "weights binary").collect()
    return np.frombuffer(found[0].weights, np.float32) if found else None


def quality_scores(docs: DataFrame, labels: DataFrame, how: Ftrl | None = None) -> DataFrame:
    """Score every document (doc_id, text) by a model of ``labels`` (doc_id, quality 0/1).

    Only labelled documents that are not held out are learned from, and of these a sample of about
    ``max_rows``; the score is the sigmoid of a sparse dot product of the text's features and
    nothing else. Scoring needs no shuffle. Defined cases: null and empty texts have the bias and
    length features only; without any label every score is 0.5; a document labelled twice counts
    with the higher label; repeated rows are scored one by one; other columns are ignored.
    Returns doc_id, held_out, score and predicted (1 where score >= ``threshold``).
    """
    small_batches(docs.sparkSession)
    how = how or Ftrl()
    weights = train(docs, labels, "quality", how)
    if weights is None:
        weights = np.zeros(1 << how.bits, np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, vocabulary = shared.value, Vocabulary()
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                i, x = features(text.as_py(), how.bits, vocabulary)
                scores.append(1 / (1 + np.exp(-np.clip(w[i] @ x, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return (
        docs.select("doc_id", "text")
        .mapInArrow(scored, schema)
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= how.threshold).cast("int").alias("predicted"),
        )
    )
