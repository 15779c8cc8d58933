"""Toxicity: a linear classifier on character n-grams, features scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams of the lower-cased text, each counted once per document. Fitting reads a bounded sample
of labelled documents: smoothed document counts per class give each feature its log-count ratio r, and logistic regression
on the features times r gives weights. A score is the logistic of the summed weight * r of a document's distinct features
over the root of a damped feature count, so long documents are comparable with short ones. Scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, read
from .sampling import labelled_sample, remainder
from .text import LOWER, SPACE, flat, slices

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Most labelled documents that are fitted on, by label.
MOST = {0: 3000, 1: 1500}
SLICE = 2 << 20
ROUNDS = 60
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_slots(text: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashed slot of each n-gram of one text (bytes), all orders, repeats included. White space is one kind of byte."""
    codes = LOWER[text].astype(np.uint64)
    codes[SPACE[text]] = 32
    # One space on both sides, so that first and last words look like others.
    codes = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)])) if len(codes) else codes
    out, held = [], codes
    for order in range(2, max(orders) + 1):
        if len(codes) < order:
            break
        held = held[:-1] * np.uint64(257) + codes[order - 1:]
        if order in orders:
            out.append((held * _STEP + np.uint64(order)) * _STEP >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


class Distinct:
    """Distinct values of small non-negative integers without sorting."""

    def __init__(self, size: int) -> None:
        self.last = np.zeros(size, np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values))
        self.last[values] = at
        return values[self.last[values] == at]


def _features(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct slots of each sampled document, and the labels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct(1 << BITS)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                offsets, data = flat(part.column(0))
                own = [
                    np.sort(distinct(ngram_slots(data[a:b]))).astype("<u4").tobytes()
                    for a, b in zip(offsets[:-1], offsets[1:])
                ]
                yield pa.record_batch([pa.array(own, pa.binary()), part.column(1)], ["slots", "label"])

    rows = sample.mapInArrow(work, "slots binary, label int").toArrow()
    slots = [np.frombuffer(s, "<u4") for s in rows["slots"].to_pylist()]
    return slots, np.array(rows["label"].to_pylist(), np.float64)


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of each slot (its ratio included) and the bias. Without documents of both labels: no weights, and a bias
    that says how often label 1 was seen, 1 of 2 where nothing was."""
    documents, labels = _features(sample)
    positive, negative = int(labels.sum()), int((1 - labels).sum())
    weights = np.zeros(1 << BITS, np.float32)
    bias = float(np.log((positive + 1) / (negative + 1)))
    if not positive or not negative:
        return weights, bias
    counts = np.zeros((2, 1 << BITS))
    for own, label in zip(documents, labels):
        counts[int(label), own] += 1
    ratio = np.log((counts[1] + 1) / (positive + 2) / ((counts[0] + 1) / (negative + 2)))
    # Left out: slots whose ratio is within three standard errors of 0, as chance makes it in a few documents.
    useful = np.abs(ratio) > 3 * np.sqrt(1 / (counts[0] + 1) + 1 / (counts[1] + 1))
    number = np.cumsum(useful) - 1
    scale, columns, rows = [], [], []
    for row, own in enumerate(documents):
        scale.append(1 / _length(len(own)))
        kept = own[useful[own]]
        columns.append(number[kept])
        rows.append(np.full(len(kept), row))
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    values = ratio[useful][columns] * np.array(scale)[rows]
    # Newton-like steps by feature: gradients over all sampled documents, each step divided by its own curvature history.
    own_weights, sums, intercept, intercept_sum = np.zeros(int(useful.sum())), np.full(int(useful.sum()), 1e-8), 0.0, 1e-8
    balance = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * negative))
    for _ in range(ROUNDS):
        z = intercept + np.bincount(rows, values * own_weights[columns], len(labels))
        error = balance * (1 / (1 + np.exp(-z)) - labels) / len(labels)
        gradient = np.bincount(columns, values * error[rows], len(own_weights)) + 1e-6 * own_weights
        sums += gradient ** 2
        own_weights -= 0.3 * gradient / np.sqrt(sums)
        step = error.sum()
        intercept_sum += step ** 2
        intercept -= 0.3 * step / np.sqrt(intercept_sum)
    weights[useful] = own_weights * ratio[useful]
    return weights, float(intercept)


def _length(distinct: int) -> float:
    return float(np.sqrt(100 + distinct))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``score`` (0 to 1) of every row. Null text is scored as empty; rows that repeat give repeated rows.

    The model, 4 bytes for each of 2^20 slots however much was fitted on, goes to the workers as a broadcast variable.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        distinct = Distinct(len(weights))
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                offsets, data = flat(part.column(1))
                scores = np.empty(part.num_rows)
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = distinct(ngram_slots(data[a:b]))
                    z = bias + float(weights[own].sum(dtype=np.float64)) / _length(len(own))
                    scores[row] = 1 / (1 + np.exp(-z))
                yield pa.record_batch([part.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double")


@query()
def op1_toxicity(spark, folder):
    """Toxicity of every document, learnt from labelled ones outside the held-out third."""
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = fit(labelled_sample(docs, labels, "toxic", remainder("__id", 3) != 1, MOST))
    return toxicity(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
