"""Quality: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

Tokens are the words of the text, case kept, and beside each the word's shape (runs of letters, capitals, digits and each
other byte); features are hashed one- and two-token sequences of both. A document is the vector of 1 + log(count) of its
features at unit length, and its score the logistic of a sparse dot product. FTRL-proximal visits a bounded sample of
labelled documents in a fixed order; scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, read
from .sampling import labelled_sample, remainder
from .text import flat, mixed, slices, span_hashes, word_bounds, word_hashes

BITS = 20
#: Most labelled documents that are fitted on, by label.
MOST = {0: 2000, 1: 3000}
SLICE = 2 << 20
PASSES = 3
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.001

#: Byte kinds for shapes: small letter or byte of a longer character, capital, digit; other bytes stand for themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[ord("a"):ord("z") + 1] = 1
KIND[128:] = 1
KIND[ord("A"):ord("Z") + 1] = 2
KIND[ord("0"):ord("9") + 1] = 3
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's kinds, runs of a kind taken once."""
    kinds = KIND[data]
    changes = np.empty(len(kinds), bool)
    changes[:1] = True
    changes[1:] = kinds[1:] != kinds[:-1]
    changes[starts] = True
    places = np.concatenate(([0], np.cumsum(changes)))
    return span_hashes(_CODES[kinds[changes]], places[starts], places[ends])


def _vectors(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text of a batch."""
    starts, ends, owner = word_bounds(offsets, data)
    keep = np.uint64(64 - BITS)
    streams = (word_hashes(data, starts, ends, fold=False), _shapes(data, starts, ends)) if len(starts) else ()
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            yield np.empty(0, np.int64), np.empty(0)
            continue
        own = []
        for salt, stream in enumerate(streams):
            words = stream[a:b]
            own.append(mixed(words + np.uint64(2 * salt + 1)) >> keep)
            own.append(mixed(words[:-1] * np.uint64(3) + mixed(words[1:] + np.uint64(2 * salt + 2))) >> keep)
        slots, counts = np.unique(np.concatenate(own).astype(np.int64), return_counts=True)
        values = 1 + np.log(counts)
        yield slots, values / np.sqrt((values ** 2).sum())


def _vector_rows(sample: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                slots, values = [], []
                for own, weight in _vectors(*flat(part.column(0))):
                    slots.append(own.astype("<u4").tobytes())
                    values.append(weight.astype("<f4").tobytes())
                yield pa.record_batch(
                    [pa.array(slots, pa.binary()), pa.array(values, pa.binary()), part.column(1)],
                    ["slots", "weights", "label"],
                )

    rows = sample.mapInArrow(work, "slots binary, weights binary, label int")
    rows = rows.orderBy(F.xxhash64("slots", "label")).toArrow()  # bounded by the sample; a fixed order
    vectors = [
        (np.frombuffer(s, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64))
        for s, v in zip(rows["slots"].to_pylist(), rows["weights"].to_pylist())
    ]
    return vectors, np.array(rows["label"].to_pylist(), np.float64)


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the slots and the bias. Without documents of both labels: no weights, and a bias that says how often
    label 1 was seen, 1 of 2 where nothing was."""
    vectors, labels = _vector_rows(sample)
    positive, negative = int(labels.sum()), int((1 - labels).sum())
    if not positive or not negative:
        return np.zeros(1 << BITS, np.float32), float(np.log((positive + 1) / (negative + 1)))
    # The last slot is the bias.
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def leader(slots: np.ndarray) -> np.ndarray:
        own = z[slots]
        over = np.maximum(np.abs(own) - L1, 0)
        return -np.sign(own) * over / ((BETA + np.sqrt(n[slots])) / ALPHA + L2)

    for _ in range(PASSES):
        for (slots, values), label in zip(vectors, labels):
            slots, values = np.append(slots, 1 << BITS), np.append(values, 1.0)
            weights = leader(slots)
            gradient = (1 / (1 + np.exp(-(weights @ values))) - label) * values
            sigma = (np.sqrt(n[slots] + gradient ** 2) - np.sqrt(n[slots])) / ALPHA
            z[slots] += gradient - sigma * weights
            n[slots] += gradient ** 2
    weights = leader(np.arange((1 << BITS) + 1))
    return weights[:-1].astype(np.float32), float(weights[-1])


def quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``score`` (0 to 1) of every row. Null text is scored as empty; rows that repeat give repeated rows.

    The model, 4 bytes for each of 2^20 slots however much was fitted on, goes to the workers as a broadcast variable.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                dots = [float(weights[slots] @ values) for slots, values in _vectors(*flat(part.column(1)))]
                scores = 1 / (1 + np.exp(-(bias + np.array(dots, np.float64))))
                yield pa.record_batch([part.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double")


@query()
def op4_quality(spark, folder):
    """Quality of every document, learnt from labelled ones outside the held-out fifth."""
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = fit(labelled_sample(docs, labels, "quality", remainder("__id", 5) != 0, MOST))
    return quality(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
