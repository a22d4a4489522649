"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.labels import held_out, training_rows

#: Labelled rows the model is fitted on, at most.
TRAINING_ROWS = 8000
#: Hash buckets; the model has one weight for each at most.
BUCKETS = 1 << 18
EPOCHS = 2
_TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Feature 0 is constant, feature 1 counts word pairs that the text has had before.
_CONSTANT, _AGAIN, _FIRST = 0, 1, 2
#: Distinct words whose hash a worker remembers at a time.
_REMEMBERED = 200_000


class _Hashes(dict):
    """Hashes of words, computed once; emptied when it has grown."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        # Runs of the same sign are one feature.
        value = zlib.crc32((word[:3] if not word[0].isalnum() else word).encode())
        self[word] = value
        return value


class Features(NamedTuple):
    at: np.ndarray
    value: np.ndarray


def features(text: str, hashes: _Hashes, buckets: int = BUCKETS) -> Features:
    """Counts of hashed words and word pairs, scaled to length one, and the constant feature."""
    tokens = _TOKENS.findall(text)
    words = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    pairs = (words[:-1] * np.uint64(0x9E3779B1) + words[1:] * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    distinct, counts = np.unique(pairs, return_counts=True)
    width = np.uint64(buckets - _FIRST)
    one, n_one = np.unique(words % width, return_counts=True)
    two = (distinct ^ (distinct >> np.uint64(15))) % width
    again = len(pairs) - len(distinct)
    at = np.concatenate([[_CONSTANT, _AGAIN], one + np.uint64(_FIRST), two + np.uint64(_FIRST)]).astype(np.int64)
    value = np.concatenate([[0.0, again], n_one, counts]).astype(np.float64)
    length = np.sqrt((value * value).sum())
    if length:
        value /= length
    value[0] = 1.0
    return Features(at, value)


def fit(examples: list[tuple[str, int]], buckets: int = BUCKETS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights by follow-the-regularised-leader updates, one example at a time."""
    z, n = np.zeros(buckets), np.zeros(buckets)
    hashes = _Hashes()

    def weights(at: np.ndarray) -> np.ndarray:
        far = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -far / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(EPOCHS):
        for text, label in examples:
            at, value = features(text, hashes, buckets)
            w = weights(at)
            guess = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            gradient = (guess - label) * value
            sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / alpha
            np.add.at(z, at, gradient - sigma * w)
            np.add.at(n, at, gradient * gradient)
    return weights(np.arange(buckets))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, buckets: int = BUCKETS) -> np.ndarray:
    """Weights learned in one task from at most ``rows`` labelled rows; zero weights without any."""
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = pd.concat([pd.DataFrame({"text": [], "label": []}), *batches])
        weights = fit(list(zip(examples["text"], examples["label"])), buckets)
        used = np.flatnonzero(weights)
        yield pd.DataFrame({"at": used, "weight": weights[used]})

    ordered = training_rows(documents, labels, label, rows).repartition(1).sortWithinPartitions("rank", "text")
    learned = ordered.mapInPandas(learn, "at long, weight double").collect()
    weights = np.zeros(buckets)
    for at, weight in learned:  # at most one for each bucket
        weights[at] = weight
    return weights


def score(documents: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, held_out, score, predicted.

    The score is the logistic function of the sparse dot product of a text's
    features with the weights. Null and empty texts have the constant feature only.
    Repeated rows each get their row; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # one number for each bucket
    kind = documents.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = shared.value, _Hashes()
        for batch in batches:
            sums = []
            for item in batch["text"]:
                at, value = features(item.as_py() or "", hashes, len(table))
                sums.append(float(table[at] @ value))
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    rated = documents.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, score double")
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
