"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.llm.common import LOWER, utf8
from careline.llm.sample import labelled_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
#: Words whose features are counted at once, and words that a task remembers.
CHUNK, REMEMBERED = 100_000, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Learning rate, its floor, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-3


class Hashed(dict):
    """Word to hash, by a function of the word; forgets when it has grown large."""

    def __init__(self, form) -> None:
        super().__init__()
        self._form = form

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(self._form(word), 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_shape(word: bytes) -> bytes:
    """Runs of letters and digits as one sign each, other characters as they are, each run once."""
    shape = re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", word))
    return b"\0" + re.sub(rb"(.)\1+", rb"\1\1", re.sub(rb"[0-9]+", b"9", shape))[:24]


class Features:
    """Indices and values of a text: uni- and bigrams of words and of word shapes."""

    def __init__(self, bits: int = BITS) -> None:
        self._size = 1 << bits
        self._words, self._shapes = Hashed(lambda w: w.translate(LOWER)), Hashed(word_shape)

    def _hashes(self, words: list[bytes], first: bool) -> np.ndarray:
        w, s = self._words.of(words), self._shapes.of(words)
        grams = [w[1:] ^ (w[:-1] * MIX), s[1:] ^ (s[:-1] * MIX)]
        same = np.full(int((w[1:] == w[:-1]).sum()), 11, np.uint64)
        start = 0 if first else 1  # the word carried over from the chunk before
        every = np.concatenate([w[start:], s[start:], *grams, same])
        return ((every * MIX) >> np.uint64(40)).astype(np.int64) & (self._size - 1)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(words) <= CHUNK:
            at, n = np.unique(self._hashes(words, True), return_counts=True)
        else:
            dense = np.zeros(self._size, np.int64)
            for start in range(0, len(words), CHUNK):
                part = words[max(0, start - 1):start + CHUNK]
                dense += np.bincount(self._hashes(part, start == 0), minlength=self._size)
            at = np.nonzero(dense)[0]
            n = dense[at]
        values = np.sqrt(n)
        return at, values / np.sqrt((values * values).sum())


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ values, -40, 40))))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int,
         weight: dict[int, float]) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader, per-coordinate rates; the last place is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for at, values, y in examples:
            at, values = np.append(at, size), np.append(values, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0,
                         -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ values, -40, 40)))
            g = (p - y) * weight[y] * values
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0,
                 -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:size], float(w[size])


def train(sample: DataFrame, bits: int = BITS, shards: int = 4, epochs: int = 10) -> Model:
    """Shards learn apart, each from its part of the bounded sample; their weights are averaged.

    The driver gets at most 2 ** bits weights. Without examples every score is one half.
    """
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            pairs = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([a.astype(np.int32) for a, _ in pairs], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in pairs], pa.list_(pa.float32()))],
                ["doc_id", "y", "at", "values"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(h=[xxhash.xxh64_intdigest(str(i), 3) for i in rows["doc_id"]])
        rows = rows.sort_values(["h", "doc_id"])
        examples = [(np.asarray(a, np.int64), np.asarray(v, np.float64), int(y))
                    for a, v, y in zip(rows["at"], rows["values"], rows["y"], strict=True)]
        # The rarer label counts for up to ten of the other.
        ones = max(1, int(rows["y"].sum()))
        zeros = max(1, len(rows) - ones)
        weight = {0: min(10.0, max(1.0, ones / zeros)), 1: min(10.0, max(1.0, zeros / ones))}
        w, bias = ftrl(examples, 1 << bits, epochs, weight)
        at = np.nonzero(w)[0]
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], bias)})

    parts = (sample.mapInArrow(featured, "doc_id long, y int, at array<int>, values array<float>")
             .groupBy(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"))
             .applyInPandas(learn, "at long, w double"))
    got = parts.groupBy("at").agg(F.sum(F.round(F.col("w"), 9).cast("decimal(28,9)"))
                                  .cast("double").alias("w"), F.count("*").alias("n")).toPandas()
    if got.empty:
        return Model(np.zeros(1 << bits), 0.0, bits)
    n = float(got.loc[got["at"] == -1, "n"].iloc[0])
    weights, own = np.zeros(1 << bits), got["at"] >= 0
    weights[got.loc[own, "at"].to_numpy(np.int64)] = got.loc[own, "w"].to_numpy() / n
    return Model(weights.astype(np.float32), float(got.loc[~own, "w"].iloc[0]) / n, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text: sparse dot product, through the logistic function.

    NULL and empty texts have no features and get the score of the bias; repeated rows each get a row.
    """
    weights, bias, bits = model.weights, model.bias, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(bits), Model(weights, bias, bits)
        for batch in batches:
            scores = [own.score(*features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       utf8(F.col("text")).alias("text")).mapInArrow(
        run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs`, with all their columns, whose whole text scores `least` or more."""
    weights, bias, bits = model.weights, model.bias, model.bits
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(bits), Model(weights, bias, bits)
        for batch in batches:
            stays = [own.score(*features((t.as_py() or "").encode())) >= least
                     for t in batch.column(at)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 40_000) -> DataFrame:
    """(doc_id, score): how likely each document has quality 1.

    Learns from at most `max_rows` labelled documents whose doc_id meets `learn`; only their texts
    and labels are used, no other column. Results don't depend on the order of rows.
    """
    return score(docs, train(labelled_sample(docs, labels, "quality", learn, max_rows)))
