"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.llm.common import ALNUM, utf8
from careline.llm.sample import labelled_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
STEM = 5
REMEMBERED = 200_000
#: Strength of the Dirichlet priors: a stem is drawn to the corpus, a word to its stem.
STEM_PRIOR, WORD_PRIOR = 4.0, 4.0
#: Taken from each token's log-odds, so that neutral text scores below zero. A word that
#: repeats the one before it is no new evidence and scores the loss alone.
DRIFT = 2.0
#: A passage is significant if fewer than this many as good are expected in a clean text.
SIGNIFICANT = 0.01
EULER = 0.5772156649015329


class Buckets(dict):
    """Word to (word bucket, stem bucket), packed in one number."""

    def __missing__(self, word: bytes) -> int:
        mask = (1 << BITS) - 1
        stem = word.decode("utf-8", "replace")[:STEM].encode()
        self[word] = code = ((xxhash.xxh64_intdigest(word, 1) & mask) << BITS
                             | xxhash.xxh64_intdigest(stem, 2) & mask)
        return code

    def of(self, text: bytes) -> np.ndarray:
        words = text.translate(ALNUM).split()
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one scan over the positive runs.

    Candidates lie on a list with their cumulative sums at both ends; each points to the last
    one before it that starts lower, so finding it is linear over the whole scan.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    total = np.concatenate(([0.0], np.cumsum(scores)))
    starts, ends = edges[::2], edges[1::2]
    found: list[tuple[float, float, int, int, int]] = []  # low, high, start, end, lower one
    for start, end, low, high in zip(starts.tolist(), ends.tolist(), total[starts].tolist(),
                                     total[ends].tolist(), strict=True):
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, start, end, j))
                break
            low, start = found[j][0], found[j][2]
            lower = found[j][4]
            del found[j:]
            j = lower
    return [(start, end, high - low) for low, high, start, end, _ in found]


@dataclass
class Model:
    """Scores of word buckets given their stems, decay and size of the clean maxima, calibration."""

    toxic: np.ndarray = field(repr=False)
    clean: np.ndarray = field(repr=False)
    stem_share: np.ndarray = field(repr=False)
    base: float = 0.5
    decay: float = 1.0
    log_size: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, codes: np.ndarray) -> np.ndarray:
        word, stem = codes >> BITS, codes & ((1 << BITS) - 1)
        share = ((self.toxic[word] + WORD_PRIOR * self.stem_share[stem])
                 / (self.toxic[word] + self.clean[word] + WORD_PRIOR))
        out = np.log(share / (1 - share)) - np.log(self.base / (1 - self.base)) - DRIFT
        out[1:][codes[1:] == codes[:-1]] = -DRIFT
        return out

    def passages(self, codes: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Start, end, score, and how many as good a clean text would have: fewer than one."""
        out = []
        for start, end, s in segments(self.scores(codes)):
            expected = float(np.exp(min(50.0, self.log_size + np.log(len(codes))
                                        - self.decay * s)))
            if expected < 1:
                out.append((start, end, s, expected))
        return out

    def probability(self, strength: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * strength + self.offset, -40, 40))))


def strength_of(passages: list[tuple[int, int, float, float]]) -> float:
    """Sum of the passages' evidence, each the negative logarithm of its expected number."""
    return float(np.log1p(sum(-np.log(max(e, 1e-300)) for *_, e in passages)))


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of either label that hold a word or stem: [word or stem, label, bucket]; and the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Buckets(), np.zeros((2, 2, 1 << BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                codes = np.unique(known.of(text.as_py()))
                # Words count once a document; a stem once for each of its words.
                np.add.at(n[0, y], codes >> BITS, 1)
                np.add.at(n[1, y], codes & ((1 << BITS) - 1), 1)
        kind, y, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(y.astype(np.int32)),
             pa.array(at.astype(np.int32)), pa.array(n[kind, y, at])], ["kind", "y", "at", "n"])

    got = (sample.mapInArrow(run, "kind int, y int, at int, n long")
           .groupBy("kind", "y", "at").agg(F.sum("n").alias("n"))).toPandas()
    counts = np.zeros((2, 2, 1 << BITS))
    counts[got["kind"], got["y"], got["at"]] = got["n"]
    return counts, counts.sum(axis=2)


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(decay * score)) = 1 over clean tokens."""
    p = weights / max(1.0, weights.sum())
    high = lambda x: float((p * np.exp(np.minimum(x * scores, 60.0))).sum()) > 1
    low, top = 0.0, 1.0
    while not high(top) and top < 8:
        top *= 2
    for _ in range(60):
        mid = (low + top) / 2
        low, top = (low, mid) if high(mid) else (mid, top)
    return max(low, 0.05)


def train(sample: DataFrame) -> Model:
    """Priors and counts, then the maxima of clean texts, then the calibration.

    The driver gets the counts of 4 * 2 ** BITS buckets and three small aggregates; the last one
    holds strengths in steps of 1/64.
    """
    counts, sums = _counts(sample)
    base = float(np.clip((sums[0, 1] + 1) / (sums[0].sum() + 2), 1e-4, 1 - 1e-4))
    share = (counts[1, 1] + STEM_PRIOR * base) / (counts[1].sum(axis=0) + STEM_PRIOR)
    model = Model(counts[0, 1].astype(np.float32), counts[0, 0].astype(np.float32),
                  share.astype(np.float32), base)
    # The share of clean tokens at each score, with the stem's share taken at its own mean.
    word = (model.toxic + WORD_PRIOR * base) / (model.toxic + model.clean + WORD_PRIOR)
    model.decay = _decay(np.log(word / (1 - word)) - np.log(base / (1 - base)) - DRIFT,
                         model.clean.astype(float))
    parts = model.toxic, model.clean, model.stem_share, model.base, model.decay

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(*parts), Buckets()
        for batch in batches:
            out = []
            for text in batch.column(1):
                codes = known.of(text.as_py())
                best = max((s for *_, s in segments(own.scores(codes))), default=0.0)
                out.append(own.decay * best - np.log(max(1, len(codes))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["x"])

    mean = sample.filter("y = 0").mapInArrow(maxima, "x double").agg(
        F.avg(F.round("x", 6).cast("decimal(18,6)")).cast("double")).first()[0]
    model.log_size = (mean if mean is not None else 0.0) - EULER
    parts = *parts, model.log_size

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(*parts), Buckets()
        for batch in batches:
            at = [round(64 * strength_of(own.passages(known.of(t.as_py()))))
                  for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(at, pa.int32())],
                                             ["y", "at"])

    seen = (sample.mapInArrow(strengths, "y int, at int").groupBy("y", "at")
            .agg(F.count("*").alias("n"))).toPandas()
    model.slope, model.offset = _logistic(seen["at"].to_numpy(float) / 64,
                                          seen["y"].to_numpy(float), seen["n"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counted points, by Newton steps."""
    a, b = 1.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w, r = n * p * (1 - p), n * (p - y)
        grad = np.array([(r * x).sum() + ridge * a, r.sum() + ridge * b])
        hess = np.array([[(w * x * x).sum() + ridge, (w * x).sum()],
                         [(w * x).sum(), w.sum() + ridge]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def find_passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages), one row for each row of `docs`.

    passages: every significant maximal segment of the whole text, with its first word, the word after its
    last, its score and the number of such segments a clean text of this length would have. score
    is the calibrated probability of label 1. NULL and empty texts have no passages and the score
    of none; repeated rows each get a row; other columns are ignored.
    """
    parts = (model.toxic, model.clean, model.stem_share, model.base, model.decay, model.log_size,
             model.slope, model.offset)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                         ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(*parts), Buckets()
        for batch in batches:
            found = [own.passages(known.of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([own.probability(strength_of(f)) for f in found], pa.float64()),
                 pa.array([[dict(zip(("start", "end", "score", "expected"), p, strict=True))
                            for p in f if p[3] <= SIGNIFICANT] for f in found],
                          pa.list_(passage))],
                ["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       utf8(F.col("text")).alias("text")).mapInArrow(
        run, "doc_id long, score double, passages array<struct<start:long,end:long,"
             "score:double,expected:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column,
             max_rows: int = 50_000) -> DataFrame:
    """`find_passages` by a model of at most `max_rows` labelled documents that meet `learn`."""
    return find_passages(docs, train(labelled_sample(docs, labels, "toxic", learn, max_rows)))
