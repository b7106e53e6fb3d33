"""SentencePiece encoding by a single-pass Viterbi over an Aho-Corasick automaton, and decoding."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
#: Below the lowest score: what a character without a piece costs.
UNKNOWN_PENALTY = 10.0
#: Parts of texts whose pieces a task remembers, in each of two generations, and the longest.
REMEMBERED, LONGEST = 250_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores of a model file; ids of the bytes 0 to 255 if it has them."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    matched: tuple[int, ...]
    byte_ids: tuple[int, ...]
    unknown: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        bytes_ = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
        return cls(tuple(model.id_to_piece(i) for i in ids), tuple(map(model.get_score, ids)),
                   tuple(i for i in ids if not (model.is_byte(i) or model.is_control(i)
                                                or model.is_unknown(i) or model.is_unused(i))),
                   tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)) if len(bytes_) == 256 else (),
                   model.unk_id())


class Remembered(dict):
    """Pieces by part of a text. When full it becomes the old generation, from which parts that come
    again are taken back, so frequent ones are never worked out anew."""

    def __init__(self, work) -> None:
        super().__init__()
        self._work, self._old = work, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self._old.get(part)
        if ids is None:
            ids = tuple(self._work(part)[0])
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self._old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """The best-scoring pieces of a text.

    Score of a segmentation: the sum of its pieces' scores. Of equal ones the longer last piece wins. A
    character without a piece of its own becomes its bytes (or the unknown piece) at ten below
    the lowest score. Where no piece continues behind a space sign, the text is cut before
    space signs: the best pieces of the parts are the best pieces of the whole.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self._vocabulary = vocabulary
        self._automaton = ahocorasick.Automaton()
        for i in v.matched:
            self._automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i))
        self._automaton.make_automaton()
        self._single = {v.pieces[i] for i in v.matched if len(v.pieces[i]) == 1}
        self._lowest = min((v.scores[i] for i in v.matched), default=0.0) - UNKNOWN_PENALTY
        crossing = any(SPACE in v.pieces[i].lstrip(SPACE) for i in v.matched)
        self._chunks = re.compile(r".+" if crossing else f"{SPACE}+[^{SPACE}]*", re.DOTALL)
        self._known = Remembered(self.best)

    def best(self, text: str) -> tuple[list[int], float]:
        """Pieces of a normalised text and their score.

        The automaton reports every piece that ends at a character, longest first, along its output
        links; each relaxes the best score of that place from the place where it starts.
        """
        scores, back = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        matches = self._automaton.iter(text)
        match = next(matches, None)
        for end, char in enumerate(text):
            most, by = -np.inf, -1
            while match is not None and match[0] == end:
                length, score, piece = match[1]
                if (value := scores[end + 1 - length] + score) > most:
                    most, by = value, piece
                match = next(matches, None)
            if char not in self._single and (value := scores[end] + self._lowest) > most:
                most, by = value, -1
            scores[end + 1], back[end + 1] = most, by
        ids: list[int] = []
        at, v = len(text), self._vocabulary
        while at:
            if back[at] < 0:
                ids += ([v.byte_ids[b] for b in reversed(text[at - 1].encode())]
                        if v.byte_ids else [v.unknown])
                at -= 1
            else:
                ids.append(back[at])
                at -= len(v.pieces[back[at]])
        return ids[::-1], scores[-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = self._chunks.findall(SPACE + text.replace(" ", SPACE))
        return np.fromiter(chain.from_iterable(map(self._known.__getitem__, parts)), np.int32)


class Decoder:
    """Texts of ids; bytes in a row are put together, one space sign at the start is dropped."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self._bytes = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self._bytes[i] = bytes([b])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self._bytes.__getitem__, ids.tolist())).decode(
            "utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip), one row for each row of `docs`.

    ids are the best-scoring pieces of the whole text (spaces as the sign U+2581, one put first, nothing
    else normalised). round_trip: decoding gives the text again, U+2581 in it read as space. NULL
    and empty texts have no ids. Repeated rows each get a row; other columns are ignored. The model file is
    read by the driver; a vocabulary, whose size doesn't depend on the data, goes to the tasks.
    """
    vocabulary = Vocabulary.load(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            ids, trips = [], []
            for value in batch.column(1):
                text = value.as_py()
                ids.append(encoder.encode(text))
                trips.append(decoder.decode(ids[-1]) == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array(trips, pa.bool_())],
                ["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; ids of NULL are an empty text."""
    vocabulary = Vocabulary.load(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = [decoder.decode(np.asarray(ids or [], np.int64))
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        run, "doc_id long, text string")
