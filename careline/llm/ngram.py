"""Trigram language model as a weighted backoff automaton, counted and applied block by block.

A block is some thousand documents. It asks for the corpus counts of its own distinct n-grams
only, so nothing grows with the vocabulary: counts are summed in ranges of hashes and go back to
the blocks that asked. The tables of a range and of a block are of bounded size.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.llm.common import folded_words, utf8, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of the longest n-gram; histories have up to one less.
ORDER = 3
#: Tokens of a block; a longer document is cut into pieces that carry the state over.
BLOCK_TOKENS = 1_000_000
#: Entries of a range of hashes, over all blocks, at most about.
RANGE_ENTRIES = 3_000_000
REMEMBERED = 300_000
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Bits of the hash of an n-gram beyond the logarithm of their number: at every size of the corpus
#: about one n-gram of a million shares its hash with another. Words have 64 bits.
SPARE_BITS = 20
#: Classes of histories by the bit length of their count; each has discounts of its own.
CLASSES = 64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = folded_words(text)
        if len(self) > REMEMBERED:
            self.clear()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def chained(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of each history with the word after it."""
    pair = (histories * np.uint64(0x9E3779B97F4A7C15)) ^ words
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return pair ^ (pair >> np.uint64(32))


def planed(numbers: np.ndarray) -> bytes:
    """Small numbers in few bytes: byte planes, Zstandard."""
    planes = numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unplaned(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers, as their differences."""
    return planed(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


BLOCKS = ("block long, doc_ids array<string>, rows array<long>, held array<boolean>, "
          "lengths array<int>, leads array<int>, tokens binary, words binary, "
          "n_grams long, n_train long")


def make_blocks(docs: DataFrame, learn: Column, block_tokens: int) -> DataFrame:
    """Documents as runs of indices into the block's distinct word hashes, frequent ones first.

    leads: how many tokens at the start of a piece are the last ones of the piece before; they
    carry the state over and are not scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        next_id = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []
        size, n_docs, n_blocks = 0, 0, 0

        def flushed() -> pa.RecordBatch:
            ids, rows, held, leads, hashes = zip(*pieces, strict=True)
            tokens = np.concatenate(hashes)
            words, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            at = np.argsort(order)[at]
            train = sum(len(h) - lead for h, own, lead in zip(hashes, held, leads, strict=True)
                        if not own)
            squeeze = zstandard.ZstdCompressor(level=1).compress
            planes = at.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()
            return pa.RecordBatch.from_pydict(
                {"block": [next_id + n_blocks], "doc_ids": [list(ids)],
                 "rows": [[next_id + r for r in rows]],
                 "held": [list(held)], "lengths": [[len(h) for h in hashes]],
                 "leads": [list(leads)], "tokens": [squeeze(planes.tobytes())],
                 "words": [planed(words[order])], "n_grams": [len(words) + (ORDER - 1) * len(tokens)],
                 "n_train": [train]}, schema)

        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.string())),
                            ("rows", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                            ("lengths", pa.list_(pa.int32())), ("leads", pa.list_(pa.int32())),
                            ("tokens", pa.binary()), ("words", pa.binary()),
                            ("n_grams", pa.int64()), ("n_train", pa.int64())])
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, own, text in zip(ids, held, batch.column(1), strict=True):
                hashes, start = known.of(text.as_py()), 0
                while start < len(hashes):
                    lead = min(start, ORDER - 1)
                    end = min(len(hashes), start + max(1, block_tokens - size))
                    pieces.append((doc_id, n_docs, own, lead, hashes[start - lead:end]))
                    size += end - start + lead
                    start = end
                    if size >= block_tokens:
                        yield flushed()
                        pieces, size, n_blocks = [], 0, n_blocks + 1
                n_docs += 1
        if pieces:
            yield flushed()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"),
                       utf8(F.col("text")).alias("text"), (~learn).alias("held"))
    return rows.mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens, and for each length its distinct n-grams and which of them ends where.

    width: leading bits of the hash that tell n-grams of several words apart.
    place: how many tokens of its piece stand before a token; an n-gram of k + 1 words ends
    where it is at least k.
    """

    def __init__(self, row: dict, width: int) -> None:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.uint8)
        at = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
        words, back = np.unique(unplaned(row["words"]), return_inverse=True)
        at = back[at]
        lengths = np.asarray(row["lengths"], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        piece = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(at)) - self.starts[piece]
        self.scored = self.place >= np.asarray(row["leads"], np.int64)[piece]
        self.counted = self.scored & ~np.asarray(row["held"], bool)[piece]
        self.grams, self.at = [words], [at]
        tokens = gram = words[at]
        low = np.uint64(64 - width)
        for k in range(1, ORDER):
            gram = chained(gram[:-1], tokens[k:])
            ends = np.flatnonzero(self.place[k:] >= k)
            distinct, ids = np.unique(gram[ends] >> low << low, return_inverse=True)
            at = np.zeros(len(tokens), np.int64)
            at[ends + k] = ids
            self.grams.append(distinct)
            self.at.append(at)

    def own_counts(self) -> list[np.ndarray]:
        return [np.bincount(self.at[k][self.counted & (self.place >= k)],
                            minlength=len(self.grams[k])) for k in range(ORDER)]


def _classes_of(counts: np.ndarray) -> np.ndarray:
    """Bit length of each count."""
    return np.frexp(counts.astype(np.float64))[1]


def singles_and_mass(block: Block, totals: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Training tokens whose n-gram occurs this one time, and all, by length and class of history.

    An n-gram that occurs once does so in one block, so sums over blocks are corpus counts.
    """
    singles, mass = [], []
    for k in range(1, ORDER):
        ends = np.flatnonzero(block.counted & (block.place >= k))
        classes = _classes_of(totals[k - 1][block.at[k - 1][ends - 1]])
        once = totals[k][block.at[k][ends]] == 1
        singles += np.bincount(classes[once], minlength=CLASSES).tolist()
        mass += np.bincount(classes, minlength=CLASSES).tolist()
    return singles, mass


def _ranges_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The range of each hash: its leading bits."""
    return ((hashes >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)


_OF = [*range(ORDER)]
REQUESTS = "part long, block long, " + ", ".join(f"grams{k} binary, own{k} binary" for k in _OF)
ANSWERS = "part long, block long, vocabulary long, " + ", ".join(f"totals{k} binary" for k in _OF)


def requests(blocks: DataFrame, bits: int, width: int) -> DataFrame:
    """For each block and range of hashes: the hashes, and their counts in training documents.

    A block has a row for each of the 2 ** bits ranges in which it has a hash: never more
    rows than hashes, however many ranges and blocks there are.
    """

    def rows_of(block_id: int, block: Block) -> pa.RecordBatch:
        counts = block.own_counts()
        places = [_ranges_of(h, bits) for h in block.grams]
        parts = np.unique(np.concatenate(places))
        columns = {"part": pa.array(parts), "block": pa.array([block_id] * len(parts), pa.int64())}
        for k in _OF:
            cuts = [slice(*c) for c in zip(np.searchsorted(places[k], parts, "left"),
                                           np.searchsorted(places[k], parts, "right"), strict=True)]
            columns[f"grams{k}"] = pa.array([packed(block.grams[k][c]) for c in cuts], pa.binary())
            columns[f"own{k}"] = pa.array([planed(counts[k][c]) for c in cuts], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block in Python at a time
                (row,) = batch.slice(i, 1).to_pylist()
                yield rows_of(row["block"], Block(row, width))

    return blocks.mapInArrow(run, REQUESTS)


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The totals in the order of each asker, and how many hashes have one above zero."""
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, at, np.concatenate(counts).astype(np.int64))
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    return np.split(totals[at], cuts), int((totals > 0).sum())


def answers(asked: DataFrame) -> DataFrame:
    """Corpus totals of what each block asked for; vocabulary: training words, once a range."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"part": rows["part"], "block": rows["block"]}
        for k in _OF:
            totals, distinct = _summed([*map(unpacked, rows[f"grams{k}"])],
                                       [*map(unplaned, rows[f"own{k}"])])
            if k == 0:
                out["vocabulary"] = [distinct] + [0] * (len(rows) - 1)
            out[f"totals{k}"] = [planed(t) for t in totals]
        return pd.DataFrame(out)

    return asked.groupBy("part").applyInPandas(run, ANSWERS)


COUNTED = (BLOCKS + ", vocabulary long, singles array<long>, mass array<long>, "
           + ", ".join(f"totals{k} binary" for k in _OF))


def counted_blocks(blocks: DataFrame, answered: DataFrame, width: int) -> DataFrame:
    """Each block with the corpus totals of its n-grams and its part of the counts of counts."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("part")
        totals = [np.concatenate([*map(unplaned, right[f"totals{k}"])]).astype(np.int64) for k in _OF]
        singles, mass = singles_and_mass(Block(left.iloc[0], width), totals)
        return left.assign(vocabulary=right["vocabulary"].sum(), singles=[singles], mass=[mass],
                           **{f"totals{k}": [planed(totals[k])] for k in _OF})

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(run, COUNTED)


def corpus_sums(counted: DataFrame) -> tuple[int, np.ndarray]:
    """Vocabulary, and for each length and class of history the mass kept for shorter histories.

    It is the leaving-one-out estimate: the share of training tokens whose n-gram would be unseen
    without them, singles / mass, each one more so that nothing is impossible.
    """
    vocabulary = counted.agg(F.sum("vocabulary")).first()[0] or 0
    rows = (counted.select(F.posexplode(F.arrays_zip("singles", "mass")).alias("i", "n"))
            .groupBy("i").agg(F.sum("n.singles").alias("singles"), F.sum("n.mass").alias("mass")))
    kept = np.ones((ORDER - 1) * CLASSES)
    for r in rows.collect():  # ORDER - 1 times CLASSES rows
        kept[r["i"]] = (r["singles"] + 1) / (r["mass"] + 1)
    return vocabulary, np.vstack([np.ones(CLASSES), kept.reshape(ORDER - 1, CLASSES)])


class Automaton:
    """States: the empty history, and each history of one or two words that training documents hold.

    Out of a state an arc for each n-gram seen in training leads to the longest seen history that
    ends with its word; its weight is the discounted share of the n-gram plus the mass the state
    keeps back times the probability after the shorter history. Any other word takes the failure
    arc, which costs the logarithm of that mass, to the shorter history. The empty history has an
    arc for every word, with its add-one probability. In each state the probabilities sum to one.
    """

    def __init__(self, block: Block, totals: list[np.ndarray], total: int, vocabulary: int,
                 kept: np.ndarray) -> None:
        chance = ((totals[0] + 1) / (total + vocabulary + 1))[block.at[0]]
        self.block = block
        self.arcs, self.failures = [np.log10(chance)], [np.zeros(len(chance))]
        self.has = [totals[0][block.at[0]] > 0]
        for k in range(1, ORDER):
            ends = np.flatnonzero(block.place >= k)
            history = totals[k - 1][block.at[k - 1][ends - 1]]
            seen = totals[k][block.at[k][ends]]
            back = np.where(history > 0, kept[k][_classes_of(history)], 1.0)
            chance[ends] = (1 - back) * seen / np.maximum(1, history) + back * chance[ends]
            failure, has = np.zeros(len(chance)), np.zeros(len(chance), bool)
            failure[ends], has[ends] = np.log10(back), seen > 0
            self.arcs.append(np.log10(chance))
            self.failures.append(failure)
            self.has.append(has)

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the state in which each token is met, and of the one whose arc it takes.

        One pass from left to right: failure arcs are followed until a state has an arc for the
        token, and the state that arc leads to is carried to the next token.
        """
        size = len(self.block.place)
        met, taken = bytearray(size), bytearray(size)
        has = [h.tobytes() for h in self.has]
        state = 0
        for i, first in enumerate((self.block.place == 0).tobytes()):
            if first:
                state = 0
            met[i] = state
            while state and not has[state][i]:
                state -= 1
            taken[i] = state
            state = min(state + 1, ORDER - 1) if has[0][i] else 0
        return np.frombuffer(met, np.uint8), np.frombuffer(taken, np.uint8)

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every token along its path, failure arcs included, and of the empty history's arcs."""
        met, taken = self.walk()
        weights = np.choose(taken, self.arcs)
        for k in range(1, ORDER):
            weights += np.where((taken < k) & (k <= met), self.failures[k], 0.0)
        scored = self.block.scored
        return np.where(scored, weights, 0.0), np.where(scored, self.arcs[0], 0.0)


SCORES = ("row long, doc_id string, held_out boolean, n_tokens long, n_known long, "
          "base_score double, score double")


def score_corpus(docs: DataFrame, learn: Column, block_tokens: int = BLOCK_TOKENS,
                 range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    Documents that meet the condition `learn` on doc_id are counted; all are scored, whole. Tokens
    are words with A-Z in lower case, then one end; NULL and empty texts have the end alone. base_score is the
    sum of the add-one word probabilities, score the automaton's, both log10. n_known counts
    tokens seen in training. Repeated rows each count and each get a row; no rows give none. Words are
    told apart by 64-bit hashes, longer n-grams by SPARE_BITS more than their number takes. Texts longer than a block go through several, state and counts
    included. Blocks and counts are written to the shared folder, so a lost
    executor repeats only its own blocks.
    """
    blocks = written(make_blocks(docs, learn, block_tokens), "blocks")
    size = blocks.agg(F.sum("n_grams").alias("entries"), F.sum("n_train").alias("total")).first()
    entries = max(1, size["entries"] or 0)
    bits = max(0, math.ceil(math.log2(entries / range_entries)))
    width = min(64, math.ceil(math.log2(entries)) + SPARE_BITS)
    totals = written(answers(requests(blocks, bits, width)), "totals")  # frees the larger exchange
    counted = written(counted_blocks(blocks, totals, width), "counted")
    vocabulary, kept = corpus_sums(counted)
    total = int(size["total"] or 0)

    def rows_of(row: dict) -> pa.RecordBatch:
        block = Block(row, width)
        totals = [unplaned(row[f"totals{k}"]).astype(np.int64) for k in _OF]
        weights, base = Automaton(block, totals, total, vocabulary, kept).traverse()
        known = block.scored & (totals[0][block.at[0]] > 0)
        columns = [row["rows"], row["doc_ids"], row["held"],
                   *(np.add.reduceat(x, block.starts)
                     for x in (block.scored.astype(np.int64), known.astype(np.int64), base, weights))]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, scores, strict=True)], schema=scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                yield rows_of(row)

    scores = pa.schema([("row", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()),
                        ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])
    scored = counted.mapInArrow(run, SCORES)
    # A document has several rows only if it is longer than a block.
    return (scored.groupBy("row").agg(
        F.first("doc_id").cast("long").alias("doc_id"), F.first("held_out").alias("held_out"),
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
        .select("doc_id", "held_out", "n_tokens", "n_known",
                F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"))
