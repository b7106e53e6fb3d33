"""Collocations by dynamic itemset counting: phrases of all lengths in cyclic scans of shards."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.llm.common import LOWER, utf8, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A-Z in lower case, the ends of pieces as line feed, the tab as space.
SIGNS = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in LOWER)
#: Tokens of a block, about; a block is the rows of one task at a time.
BLOCK = 1 << 21
#: Texts are cut into parts of about so many bytes, at ends of pieces.
PART = 1 << 23
#: Phrases are counted by ranges of their keys, one for so many tokens of the table, but so many at least.
RANGE, RANGES = 1 << 23, 16
#: Ids of phrases of a length are smaller than that.
IDS = 1 << 31
BREAK, NOTHING = -1, -2


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed with bytes of equal weight side by side, so small numbers cost their low bytes only."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).reshape(-1)


# Blocks -------------------------------------------------------------------------

def _parts(text: bytes) -> Iterator[bytes]:
    """The text, its long stretches cut behind ends of pieces."""
    at = 0
    while len(text) - at > PART and (end := text.find(b"\n", at + PART)) >= 0:
        yield text[at:end + 1]
        at = end + 1
    yield text[at:] if at else text


class _Block:
    """Tokens as numbers of this block's own words; pieces end with a break."""

    def __init__(self) -> None:
        self.numbers = count()
        self.words: dict[str, dict[bytes, int]] = {}
        self.arrays: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, part: bytes) -> None:
        if lang not in self.words:
            self.words[lang] = defaultdict(self.numbers.__next__, {b"\n": BREAK, b"": NOTHING})
        split = part.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words[lang].__getitem__, split), np.int32, len(split))
        ids = np.append(ids[ids != NOTHING], np.int32(BREAK))
        self.arrays.append(ids)
        self.size += len(ids)

    def row(self, block: int, shard: int) -> pa.RecordBatch:
        """Words are numbered from 1 on by falling counts, so that most numbers are small; 0 is a break."""
        tokens = np.concatenate(self.arrays)
        times = np.bincount(tokens[tokens >= 0], minlength=next(self.numbers))
        order = np.argsort(-times, kind="stable")
        ranks = np.zeros(len(times) + 1, np.int32)  # the last one is that of BREAK
        ranks[order] = np.arange(1, len(times) + 1)
        keys: list[bytes] = [b""] * len(times)
        sizes = []
        for lang, own in self.words.items():
            front = lang.encode()
            front = b"%d " % len(front) + front
            numbers = np.array([n for n in own.values() if n >= 0], np.int64)
            sizes.append({"lang": lang, "n": int(times[numbers].sum())})
            for word, n in own.items():
                if n >= 0:
                    keys[n] = front + word
        words = _Words.encode(pa.array([keys[n] for n in order.tolist()], pa.binary()))
        kind = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([shard], pa.int32()),
             pa.array([len(tokens)], pa.int64()), pa.array([_pack(ranks[tokens])], pa.binary()),
             *(pa.array([words[x]], pa.binary()) for x in ("keys", "lens")),
             pa.array([_pack(times[order])], pa.binary()), pa.array([sizes], kind)],
            ["block", "shard", "size", "tokens", "keys", "lens", "times", "sizes"])


def token_blocks(docs: DataFrame, shards: int, size: int = BLOCK) -> DataFrame:
    """(block, shard, size, tokens, keys, lens, times, sizes): all texts in blocks of about `size` tokens.

    Blocks are dealt to shards. keys, lens and times are a block's words with their languages and counts in
    the order of their numbers, sizes the words of each language. Blocks lie as the rows of the table do, so
    each is made by one task, and shards are spread over all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for piece in _parts(text.as_py().translate(SIGNS)):
                    block.add(lang.as_py(), piece)
                    if block.size >= size:
                        yield block.row((part << 32) + made, (part + made) % shards)
                        made, block = made + 1, _Block()
        if block.size:
            yield block.row((part << 32) + made, (part + made) % shards)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       utf8(F.col("text")).alias("t")).mapInArrow(
        run, "block long, shard int, size long, tokens binary, keys binary, lens binary, times binary, "
             "sizes array<struct<lang:string,n:long>>")


# Keys of phrases ----------------------------------------------------------------

class _Words:
    """Keys of words: the language's length and name, then the word."""

    @staticmethod
    def encode(keys: pa.Array) -> dict:
        lens = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int32)
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(keys.to_pylist()))
        return {"keys": data, "lens": _pack(lens), "wide": 0}

    @staticmethod
    def decode(row: dict) -> pa.Array:
        ends = np.append(np.int64(0), np.cumsum(_unpack(row["lens"], np.int32), dtype=np.int64))
        data = zstandard.ZstdDecompressor().decompress(row["keys"])
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1,
                                     [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])

    @staticmethod
    def some(keys: pa.Array, which: np.ndarray) -> pa.Array:
        return keys.take(pa.array(which))

    @staticmethod
    def distinct(keys: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
        found = pa.concat_arrays(keys).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False)

    @staticmethod
    def find(keys: pa.Array, known: pa.Array) -> np.ndarray:
        return (pc.index_in(keys, value_set=known).fill_null(-1)
                .to_numpy(zero_copy_only=False).astype(np.int64))

    @staticmethod
    def columns(keys: pa.Array) -> list[pa.Array]:
        langs, words = [], []
        for key in keys.to_pylist():
            size, rest = key.split(b" ", 1)
            langs.append(rest[:int(size)].decode())
            words.append(rest[int(size):].decode())
        return [pa.array(langs, pa.string()), pa.array(words, pa.string())]


class _Pairs:
    """Keys of longer phrases in a range: the ids of the phrase without its last and its first word.

    Ids of a range have the same (left + right) % of, so that left // of and right tell them, one number.
    """

    def __init__(self, part: int, of: int) -> None:
        self.part, self.of = part, of

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = keys % IDS
        return keys // IDS * self.of + (self.part - right) % self.of, right

    @staticmethod
    def encode(keys: np.ndarray) -> dict:
        """Steps between ascending keys, with no room between the left ids for more than the right ones."""
        right = keys % IDS
        wide = int(right.max(initial=0)) + 1
        return {"keys": _pack(np.diff(keys // IDS * wide + right, prepend=np.int64(0))), "lens": None,
                "wide": wide}

    @staticmethod
    def decode(row: dict) -> np.ndarray:
        keys = np.cumsum(_unpack(row["keys"], np.int64))
        return keys // row["wide"] * IDS + keys % row["wide"]

    @staticmethod
    def some(keys: np.ndarray, which: np.ndarray) -> np.ndarray:
        return keys[which]

    @staticmethod
    def distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(keys), return_inverse=True)

    @staticmethod
    def find(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places of the keys in the known ones, which ascend; -1 of others."""
        if not len(known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def columns(self, keys: np.ndarray) -> list[pa.Array]:
        return [pa.array(x, pa.int64()) for x in self.ids(keys)]


# Tables -------------------------------------------------------------------------

#: Rows of all written tables: keys of a range, with what `a` and `b` say of them. ASKED: a block's phrases,
#: counts, for words their numbers; EARLIER: the same, counted before; COUNTED: counts of a tick and with those
#: of its cycle; REACHED: ids of those that reached the threshold; TOLD: ids for a block, for words their
#: numbers; TOKENS: of a block.
ASKED, EARLIER, COUNTED, REACHED, TOLD, TOKENS = range(6)
ROWS = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), ("part", pa.int32()),
                  ("n", pa.int64()), ("wide", pa.int64()), ("keys", pa.binary()), ("lens", pa.binary()),
                  ("a", pa.binary()), ("b", pa.binary())])
TABLE = ("kind int, level int, block long, part int, n long, wide long, keys binary, lens binary, "
         "a binary, b binary")


def _row(kind: int, level: int, block: int | None, part: int, a: np.ndarray, b: np.ndarray | None,
         keys: dict) -> dict:
    return {"kind": kind, "level": level, "block": block, "part": part, "n": len(a), "a": _pack(a),
            "b": None if b is None else _pack(b), **keys}


def _tick_of(ids: np.ndarray, firsts: list[tuple[int, int]]) -> np.ndarray:
    """Ticks in which phrases reached the threshold; firsts has each tick's first id."""
    starts, ticks = np.array(firsts, np.int64).T
    return ticks[np.searchsorted(starts, ids, "right") - 1]


def _ask_words(of: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of blocks by ranges of their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, times = _Words.decode(row), _unpack(row["times"], np.int64)
                sums = np.fromiter(map(crc32, keys.to_pylist()), np.int64, len(keys))
                parts = sums * of >> 32
                order = np.argsort(parts, kind="stable")
                ends = np.searchsorted(parts[order], np.arange(of + 1))
                made = [_row(ASKED, 1, row["block"], r, times[some], some + 1,
                             _Words.encode(_Words.some(keys, some)))
                        for r in range(of) if len(some := order[ends[r]:ends[r + 1]])]
                yield from pa.Table.from_pylist(made, ROWS).to_batches()

    return run


def _scan(tick: int, shards: int, level: int, of: int, firsts: list[tuple[int, int]]
          ) -> Callable[[pa.Table], pa.Table]:
    """Scan of one block for phrases of `level` words.

    Its tokens are read with the ids it was told, of words first, then of ever longer phrases. A phrase starts
    at the place of two neighbours with ids. It is active from the tick after the later of them reached the
    threshold, for one cycle, so this scan counts it if it wasn't active in the last one.
    """

    def run(rows: pa.Table) -> pa.Table:
        told = defaultdict(list)
        tokens = np.zeros(0, np.int32)
        block = rows["block"][0].as_py()
        for row in rows.to_pylist():
            if row["kind"] == TOKENS:
                tokens = _unpack(row["a"], np.int32)
            else:
                told[row["level"]].append(row)
        ids = np.full(int(tokens.max(initial=0)) + 1, -1, np.int64)
        for row in told[1]:
            ids[_unpack(row["b"], np.int64)] = _unpack(row["a"], np.int64)
        found = ids[tokens]
        places = np.flatnonzero(found >= 0)
        found = found[places]
        for k in range(2, level):
            at = np.flatnonzero(places[1:] == places[:-1] + 1)
            known, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in told[k]:
                left, right = _Pairs(row["part"], of).ids(_Pairs.decode(row))
                known.append(left * IDS + right)
                names.append(_unpack(row["a"], np.int64))
            known, names = np.concatenate(known), np.concatenate(names)
            order = np.argsort(known)
            which = _Pairs.find(found[at] * IDS + found[at + 1], known[order])
            places, found = places[at[which >= 0]], names[order][which[which >= 0]]
        at = np.flatnonzero(places[1:] == places[:-1] + 1)
        left, right = found[at], found[at + 1]
        start = 1 + np.maximum(_tick_of(left, firsts), _tick_of(right, firsts))
        left, right = left[start > tick - shards], right[start > tick - shards]
        deep, wide = int(left.max(initial=0)) // of + 1, int(right.max(initial=0)) + 1
        keys, c = np.unique((((left + right) % of) * deep + left // of) * wide + right,
                            return_counts=True)
        ends = np.searchsorted(keys, np.arange(of + 1) * (deep * wide))
        made = []
        for r in range(of):
            if ends[r] < ends[r + 1]:
                own = keys[ends[r]:ends[r + 1]] - r * deep * wide
                made.append(_row(ASKED, level, block, r, c[ends[r]:ends[r + 1]], None,
                                 _Pairs.encode(own // wide * IDS + own % wide)))
        return pa.Table.from_pylist(made, ROWS)

    return run


def _sums(tick: int, shards: int, level: int, least: int, of: int, last: bool, first: int,
          firsts: list[tuple[int, int]]) -> Callable[[pa.Table], pa.Table]:
    """Counts of a tick in one range of keys, with those up to it in the cycle it ends (`upto`), who reached
    the threshold by them, with ids from `first` on, and for each block the ids that are news to it.

    Counts are kept of phrases that are active in the next tick, too, and of those that reached the
    threshold: others are in no later sum.
    """

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        kind_of = _Words if level == 1 else _Pairs(part, of)
        by = defaultdict(list)
        for row in rows.to_pylist():
            by[row["kind"]].append((row, kind_of.decode(row)))
        made = []
        if by[REACHED]:
            known, at = kind_of.distinct([keys for _, keys in by[REACHED]])
            names = np.zeros(len(known), np.int64)
            names[at] = np.concatenate([_unpack(row["a"], np.int64) for row, _ in by[REACHED]])
            for row, keys in by[ASKED] + by[EARLIER]:
                which = kind_of.find(keys, known)
                some = np.flatnonzero(which >= 0)
                if len(some):
                    told = {"keys": None, "lens": None, "wide": 0}
                    made.append(_row(TOLD, level, row["block"], part, names[which[some]],
                                     _unpack(row["b"], np.int64)[some] if level == 1 else None,
                                     told if level == 1 else kind_of.encode(keys[some])))
        if by[ASKED]:
            keys, at = kind_of.distinct([keys for _, keys in by[ASKED] + by[COUNTED]])
            times = [_unpack(row["a"], np.int64) for row, _ in by[ASKED]]
            here = sum(map(len, times))
            c = np.bincount(at[:here], np.concatenate(times), len(keys)).astype(np.int64)
            before = [np.zeros(0, np.int64), *(_unpack(row["a"], np.int64) for row, _ in by[COUNTED])]
            upto = c + np.bincount(at[here:], np.concatenate(before), len(keys)).astype(np.int64)
            if level == 1:
                start = np.zeros(len(keys), np.int64)
            else:
                left, right = kind_of.ids(keys)
                start = 1 + np.maximum(_tick_of(left, firsts), _tick_of(right, firsts))
            kept = np.flatnonzero((c > 0) & ((upto >= least) | (start + shards > tick + 1)))
            if len(kept):
                made.append(_row(COUNTED, level, None, part, c[kept], upto[kept],
                                 kind_of.encode(kind_of.some(keys, kept))))
            found = np.flatnonzero((upto >= least) & (upto - c < least) & (c > 0))
            if len(found) and not last:
                made.append(_row(REACHED, level, None, part, first + np.arange(len(found)) * of + part, None,
                                 kind_of.encode(kind_of.some(keys, found))))
        return pa.Table.from_pylist(made, ROWS)

    return run


def _listed(table: DataFrame, kind: int, level: int, of: int, least: int = 0) -> DataFrame:
    """A row for each key: counts c and upto, those with `least` or more up to then, or ids."""
    names = (["lang", "word"] if level == 1 else ["left", "right"]) + (
        ["c", "upto"] if kind == COUNTED else ["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind_of = _Words if level == 1 else _Pairs(row["part"], of)
                numbers = [_unpack(row[x], np.int64) for x in ("a", "b") if row[x] is not None]
                keys = kind_of.decode(row)
                if kind == COUNTED:
                    some = np.flatnonzero(numbers[1] >= least)
                    keys, numbers = kind_of.some(keys, some), [x[some] for x in numbers]
                yield pa.RecordBatch.from_arrays(
                    [*kind_of.columns(keys), *(pa.array(x, pa.int64()) for x in numbers)], names)

    key = "string" if level == 1 else "long"
    return table.filter(F.col("kind") == kind).mapInArrow(
        run, ", ".join(f"{x} {key if i < 2 else 'long'}" for i, x in enumerate(names)))


# Counting -----------------------------------------------------------------------

def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class _Counting:
    """Counts by tick and length, and who reached the threshold when, as written tables.

    A phrase longer than one word is the pair of the ids of what it is without its last and without its first
    word: equal pairs are equal phrases, and both have ids only if both reached the threshold.
    """

    def __init__(self, blocks: DataFrame, least: int, longest: int, shards: int) -> None:
        self.least, self.longest, self.shards = least, longest, shards
        self.blocks = blocks
        self.asked: dict[tuple[int, int], DataFrame] = {}    # phrases of blocks by tick and length
        self.tables: dict[tuple[int, int], DataFrame] = {}   # what a tick counted and told
        self.counts: dict[tuple[int, int], DataFrame] = {}   # the counts in them, a row a phrase
        self.reached: dict[tuple[int, int], DataFrame] = {}  # only tables with rows
        self.firsts: dict[int, list[tuple[int, int]]] = defaultdict(list)  # first ids and ticks by length
        self.ends: dict[int, int] = defaultdict(int)
        self.of = max(RANGES, (blocks.agg(F.sum("size")).first()[0] or 0) // RANGE)
        tick = 0
        while tick < shards or any(self._news(tick, k) for k in range(1, longest)):
            self._tick(tick)
            tick += 1

    def _key(self, length: int) -> list[str]:
        return ["lang", "word"] if length == 1 else ["left", "right"]

    def _news(self, tick: int, length: int) -> list[DataFrame]:
        """Phrases that reached the threshold since the shard of this tick was scanned last."""
        return [self.tables[t, length] for t in range(tick - self.shards, tick)
                if (t, length) in self.reached]

    def _tick(self, tick: int) -> None:
        """All lengths that are active, in the shard whose turn it is."""
        words = self.blocks.filter(F.col("shard") == tick % self.shards).select(
            "block", "keys", "lens", "times").mapInArrow(_ask_words(self.of), TABLE)
        self._sum([words] if tick < self.shards else [], [] if tick < self.shards else [words], tick, 1)
        for length in range(2, self.longest + 1):
            if self._news(tick, length - 1):
                self._extend(tick, length)
            self._sum(*([self.asked[t, length]] if (t, length) in self.asked else []
                        for t in (tick, tick - self.shards)), tick, length)

    def _extend(self, tick: int, length: int) -> None:
        """Ask for the phrases that became active for this shard."""
        shard, null = tick % self.shards, F.lit(None).cast("binary")
        columns = ["kind", "level", "block", "part", "wide", "keys", "a", "b"]
        told = [df.filter(F.col("kind") == TOLD).select(*columns) for (t, k), df in self.tables.items()
                if k < length and t % self.shards == shard]
        tokens = self.blocks.filter(F.col("shard") == shard).select(
            F.lit(TOKENS).alias("kind"), F.lit(0).alias("level"), "block", F.lit(0).alias("part"),
            F.lit(0).cast("long").alias("wide"), null.alias("keys"), F.col("tokens").alias("a"),
            null.alias("b"))
        self.asked[tick, length] = written(_all([tokens, *told]).groupBy("block").applyInArrow(
            _scan(tick, self.shards, length, self.of, self.firsts[length - 1]), TABLE),
            f"asked-{tick}-{length}")

    def _sum(self, asked: list[DataFrame], earlier: list[DataFrame], tick: int, length: int) -> None:
        """Counts of what blocks ask for, and answers to that and to what they asked for one cycle
        earlier: one exchange for all of it, by ranges of keys."""
        last = length == self.longest
        news = [] if last else self._news(tick, length)
        if not asked and not (earlier and news):
            return
        rows = [*asked, *(df.filter(F.col("kind") == REACHED) for df in news)]
        if news:
            rows += [df.withColumn("kind", F.lit(EARLIER)) for df in earlier]
        if asked:
            rows += [self.tables[t, length].filter(F.col("kind") == COUNTED)
                     .withColumn("b", F.lit(None).cast("binary"))
                     for t in range(tick - self.shards + 1, tick) if (t, length) in self.counts]
        table = written(_all(rows).groupBy("part").applyInArrow(
            _sums(tick, self.shards, length, self.least, self.of, last, self.ends[length],
                  self.firsts[length - 1]), TABLE), f"counts-{tick}-{length}")
        self.tables[tick, length] = table
        if not asked:
            return
        self.counts[tick, length] = _listed(table, COUNTED, length, self.of)
        if most := table.filter(F.col("kind") == REACHED).agg(F.max("n")).first()[0]:
            self.reached[tick, length] = _listed(table, REACHED, length, self.of)
            self.firsts[length].append((self.ends[length], tick))
            self.ends[length] += most * self.of
            if self.ends[length] > IDS:
                raise ValueError("too many phrases for their ids")

    def totals(self, length: int) -> DataFrame | None:
        """(key, a) of the phrases of a length over their full cycles, from the threshold on.

        The cycle's last tick in which a phrase occurs has its full count in `upto`, other ticks less.
        """
        tables = [_listed(self.tables[t, k], COUNTED, k, self.of, self.least)
                  for t, k in self.counts if k == length]
        return _all(tables).groupBy(*self._key(length)).agg(F.max("upto").alias("a")) if tables else None

    def sizes(self) -> DataFrame:
        """(lang, n): all words of each language."""
        return (self.blocks.select(F.explode("sizes").alias("s")).groupBy(F.col("s.lang").alias("lang"))
                .agg(F.sum("s.n").alias("n")))

    def phrases(self) -> dict[int, DataFrame]:
        """By length: id, left, right, lang, phrase, last word, and the counts of its first and last words.

        `firsts` and `lasts` have an entry for each number of words, the whole phrase last.
        """
        made: dict[int, DataFrame] = {}
        for k in range(1, self.longest + 1):
            total = self.totals(k)
            ids = [df for (_, n), df in self.reached.items() if n == k]
            if total is None or k < self.longest and not ids:
                break
            if ids:
                total = total.join(_all(ids), self._key(k))
            else:
                total = total.withColumn("id", F.lit(None).cast("long"))
            if k == 1:
                a = F.array("a")
                made[1] = written(total.select("id", "lang", F.col("word").alias("phrase"),
                                               F.col("word").alias("last"), "a",
                                               a.alias("firsts"), a.alias("lasts")), "phrases-1")
                continue
            left = made[k - 1].select(F.col("id").alias("left"), "lang", "phrase", "firsts")
            right = made[k - 1].select(F.col("id").alias("right"), "last", "lasts")
            made[k] = written(total.join(left, "left").join(right, "right").select(
                "id", "left", "right", "lang",
                F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a",
                F.array_append("firsts", F.col("a")).alias("firsts"),
                F.array_append("lasts", F.col("a")).alias("lasts")), f"phrases-{k}")
        return made


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in whole numbers of 38 digits."""
    wide = "decimal(19,0)"
    dividend = a.cast(wide) * n.cast(wide) * F.lit(1000)
    return F.call_function("div", dividend, left.cast(wide) * right.cast(wide))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000,
                 contained: tuple[int, int] = (100, 100), shards: int = 2,
                 block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words by language.

    A phrase is words in a row within a piece; pieces end at .,;:!? and line ends, words at spaces and
    tabs, A-Z is lower case. a counts all its places, overlaps included, and is `least` or more. Of its
    cuts in two parts with l and r places that with the lowest floor(1000 a n / (l r)) counts,
    the shortest first part of equals; n are all words of the language (NULL: `und`). A phrase is left
    out if a longer one around it has contained[0] * a(longer) >= contained[1] * a. Ranks go by score, a,
    both descending, and phrase; at most `top` a language are returned.

    Dynamic itemset counting: the texts are dealt to `shards`, scanned in a cycle. Words are active from
    the start; a longer phrase becomes active at the next shard once both phrases of one word less
    reached `least`, and is counted until each shard was scanned once since. Ids tell who reached it,
    and are asked for by block: the answers a block gets are about its own phrases only, so no table of
    phrases is ever held by a task. Each round is written, so lost executors cost a read.

    NULL and empty texts have no words; texts of any length are read to their end, cut at ends of pieces;
    repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    counting = _Counting(written(token_blocks(docs, shards, block), "blocks"), least, longest, shards)
    made = counting.phrases()
    columns = ["lang", "phrase", "a", "firsts", "lasts"]
    kept = []
    for k in range(2, max(made, default=0) + 1):
        rows = made[k]
        if k + 1 in made:
            longer = made[k + 1]
            around = (_all([longer.select(F.col(side).alias("id"), "a") for side in ("left", "right")])
                      .groupBy("id").agg(F.max("a").alias("around")))
            inside = F.coalesce(contained[0] * F.col("around") >= contained[1] * F.col("a"),
                                F.lit(False))
            rows = rows.join(around, "id", "left").filter(~inside)
        kept.append(rows.select(*columns))
    if not kept:
        return docs.sparkSession.createDataFrame(
            [], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    words = F.size("firsts")

    def cut(k: Column) -> Column:
        left, right = F.element_at("firsts", k), F.element_at("lasts", words - k)
        return F.struct(_score(F.col("a"), F.col("n"), left, right).alias("score"), k.alias("k"),
                        left.alias("l"), right.alias("r"))
    lowest = F.array_min(F.transform(F.sequence(F.lit(1), words - 1), cut))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (_all(kept).join(counting.sizes(), "lang").withColumn("cut", lowest)
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                    "score"))
