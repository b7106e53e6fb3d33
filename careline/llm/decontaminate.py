"""Benchmark passages in documents by a prefix-filtered set join over word shingles."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.llm.common import ALNUM, unused, utf8, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 3
#: Bits of the filter of shingles that travels to the tasks: 2 MB, whatever the benchmark.
FILTER_BITS = 1 << 24
#: Words whose hashes a task remembers at once.
REMEMBERED = 200_000
WINDOWS = ("item string, words array<string>, shingle long, offset int, length int, "
           "row long")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, from the hashes of the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z in lower case."""
    return text.translate(ALNUM).split()


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """A row for each shingle of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  strict=True):
                words = words_of(text)
                rows = []
                for start in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[start:start + window]
                    texts = [w.decode("utf-8", "replace") for w in part]
                    k = min(SHINGLE, len(part))
                    rows += [(item, texts, int(h), o, len(part), start) for o, h in enumerate(
                        shingle_hashes(known.of(part), k).view(np.int64))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                            pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(),
                            pa.int32(), pa.int64()), strict=True)],
                        ["item", "words", "shingle", "offset", "length", "row"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                            utf8(F.col("text")).alias("t"))
    return rows.mapInArrow(run, WINDOWS)


def _filter_of(shingles: DataFrame) -> np.ndarray:
    """Bits of the shingles present, made and merged by Spark: 2 MB on the driver."""
    bit = F.pmod("shingle", F.lit(FILTER_BITS))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bytes_ = shingles.groupBy((F.floor(bit / 8)).cast("int").alias("at")).agg(
        F.bit_or(F.pow(F.lit(2), bit % 8).cast("int")).alias("value"))
    got = bytes_.toPandas()
    bits[got["at"].to_numpy(np.int64)] = got["value"].to_numpy(np.uint8)
    return bits


def _passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(FILTER_BITS - 1)
    return np.nonzero(bits[(at >> np.uint64(3)).astype(np.int64)]
                      >> (at & np.uint64(7)).astype(np.uint8) & 1)[0]


def document_frequencies(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(shingle, n): in how many documents shingles that pass the filter occur, over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                ["shingle", "n"])
            counts.clear()
            return out
        for batch in batches:
            for text in batch.column(0):
                hashes = known.of(words_of(text.as_py()))
                for k in sizes:
                    own = shingle_hashes(hashes, k)
                    for h in np.unique(own[_passing(bits, own)]).view(np.int64).tolist():
                        counts[h] = counts.get(h, 0) + 1
            if len(counts) > REMEMBERED:
                yield flushed()
        yield flushed()

    return (docs.select(utf8(F.col("text")).alias("t")).mapInArrow(run, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")))


def meetings(docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int,
             name: Column) -> DataFrame:
    """(row, doc_id, n_words, hits): doc_id is `name` of the row; hits are the shingles that pass the filter, each with
    its place and the words around it that a window over it could cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        row = TaskContext.get().partitionId() << 33
        hit = pa.struct([("shingle", pa.int64()), ("place", pa.int32()), ("first", pa.int32()),
                         ("around", pa.string())])
        for batch in batches:
            ids, rows, lengths, found = batch.column(0), [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hashes, hits = known.of(words), []
                for k in sizes:
                    own = shingle_hashes(hashes, k)
                    for p in _passing(bits, own).tolist():
                        first = max(0, p - window + k)
                        around = b" ".join(words[first:p + window]).decode("utf-8", "replace")
                        hits.append({"shingle": int(own[p].view(np.int64)), "place": p,
                                     "first": first, "around": around})
                rows.append(row)
                row += 1
                lengths.append(len(words))
                found.append(hits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), ids, pa.array(lengths, pa.int64()),
                 pa.array(found, pa.list_(hit))], ["row", "doc_id", "n_words", "hits"])

    rows = docs.select(name.alias("doc_id"), utf8(F.col("text")).alias("t"))
    return rows.mapInArrow(
        run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, "
             "hits array<struct<shingle:long,place:int,first:int,around:string>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13,
                  share: int = 20, name: Column | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), one row for each row of `docs`.

    A window is `window` consecutive words of an item, or the whole of a shorter item with words.
    Shingles of three words are ordered by the number of documents that hold them. A document
    that contains a window contains all its shingles, so joining on the rarest one, its prefix,
    loses none; the place of the shingle gives the window's place, which has to lie inside the
    document; the words are then compared one by one. n_hit counts words inside occurring windows,
    items lists the item ids as sorted strings, contaminated: n_hit > 0 and share * n_hit >=
    n_words. NULL and empty texts have no words; an item id of NULL is an empty string; repeated
    items are one; repeated rows each get a row. Other columns are ignored. Documents are read twice
    and not shuffled; only shingles that pass a 2 MB filter leave the tasks. `name` stands in doc_id
    in place of the id.
    """
    name = F.col("doc_id").cast("long") if name is None else name
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, window), "windows")
    sizes = sorted(r["k"] for r in windows.select(
        F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect())
    if not sizes:
        sizes = [SHINGLE]
    frequencies = document_frequencies(docs, _filter_of(windows), sizes)
    rarity = F.coalesce("n", F.lit(0))
    prefixes = written(
        windows.join(frequencies, "shingle", "left")
        .groupBy("item", "row", "words", "length")
        .agg(F.min(F.struct(rarity.alias("n"), "shingle", "offset")).alias("rarest"))
        .select("item", "words", "length", "rarest.shingle", "rarest.offset").distinct(),
        "prefixes")
    rows = written(meetings(docs, _filter_of(prefixes), sizes, window, name), "meetings")
    hits = rows.filter(F.size("hits") > 0).select("row", "n_words", F.inline("hits"))
    start = F.col("place") - F.col("offset")
    bounded = (hits.join(prefixes, "shingle")
               .withColumn("start", start)
               .filter((start >= 0) & (start + F.col("length") <= F.col("n_words"))
                       & (start >= F.col("first"))))
    same = F.slice(F.split("around", " "), F.col("start") - F.col("first") + 1,
                   F.col("length")) == F.col("words")
    found = bounded.filter(same).select("row", "start", "length", "item").distinct()
    earlier = Window.partitionBy("row").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(
        earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (found.select("row", "start", (F.col("start") + F.col("length")).alias("end"))
               .distinct()
               .withColumn("new", F.greatest(F.lit(0), F.col("end")
                                             - F.greatest("start", reached)))
               .groupBy("row").agg(F.sum("new").cast("long").alias("n_hit")))
    items = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.select("row", "doc_id", "n_words")
            .join(covered.join(items, "row"), "row", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"),
                    F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
                    ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13,
                      share: int = 20) -> DataFrame:
    """The rows of `docs`, with all their columns, that `contamination` doesn't find contaminated.

    Decided by the text alone, on its SHA-256: ids may be NULL or repeat. The hashes are written
    first, so that the engine can split a text that many rows hold.
    """
    digest, name = F.unhex(F.sha2(utf8(F.col("text")), 256)), unused("bad", docs.columns)
    bad = written(contamination(docs, benchmark, window, share, digest).filter("contaminated")
                  .select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(bad, digest == F.col(name), "left_anti")
