"""Filter audit, exact groups and collocations against brute force on small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from careline.llm import audit, collocations, radix

# Texts for all three: nulls, empties, repeats, very long ones, equal starts.
LONG = "word " * 30_000
BLAND = " ".join(f"w{i}" for i in range(250))
TEXTS = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, None), (5, ""), (6, " "), (7, LONG + "x"),
         (8, LONG + "y"), (9, LONG.replace(" ", "\n") + "x"), (None, "a b"), (None, "a b"),
         (10, BLAND), (10, BLAND), (11, BLAND + " #"), (12, "ABC " * 250), (13, "a b"),
         (None, None), (14, "lonely"), (None, "nameless"), (0, "x" * 64), (15, "x" * 65)]


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("width,growth", [(64, 64), (1, 2), (7, 3)])
def test_exact_groups_as_by_hand(docs_of, width, growth):
    groups = defaultdict(list)
    for i, text in TEXTS:
        groups[_normal(text)].append(i)
    want = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    got = radix.exact_groups(docs_of(TEXTS), width, growth).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert got[0].__fields__ == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_groups_of_nothing(docs_of):
    assert radix.exact_groups(docs_of([])).collect() == []


def test_one_text_that_a_third_of_all_rows_share(docs_of):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i}") for i in range(600)]
    got = {r.doc_id: r for r in radix.exact_groups(docs_of(rows), 16, 4).collect()}
    assert {r.group_size for i, r in got.items() if i % 3 == 0} == {200}
    assert sum(r.kept for r in got.values()) == 401


def _fails(rows):
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = min((j for j, t in rows if (t or "") == text and j is not None), default=None)
        yield [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
               100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
               bool(re.search("[#$%&*|]", text)), None not in (i, first) and first < i]


def test_audit_as_by_simulated_orders(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (10, 1, 1), (11, 0, 1), (12, 1, 0),
                                    (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    good, toxic = {1, 2, 10, 12}, {1, 10, 11}
    docs = docs_of(TEXTS).withColumn(
        "source", F.when(F.col("doc_id") % 2 == 0, "s").when(F.col("doc_id") % 3 == 0, "")
        ).withColumn("fails", F.lit("clash"))
    part_of = {i: "s" if i is not None and i % 2 == 0 else "" for i, _ in TEXTS}
    fails = list(_fails(TEXTS))
    want = {}
    for part in ("s", ""):
        mine = [(i, f) for (i, _), f in zip(TEXTS, fails, strict=True) if part_of[i] == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                n = "ABCDE".index(letter)
                out = [x for x in left if x[1][n]]
                gone = sum(x[1][n] for x in mine) - len(out)
                left = [x for x in left if not x[1][n]]
                shares[letter] += len(out)
                want[part, "".join(order), step] = [
                    len(left), len(out), gone, sum(x[1][n] and sum(x[1]) == 1 for x in mine),
                    sum(i in good for i, _ in out), sum(i in toxic for i, _ in out), letter]
        for key, row in want.items():
            if key[0] == part:
                row[-1] = shares[row[-1]]
    got = {tuple(r[:3]): list(r[3:]) for r in audit.audit_documents(docs, labels).collect()}
    assert got == want


def test_audit_of_nothing(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_documents(docs_of([]), labels).collect() == []


@pytest.mark.parametrize("k", [2, 3, 5])
def test_weights_are_shapley_shares(k):
    value = [Fraction(0), *(Fraction(7 * s * s % 31 + s.bit_count(), 3) for s in range(1, 2 ** k))]
    shares = [Fraction(0)] * k
    for order in permutations(range(k)):
        before = 0
        for i in order:
            shares[i] += value[before | 1 << i] - value[before]
            before |= 1 << i
    assert [sum(w * v for w, v in zip(row, value, strict=True))
            for row in audit.shapley_weights(k)] == shares


def _collocations(rows, least, longest, top):
    """The definition itself, with every longer phrase looked at."""
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, own in counts.items():
        candidates = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and f >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, f in candidates.items()):
                continue
            score, k = min((1000 * a * sizes[lang] // (own[p[:k]] * own[p[k:]]), k)
                           for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, sizes[lang], -score))
    return ranked


def _phrase_rows():
    rows = [("en", "To be or not to be, to be or not"), (None, "to be\tor not to be"), ("en", None),
            ("en", ""), ("fr", "été été été été été"), ("en", " . , "),
            ("en", "big apple pie. " * 40 + "\x0bbig\xa0apple"), ("fr", "a b c d e f " * 30)]
    return rows * 2 + [("en", f"x{i % 3} y{i % 2} z") for i in range(30)]


@pytest.mark.parametrize("shards,block,least,top", [(1, 1 << 21, 3, 2000), (2, 40, 3, 2000),
                                                    (3, 40, 2, 7), (2, 1, 12, 2000)])
def test_collocations_as_counted_by_hand(spark, shards, block, least, top):
    rows = _phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns(
        {"phrase": F.lit(1), "n": F.lit("clash"), "block": F.lit(None).cast("map<string,string>")})
    got = collocations.collocations(docs, least, 5, top, shards=shards, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(_collocations(rows, least, 5, top))
    assert got[0].__fields__ == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    for rows in ([], [("en", None)], [("en", "once only")]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.collocations(docs, 2).collect() == []


def test_long_texts_are_cut_at_ends_of_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "PART", 10)
    text = b"one two three four\nfive\nsix seven eight nine ten eleven\n"
    parts = list(collocations._parts(text))
    assert b"".join(parts) == text and len(parts) > 1
    assert all(p.endswith(b"\n") for p in parts[:-1])


def test_scores_beyond_64_bits(spark):
    a, n = 3_000_000_000, 40_000_000_000_000
    row = spark.range(1).select(collocations._score(F.lit(a), F.lit(n), F.lit(a), F.lit(a + 1))
                                .alias("s")).first()
    assert row.s == 1000 * a * n // (a * (a + 1))


def test_a_tick_writes_what_its_cycle_has_counted(spark):
    """`upto` sums the ticks of the cycle, so totals and thresholds need no second sum over all counts."""
    docs = spark.createDataFrame(_phrase_rows(), "lang string, text string").repartition(5)
    counting = collocations._Counting(collocations.token_blocks(docs, 2, 40).cache(), 3, 3, 2)
    for length in (1, 2):
        key = counting._key(length)
        ticks = {t: {tuple(r[k] for k in key): (r["c"], r["upto"]) for r in df.collect()}
                 for (t, n), df in counting.counts.items() if n == length}
        whole = Counter()
        for t, rows in ticks.items():
            whole.update({k: c for k, (c, _) in rows.items()})
            assert all(upto == c + ticks.get(t - 1, {}).get(k, (0, 0))[0] for k, (c, upto) in rows.items())
        got = {tuple(r[k] for k in key): r["a"] for r in counting.totals(length).collect()}
        assert got and got == {k: n for k, n in whole.items() if n >= 3}


def test_ticks_exchange_a_row_a_block_and_range(spark):
    """Rows of a tick go by blocks and ranges, not by phrases; ended counts under the threshold are not kept."""
    rows = [("en", " ".join(f"w{i * k % 97}" for i in range(400))) for k in range(1, 60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    counting = collocations._Counting(collocations.token_blocks(docs, 2).cache(), 3, 3, 2)
    blocks = counting.blocks.count()
    assert counting.totals(2).count() > 4 * blocks * counting.of
    for table in [*counting.asked.values(), *counting.tables.values()]:
        most = {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()}
        assert max(most.values(), default=0) <= 2 * blocks * counting.of
    assert counting.counts[1, 1].filter("upto < 3").isEmpty()


def test_keys_of_phrases_come_back(spark):
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, collocations.IDS, (2, 1000))
    for of in (1, 16, 1220):
        for part in np.unique((left + right) % of)[:3].tolist():
            some = (left + right) % of == part
            pairs = collocations._Pairs(part, of)
            keys = np.unique(left[some] // of * collocations.IDS + right[some])
            packed = pairs.encode(keys)
            assert (pairs.decode(packed) == keys).all()
            assert set(zip(*map(np.ndarray.tolist, pairs.ids(keys)), strict=True)) == set(
                zip(left[some].tolist(), right[some].tolist(), strict=True))
    words = pa.array([b"2 enword", b"5 a\nb 1", b"0 ", b"3 \xc3\xa9x\xc3\xa9 "], pa.binary())
    assert collocations._Words.decode(collocations._Words.encode(words)).to_pylist() == words.to_pylist()
    langs, said = collocations._Words.columns(words)
    assert langs.to_pylist() == ["en", "a\nb 1", "", "éx"] and said.to_pylist() == ["word", "", "", "é "]
    for kind in (np.int32, np.int64):
        for numbers in (np.zeros(0, kind), rng.integers(-9, 99, 1000).astype(kind)):
            assert (collocations._unpack(collocations._pack(numbers), kind) == numbers).all()
    assert len(collocations._pack(rng.integers(0, 256, 100_000))) < 110_000
