import random
import re

from careline.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            own = words_of(item_text)
            for s in range(max(1, len(own) - window + 1) if own else 0):
                part = own[s:s + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at:at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        found.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), len(found), sorted(found),
                    bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)
                   for r in df.collect()), key=str)


def test_against_brute_force(spark, docs_of):
    rng = random.Random(4)
    words = ["the", "of", "and", "É", "x1", *(f"w{i}" for i in range(12))]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 12, 13, 14, 30]))) for i in range(25)]
    items += [(3, items[4][1]), (None, text(20)), (101, None), (102, "the " * 20)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 60))]
        if rng.random() < 0.7:
            own = words_of(rng.choice(items)[1])
            a = rng.randint(0, 3)
            parts += [", ".join(own[a:]).upper(), text(rng.randint(0, 60))]
        docs.append((i, rng.choice([" ", "\n!"]).join(parts)))
    docs += [(60, None), (61, ""), (61, ""), (None, "a b c"), (62, "the " * 40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert result(contamination(docs_of(docs), benchmark)) == brute(docs, items)


def test_long_text_threshold_and_empty_tables(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(13))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, "x " * 247 + item), (2, "x " * 248 + item), (3, "y " * 300_000 + item)]
    got = {r.doc_id: r for r in contamination(docs_of(docs), benchmark).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (260, 13, True)
    assert not got[2].contaminated and got[3].n_hit == 13
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(contamination(docs_of(docs[:1]), none)) == [(1, 260, 0, 0, [], False)]
    assert contamination(docs_of([]), benchmark).count() == 0
