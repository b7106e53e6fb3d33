import random

import numpy as np
from pyspark.sql import functions as F

from careline.llm import quality, toxicity
from careline.llm.common import fold_of
from careline.llm.sample import labelled_sample


def brute_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(scores))
                for j in range(i + 1, len(scores) + 1)))
    i, j = best[3], best[4]
    return (brute_segments(scores[:i]) + [(i, j)]
            + [(a + j, b + j) for a, b in brute_segments(scores[j:])])


def test_segments_against_the_recursive_definition():
    rng = random.Random(3)
    for _ in range(300):
        scores = np.array([rng.choice([-3, -2, -1, 0.5, 1.25, 2.5]) + rng.random() / 1000
                           for _ in range(rng.randint(0, 30))])
        got = toxicity.segments(scores)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)
        for a, b, s in got:
            assert abs(s - scores[a:b].sum()) < 1e-9


def corpus(spark, docs_of, bad, n=400):
    rng = random.Random(1)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text, y = [rng.choice(words) for _ in range(rng.randint(20, 80))], int(rng.random() < 0.3)
        if y:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, y, y))
    labels += [(None, 1, 1), (10_000, 1, None), (5, None, 7)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found_and_passages_hold_the_words(spark, docs_of):
    bad = ["vile", "rotten", "nasty"]
    rows, labels = corpus(spark, docs_of, bad)
    rows += [(900, None), (901, ""), (902, "plain1 " * 50_000 + "vile rotten nasty vile"),
             (0, rows[0][1])]
    got = toxicity.toxicity(docs_of(rows), labels, fold_of(F.col("doc_id"), 3) != 1).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and r.doc_id is not None
             and r.doc_id < 400}
    scores = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows)
    right = sum((scores[i] >= 0.7) == bool(y) for i, y in truth.items())
    assert right >= 0.97 * len(truth)
    assert scores[900] == scores[901] < 0.7
    texts = dict(rows)
    for r in got:
        for p in r.passages:
            assert set(texts[r.doc_id].split()[p.start:p.end]) & set(bad)


def test_quality_separates_held_out_rows(spark, docs_of):
    rows, labels = corpus(spark, docs_of, ["GOOD***", "FINE###"])
    learn = fold_of(F.col("doc_id"), 5) != 0
    rows += [(900, None), (901, ""), (902, "plain1 GOOD*** " * 150_000)]
    docs = docs_of(rows)
    got = {r.doc_id: r.score for r in quality.quality(docs, labels, learn).collect()}
    held = {r.doc_id for r in docs.filter(~learn).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in held and r.doc_id < 400
             and r.quality is not None}
    assert len(truth) > 50
    assert sum((got[i] >= 0.3) == bool(y) for i, y in truth.items()) >= 0.97 * len(truth)
    assert 0 <= got[900] == got[901] <= 1 and got[902] > 0.5
    again = {r.doc_id: r.score for r in quality.quality(docs.repartition(7), labels, learn).collect()}
    assert got == again


def test_chunks_of_long_texts_have_the_features_of_the_whole(monkeypatch):
    text = b" ".join(b"w%d" % (i % 97) for i in range(1000))
    whole = quality.Features()(text)
    monkeypatch.setattr(quality, "CHUNK", 64)
    parts = quality.Features()(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_empty_tables_and_no_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    learn = F.lit(True)
    assert [r.score for r in quality.quality(docs_of([(1, "a")]), none, learn).collect()] == [0.5]
    assert quality.quality(docs_of([]), none, learn).count() == 0
    assert toxicity.toxicity(docs_of([]), none, learn).count() == 0
    (row,) = toxicity.toxicity(docs_of([(1, "a b")]), none, learn).collect()
    assert 0 <= row.score <= 1 and row.passages == []


def test_the_sample_is_bounded_and_holds_out(spark, docs_of):
    rows, labels = corpus(spark, docs_of, ["x"])
    learn = fold_of(F.col("doc_id"), 3) != 1
    got = labelled_sample(docs_of(rows), labels, "toxic", learn, 50)
    assert got.count() == 50 and got.filter(~learn).count() == 0


def test_the_sample_takes_one_row_of_a_repeated_id(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = [(1, f"text {k % 7}") for k in range(60)] + [(2, "a"), (3, None), (3, None), (4, "b"),
                                                        (None, "c")]
    first, again = ([(r.doc_id, bytes(r.text), r.y) for r in labelled_sample(
        docs_of(own), labels, "quality", F.lit(True), 3).orderBy("doc_id").collect()]
        for own in (rows, rows[::-1]))
    assert first == again and [(i, y) for i, _, y in first] == [(1, 1), (2, 1), (3, 1)]
    assert first[0][1].startswith(b"text ") and [t for _, t, _ in first[1:]] == [b"a", b""]
