import random

import corpus_pipeline
from careline.llm.pieces import Decoder, Vocabulary
from careline.llm.queries import model_file
from llm.test_decontaminate import brute as brute_contamination
from llm.test_simhash import brute_groups


def test_stages_one_by_one(spark, docs_of, tmp_path):
    rng = random.Random(9)
    words = [f"plain{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = " ".join(f"exam{i}" for i in range(20))
    rows, labels = [], []
    for i in range(240):
        t, y = text(rng.randint(30, 90)), int(rng.random() < 0.8)
        if not y:
            t = t.replace(" ", "!!! ").upper()
        rows.append((i, t))
        labels.append((i, y, 0))
    rows += [(300 + k, rows[k][1]) for k in range(20)] + [(0, rows[0][1]), (None, text(50))]
    rows += [(400, item + " " + text(40)), (401, text(50) + " token = abcdef123456 x"),
             (402, None), (403, "")]
    docs = docs_of(rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]

    kept = stages["quality"](
        spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = {i for i, y, _ in labels if y}
    assert len(good & ids) == len(good) and len(ids & {i for i, y, _ in labels if not y}) <= 2

    unique = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert unique.columns == docs.columns
    want = sorted({(i, fp) for i, fp, c in brute_groups(rows) if i == c}, key=str)
    assert sorted([r.doc_id for r in unique.collect()], key=str) == [i for i, _ in want]

    clean = stages["decontamination"](spark, docs, str(tmp_path))
    bad = {r[0] for r in brute_contamination(rows, [(7, item)]) if r[-1]}
    assert bad == {400} and clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(
        (i for i, _ in rows if i not in bad), key=str)

    safe = stages["secrets"](spark, docs, str(tmp_path))
    assert safe.columns == docs.columns and safe.count() == len(rows)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert texts[401].endswith(" [SECRET] x") and texts[402] is None

    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    decoder = Decoder(Vocabulary.load(model_file()))
    final = {r.doc_id: r for r in result}
    assert len(final) == len(result) and 400 not in final and 300 not in final
    import numpy as np
    assert decoder.decode(np.array(final[401].ids)) == texts[401]
    assert all(r.round_trip for r in result)


def test_empty_tables(spark, docs_of, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, docs_of, tmp_path):
    item = " ".join(f"exam{i}" for i in range(20))
    clean = " ".join(f"plain{i}" for i in range(50))
    rows = [(1, item + " end"), (1, clean), (None, item), (None, clean + " x"), (None, None),
            (None, ""), (2, item + " end"), (1, clean)]
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = docs_of(rows)
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, clean), (1, clean), (None, clean + " x"), (None, None), (None, "")], key=str)


def test_columns_with_any_names_and_types(spark, docs_of):
    from pyspark.sql import functions as F

    from careline.llm.decontaminate import drop_contaminated
    from careline.llm.simhash import distinct_documents

    item = " ".join(f"exam{i}" for i in range(20))
    docs = docs_of([(1, "one two three"), (2, "one two three"), (3, item), (3, item), (None, None)]).withColumns(
        {c: F.lit("x") for c in ("fp", "__fp", "id", "__id", "bad", "__bad", "row", "first")}
        | {"pairs": F.create_map(F.lit("k"), F.col("doc_id"))})
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None]
    single = distinct_documents(docs)
    assert single.columns == docs.columns and dict(single.dtypes) == dict(docs.dtypes)
    rows = single.collect()
    assert sorted((r.doc_id for r in rows), key=str) == [1, 3, None]
    assert all(r.pairs == {"k": r.doc_id} and r["__fp"] == "x" for r in rows)
