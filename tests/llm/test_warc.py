import base64
import hashlib
from pathlib import Path

import zstandard
from pyspark.sql import functions as F

from careline.llm.warc import BundleReader, fetch, read_bundles, with_roles, write_bundles

SCHEMA = "page_id long, url string, html string, bundle string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_roles_and_odd_rows(spark, tmp_path):
    rows = [(3, "http://a/ü b%\n", "<p>é</p>", "x"), (1, "http://b", "<p>é</p>", "x"),
            (2, None, None, "x"), (9, "u", "", "x"), (None, "n", "<p>é</p>", "x"),
            (7, "r", "same", "x"), (7, "r", "same", "x"), (8, "l", "long " * 300_000, "x")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = write_bundles(pages, str(tmp_path / "a"), frame_bytes=200, bundle_bytes=300)
    got = read_bundles(index).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    texts = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        assert r.payload_digest == digest(texts[r.page_id].decode())
        assert r.payload_bytes == len(texts[r.page_id])
    assert (by_id[1].record_type, by_id[1].refers_to) == ("response", None)
    assert (by_id[3].record_type, by_id[3].refers_to) == ("revisit", 1)
    assert (by_id[None].record_type, by_id[None].refers_to) == ("revisit", 1)
    assert by_id[2].record_type == "response" and by_id[9].refers_to == 2
    assert [r.record_type for r in got if r.page_id == 7] == ["response"] * 2
    assert by_id[8].payload == texts[8] and by_id[3].url == rows[0][1] and by_id[2].url is None


def test_single_records_by_frame_and_plain_readers(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 40), "x") for i in range(500)]
    index = write_bundles(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "b"),
                          frame_bytes=2000, bundle_bytes=4000)
    assert index.select("bundle").distinct().count() > 2
    some = fetch(index.filter("page_id in (3, 77, 499)")).collect()
    assert sorted(r.page_id for r in some) == [3, 77, 499]
    # Any Zstandard reader sees one stream of records; the seek table is skipped.
    records = 0
    for path in Path(tmp_path / "b").glob("*.warc.zst"):
        with zstandard.ZstdDecompressor().stream_reader(
                path.open("rb"), read_across_frames=True) as stream:
            records += stream.read().count(b"WARC/1.1\r\n")
        assert len(BundleReader(str(path))) >= 1
    assert records == 500


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = [(i, "u", "ab", "x") for i in range(3)]
    index = write_bundles(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "c"), least_bytes=3)
    assert {r.record_type for r in read_bundles(index).collect()} == {"response"}
    empty = write_bundles(spark.createDataFrame([], SCHEMA), str(tmp_path / "d"))
    assert read_bundles(empty).count() == 0


def test_each_share_is_read_by_a_task_of_its_own(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 300, "x") for i in range(800)]
    index = write_bundles(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "e"), frame_bytes=30_000,
                          bundle_bytes=1000)
    assert index.select("bundle").distinct().count() >= 8
    tasks = read_bundles(index).select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert len(tasks) == 8 and sum(r["count"] for r in tasks) == 800


def test_pages_that_share_a_payload_can_be_split(spark, tmp_path):
    """Both sides of the join are exchanged for it, also the first ids, which lie by digest already."""
    rows = [(i, "u", "same" if i % 3 else f"own {i}", "x") for i in range(300)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = with_roles(spark.createDataFrame(rows, SCHEMA))
        plan = frame._jdf.queryExecution().executedPlan().toString()
        got = {r.page_id: r.refers_to for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("ENSURE_REQUIREMENTS") == 3
    assert got == {i: 1 if i % 3 and i != 1 else None for i in range(300)}
