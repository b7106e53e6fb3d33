import hashlib
import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from careline.llm.ring import shard_documents


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_counts_differ_by_one_and_slots_have_no_gaps(docs_of):
    docs = docs_of([(i, "x" * (i % 50)) for i in range(1000)])
    rows = rows_of(shard_documents(docs, 24))
    counts = Counter(r["shard"] for r in rows)
    assert sorted(counts) == list(range(24)) and set(counts.values()) == {41, 42}
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert sorted(r["doc_id"] for r in rows) == list(range(1000))
    # Only what a full shard cannot hold leaves it.
    home = Counter(r["home_shard"] for r in rows)
    moved = Counter(r["home_shard"] for r in rows if r["shard"] != r["home_shard"])
    for shard in range(24):
        assert moved[shard] == max(0, home[shard] - counts[shard])


def key_by_key(ids, shards, vnodes):
    """One queue walked clockwise: an arc first gives what its node cannot keep, then takes what fits."""
    def at(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    nodes = sorted((at(f"shard/{s}/{v}"), s) for s in range(shards) for v in range(vnodes))
    arcs_of = [[] for _ in nodes]
    for i in sorted(ids, key=lambda i: at(str(i))):
        where = next((k for k, (p, _) in enumerate(nodes) if at(str(i)) <= p), None)
        arcs_of[0 if where is None else where].append((where is not None, i))
    arcs_of[0].sort(key=lambda x: x[0])  # behind the last node comes before the first one
    cap = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    demand = [sum(len(a) for a, (_, o) in zip(arcs_of, nodes) if o == s) for s in range(shards)]
    seen, k, keep = [0] * shards, [0] * shards, []
    for arc, (_, s) in zip(arcs_of, nodes):
        if demand[s] > cap[s]:
            now = (seen[s] + len(arc)) * cap[s] // demand[s] - seen[s] * cap[s] // demand[s]
        else:
            room = cap[s] - demand[s]
            now = len(arc) + (k[s] + 1) * room // vnodes - k[s] * room // vnodes
        seen[s], k[s] = seen[s] + len(arc), k[s] + 1
        keep.append(now)
    sums = list(itertools.accumulate(len(a) - n for a, n in zip(arcs_of, keep)))
    first = sums.index(min(sums)) + 1
    queue, out = [], {}
    for j in range(len(nodes)):
        j = (first + j) % len(nodes)
        (_, s), arc = nodes[j], [i for _, i in arcs_of[j]]
        out |= dict.fromkeys(arc[:keep[j]], s)
        queue += arc[keep[j]:]
        for _ in range(keep[j] - len(arc)):
            out[queue.pop(0)] = s
    assert not queue
    return out


@pytest.mark.parametrize("n, shards, vnodes", [(97, 3, 4), (500, 5, 1), (40, 24, 8), (7, 2, 3)])
def test_against_walking_key_by_key(docs_of, n, shards, vnodes):
    rows = rows_of(shard_documents(docs_of([(i, "t") for i in range(n)]), shards, vnodes))
    assert {r["doc_id"]: r["shard"] for r in rows} == key_by_key(range(n), shards, vnodes)


def test_growing_by_one_shard_moves_few_rows(docs_of):
    docs = docs_of([(i, "t") for i in range(2400)])
    before = {r["doc_id"]: r["shard"] for r in rows_of(shard_documents(docs, 24))}
    after = {r["doc_id"]: r["shard"] for r in rows_of(shard_documents(docs, 25))}
    assert sum(before[i] != after[i] for i in before) < 0.4 * len(before)


def test_defined_results_for_odd_rows(docs_of):
    rows = rows_of(shard_documents(docs_of(
        [(None, None), (None, None), (1, ""), (2, "é" * 100_000), (2, "é" * 100_000)]), 2, 8))
    assert len(rows) == 5
    assert sorted(r["size"] for r in rows) == [8, 8, 8, 200_008, 200_008]
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 2} == {
        zlib.crc32(("é" * 100_000).encode())}
    assert {r["text_crc32"] for r in rows if r["doc_id"] is None} == {0}
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5
    assert rows_of(shard_documents(docs_of([]), 24)) == []


def test_plan_has_no_python(docs_of):
    plan = shard_documents(docs_of([(1, "a")]).filter(F.col("doc_id") > 0), 4, 8)
    assert "Python" not in plan._jdf.queryExecution().optimizedPlan().toString()
