import random

import numpy as np
import pytest

from careline.llm.lattice import near_vectors, nearest, shortest

SCHEMA = "vec_id long, embedding array<float>, label int, node string, size int"


def brute(rows, threshold=0.98):
    good, out = [], {}
    for k, (i, v, label, *_) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.append((k, i, np.array(v, np.float32).astype(float), label))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * len(rows)
    for a in range(len(good)):
        for b in range(a):
            ka, _, va, la = good[a]
            kb, _, vb, lb = good[b]
            if la == lb and len(va) == len(vb) and (
                    va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= threshold):
                links[ka] += 1
                links[kb] += 1
                parent[find(ka)] = find(kb)
    for k, (i, *_) in enumerate(rows):
        out.setdefault(find(k), []).append(i)
    return sorted((rows[k][0], links[k], min(out[find(k)])) for k in range(len(rows)))


def vectors(rng, n, d=64):
    rows = []
    while len(rows) < n:
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, 6)):
            v = base + rng.normal(size=d) * rng.choice([0, 0.08, 0.1, 0.13, 0.2])
            rows.append((len(rows), (v * rng.choice([1, 3])).tolist(), int(rng.integers(0, 3)) // 2,
                         "x", 1))
    return rows


def test_links_and_components_against_brute_force(spark):
    rows = vectors(np.random.default_rng(1), 500)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = brute(rows)
    assert sum(n for _, n, _ in want) > 100
    mine = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    found, there = sum(n for _, n, _ in mine), sum(n for _, n, _ in want)
    assert 0.98 * there <= found <= there
    assert sum(a == b for a, b in zip(mine, want)) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    v = [0.5, -1.0, 2.0]
    rows = [(1, v, 1, "x", 1), (2, v, 1, "x", 1), (2, v, 1, "x", 1), (3, v, None, "x", 1),
            (4, None, 1, "x", 1), (5, [0.0, 0.0, 0.0], 1, "x", 1), (6, [0.5, None, 2.0], 1, "x", 1),
            (7, [float("nan"), 1.0, 1.0], 1, "x", 1), (8, [float("inf"), 1.0, 1.0], 1, "x", 1),
            (9, [], 1, "x", 1), (10, [*v, 0.0], 1, "x", 1), (11, [1.0, -2.0, 4.0], 1, "x", 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept)
                 for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    linked = {1: (3, 1), 2: (3, 1), 11: (3, 1)}
    assert got == sorted((i, *linked.get(i, (0, i)), linked.get(i, (0, i))[1] == i)
                         for i, *_ in rows)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_lattice_point():
    rng, steps = np.random.default_rng(0), shortest()
    assert len(steps) == 240
    x = rng.normal(size=(500, 8)) * 2
    points = nearest(x)
    whole = np.all(points == np.rint(points), axis=1)
    assert (np.all(points[~whole] - 0.5 == np.rint(points[~whole] - 0.5), axis=1)).all()
    assert (points.sum(axis=1) % 2 == 0).all()
    own = ((x - points) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()
    for step in steps:
        assert (own <= ((x - points - step) ** 2).sum(axis=1) + 1e-9).all()


def test_long_chains_are_one_component(spark):
    from careline.llm.components import components

    ids = list(range(200))
    random.Random(0).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000, 1001), (1001, 1000), (5, 5)],
                                  "p long, q long")
    got = {r.node: r.component for r in components(edges, "p", "q").collect()}
    assert got == {**{i: 0 for i in ids}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("dimension", [8, 16, 32, 64, 384])
def test_recall_by_dimension(spark, dimension):
    """Pairs just above the threshold, each in a direction of its own."""
    rng, rows = np.random.default_rng(dimension), []
    for _ in range(600):
        a, b = rng.normal(size=(2, dimension))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        for v in (a, 0.981 * a + np.sqrt(1 - 0.981 ** 2) * b):
            rows.append((len(rows), v.tolist(), 1, "x", 1))
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    there = sum(n for _, n, _ in brute(rows)) if dimension == 8 else 1200
    assert 0.99 * there <= sum(r.n_links for r in got) <= there
