"""Near-duplicate vectors by E8 lattice hashing, within equal labels."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careline.llm.common import written
from careline.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Dimensions of the lattice.
E8 = 8


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 of each row: the better one of D8 and D8 shifted by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        points = np.rint(y)
        odd = np.flatnonzero(points.sum(axis=1) % 2)
        rest = y[odd] - points[odd]
        worst = np.abs(rest).argmax(axis=1)
        points[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
        return points
    whole, half = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def shortest() -> np.ndarray:
    """The 240 shortest vectors: the steps to neighbouring cells."""
    steps = [[s if k == i else t if k == j else 0 for k in range(E8)]
             for i, j in itertools.combinations(range(E8), 2) for s in (1, -1) for t in (1, -1)]
    steps += [list(h) for h in itertools.product((0.5, -0.5), repeat=E8)
              if sum(c < 0 for c in h) % 2 == 0]
    return np.array(steps, float)


def rotations(dimension: int, tables: int, seed: int = 7) -> list[np.ndarray]:
    """One projection to eight dimensions a table; those of one rotation are orthogonal."""
    padded = -(-dimension // E8) * E8
    out: list[np.ndarray] = []
    rng = np.random.default_rng([seed, dimension])
    while len(out) < tables:
        q = np.linalg.qr(rng.normal(size=(padded, padded)))[0][:dimension]
        out += [q[:, i:i + E8] for i in range(0, padded, E8)]
    return out[:tables]


def cell_codes(points: np.ndarray) -> np.ndarray:
    """32 bits of a lattice point."""
    code = np.full(len(points), 0x243F6A8885A308D3, np.uint64)
    for column in np.rint(2 * points).astype(np.int64).T:
        code = (code ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return (code >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cells(classes: DataFrame, threshold: float, tables: int, reach: float) -> DataFrame:
    """(class_id, label, dimension, table, cell, home, own): cells a vector lies in or probes.

    own: its cells in all tables, in order. A cell measures 1.84 of what the distance at the threshold
    is in eight of the dimensions (0.65 of it whole, of 64 dimensions), so that the chance of a common
    cell is much the same for any number of them; a neighbouring cell is probed if the border is
    nearer than `reach` cells.
    """
    distance = np.sqrt(max(2 - 2 * threshold, 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shortest()
        turned: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = np.array([vectors[i] for i in at], float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if d not in turned:
                    turned[d] = rotations(d, tables)
                scale = 0.65 * np.sqrt(64 / (-(-d // E8) * E8)) * distance
                placed = [(x @ q) / scale for q in turned[d]]
                points = [nearest(p) for p in placed]
                own = np.stack([cell_codes(p) for p in points], axis=1)
                for t in range(tables):
                    towards = (placed[t] - points[t]) @ steps.T
                    row, step = np.nonzero(towards >= 1 - reach * np.sqrt(2.0))
                    rows = np.concatenate([np.arange(len(at)), row])
                    codes = np.concatenate([own[:, t], cell_codes(points[t][row] + steps[step])])
                    home = np.arange(len(rows)) < len(at)
                    flat = pa.array(own[rows].ravel(), pa.int32())
                    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at][rows]), pa.array(labels[at][rows], pa.int64()),
                         pa.array(np.full(len(rows), d, np.int32)),
                         pa.array(np.full(len(rows), t, np.int32)), pa.array(codes),
                         pa.array(home), pa.ListArray.from_arrays(offsets, flat)],
                        ["class_id", "label", "dimension", "table", "cell", "home", "own"])

    return classes.select("class_id", "label", "vector").mapInArrow(
        run, "class_id long, label long, dimension int, table int, cell int, home boolean, "
             "own array<int>")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tables: int = 8,
                 reach: float = 0.1) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `vectors`.

    `vectors` needs vec_id, embedding and label. Two vectors link if their labels are equal and not
    NULL and their cosine in double precision is at least `threshold`. A vector that is NULL, empty or zero,
    or holds NULL or non-finite components, links with nothing, nor do vectors of different
    length. Equal vectors of a label are one class, compared once. n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable, kept: it is the row's own.
    Repeated rows are vectors of their own and link; no rows give none.

    A pair meets where one vector's cell is the other's own or probed cell. It is compared in
    the first table in which both lie in one cell, else where probing finds it. What leaves the join are
    pairs of ids, no vectors.
    """
    number = F.col("embedding").cast("array<double>")
    finite = ((F.size(number) > 0)
              & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x)
                         & (F.abs(x) < F.lit(float("inf"))))
              & F.exists(number, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("label").cast("long").alias("label"),
                          number.alias("vector"),
                          F.coalesce(finite & F.col("label").isNotNull(), F.lit(False)).alias("fit"))
    fit = rows.filter("fit")
    classes = written(
        fit.groupBy("label", "vector").agg(F.count("*").alias("size"),
                                           F.min("vec_id").alias("first_id"))
        .withColumn("class_id", F.monotonically_increasing_id()), "classes")
    placed = cells(classes, threshold, tables, reach)
    met = ["label", "dimension", "table", "cell"]
    a = placed.select(*met, F.col("class_id").alias("a"), F.col("home").alias("home_a"),
                      F.col("own").alias("own_a"))
    b = placed.filter("home").select(*met, F.col("class_id").alias("b"), F.col("own").alias("own_b"))
    first_common = F.expr("array_position(zip_with(own_a, own_b, (x, y) -> x = y), true)")
    pairs = (a.join(b, met).filter(
        F.when(F.col("home_a"), (F.col("a") < F.col("b")) & (first_common == F.col("table") + 1))
        .otherwise((F.col("a") != F.col("b")) & (first_common == 0)))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    known = classes.select("class_id", "vector", norm.alias("norm"))
    left = known.toDF("a", "va", "na")
    right = known.toDF("b", "vb", "nb")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    links = written(pairs.join(left, "a").join(right, "b")
                    .filter(dot / F.col("na") / F.col("nb") >= threshold).select("a", "b"), "links")
    sizes = classes.select("class_id", "size")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (both.join(sizes, both["b"] == sizes["class_id"]).groupBy("a")
              .agg(F.sum("size").alias("others")))
    groups = components(links, "a", "b")
    labelled = (classes.select("class_id", "label", "vector", "size", "first_id")
                .join(others, F.col("class_id") == F.col("a"), "left")
                .join(groups, F.col("class_id") == F.col("node"), "left")
                .select("class_id", "label", "vector", "first_id",
                        (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "class_id").alias("component")))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "component").select("label", "vector", "n_links", "component_id")
    linked = fit.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
