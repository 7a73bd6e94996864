"""Hard negatives and nearest neighbours against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hard_negatives, projection_forest
from tessella.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, x string, names int, scores int, tile int, ids int, leaves string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "leaf") for r in rows], SCHEMA).repartition(3)


def vectors(n, dims=6, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dims)]
        if rows and rng.random() < 0.3:
            v = list(rng.choice(rows)[1])  # a copy
        rows.append((i, v, rng.randrange(3)))
    odd = [(1001, None, 1), (1002, [1.0] * dims, None), (1003, [float("nan")] * dims, 1), (1004, [float("inf")] * dims, 1), (1005, [None] + [1.0] * (dims - 1), 1), (None, [1.0] * dims, 1), (1006, [], 2), (1007, [1.0, 2.0], 0), (1008, [0.0] * dims, 1), (-10, [0.5] * dims, 1)]
    return rows + odd + rows[:5] + [(7, [9.0] * dims, 2), (8, [-9.0] * dims, 0)]


def usable(rows, label=True):
    best = {}
    for i, v, k in rows:
        if i is None or v is None or (label and k is None) or any(c is None or not math.isfinite(c) for c in v):
            continue
        key = (k, v) if label else (v,)
        best[i] = min(best.get(i, key), key)
    return best


def plain_negatives(rows, every, positives=5, negatives=10, band=(30, 90)):
    known = {i: (k, [math.floor(256 * c) for c in v]) for i, (k, v) in usable(rows).items()}
    out = set()
    for a, (label, x) in known.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y, strict=False)) for i, (_, y) in known.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if known[i][0] == label][:positives]:
            fit = [i for i in order if known[i][0] != label and band[0] * score[p] <= 100 * score[i] <= band[1] * score[p]]
            out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fit[:negatives], 1)}
    return out


@pytest.mark.parametrize("far", [0.0, 2.0**50])
def test_hard_negatives(spark, far):
    """With a component of 2^50, which no anchor has, a field is wider than 64 bits."""
    rows = vectors(150)
    if far:
        rows = [(i, v and [*v, 0.0], k) for i, v, k in rows] + [(3001, [0.0] * 6 + [far], 1), (3003, [1.0] * 6 + [-far], 2)]
        assert hard_negatives.Fields(int(far) * 256, 1000).long
    got = [tuple(r) for r in hard_negatives.mined(table(spark, rows), "vec_id % 10 = 0").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows, 10) and got


def test_hard_negatives_edges(spark):
    empty = table(spark, [])
    assert hard_negatives.mined(empty, "vec_id % 10 = 0").collect() == []
    assert hard_negatives.mined(table(spark, [(1, [1.0], 1)]), "vec_id % 10 = 0").collect() == []
    assert hard_negatives.mined(table(spark, [(0, [1.0], 1)]), "vec_id % 10 = 0").collect() == []
    copies = [(i, [1.0, 2.0], 0) for i in range(40)] + [(100 + i, [0.5, 1.0], 1) for i in range(400)]
    got = {tuple(r) for r in hard_negatives.mined(table(spark, copies), "vec_id = 0").collect()}
    assert got == {(0, p, k + 1, 100 + k, 327680, 163840) for p in range(1, 6) for k in range(10)}


def test_fields_hold_every_product():
    """Packed products at the very bounds of their fields, for every width."""
    rng = np.random.default_rng(2)
    for most in (1, 3, 255, 1 << 20, 1 << 28):
        for dims in (1, 5):
            a = rng.integers(-most, most + 1, (7, dims))
            a[0], a[1] = most, -most
            c = rng.integers(-most, most + 1, (11, dims))
            c[0], c[1] = most, -most
            f = hard_negatives.Fields(most, int(np.abs(a).sum(axis=1).max()))
            a, c = (a.astype(object), c.astype(object)) if f.long else (a, c)
            assert (f.products(a, f.packed(c), 11) == a.astype(object) @ c.astype(object).T).all()


def plain_neighbours(rows, every, most=20):
    known = {i: v for i, (v,) in usable(rows, label=False).items() if any(v)}
    out = {}
    for q, x in known.items():
        if q % every == 0:
            score = {}
            for i, y in known.items():
                total = 0.0
                for a, b in zip(x, y, strict=False):
                    total += a * b
                if i != q:
                    score[i] = total
            out[q] = [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:most]]
    return out


def by_query(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_neighbours_of_a_table_that_is_one_leaf(spark):
    """All vectors are met, so the result is exact: copies, ties, norms of all sizes, short vectors."""
    rows = vectors(40)
    rows[3] = (3, [50.0 * c for c in rows[3][1]], 1)
    got = by_query(projection_forest.neighbours(table(spark, rows), "vec_id % 5 = 0", budget=100.0))
    assert got == plain_neighbours(rows, 5)


def test_neighbours_edges(spark):
    assert projection_forest.neighbours(table(spark, []), "vec_id % 2 = 0").collect() == []
    assert projection_forest.neighbours(table(spark, [(2, [1.0], 0)]), "vec_id % 2 = 0").collect() == []
    assert by_query(projection_forest.neighbours(table(spark, [(2, [1.0], 0), (3, [-1.0], 0), (5, [0.0], 1)]), "vec_id % 2 = 0")) == {2: [(3, -1.0)]}
    copies = [(i, [1.0, 2.0], 0) for i in range(3000)]
    assert by_query(projection_forest.neighbours(table(spark, copies), "vec_id in (0, 5, 2999)")) == {q: [(i, 5.0) for i in range(22) if i != q][:20] for q in (0, 5, 2999)}


def test_neighbours_of_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    rows = [(i, [float(c) for c in centres[i % 30] + 0.3 * rng.normal(size=24)], 0) for i in range(3000)]
    got, want = by_query(projection_forest.neighbours(table(spark, rows), "vec_id % 20 = 0", budget=0.3)), plain_neighbours(rows, 20)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95


def test_registered_neighbours(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = plain_neighbours(rows, 20)
    found = QUERIES["op12_nearest_neighbours"](spark, sf_dir)
    got = by_query(found)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())
    again = by_query(projection_forest.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(7), "vec_id % 20 = 0"))
    assert again == got  # however rows are dealt out
    assert found.where(F.col("query_id") == F.col("vec_id")).count() == 0
