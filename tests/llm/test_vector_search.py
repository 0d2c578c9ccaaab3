"""Operators 11 and 13 against plain loops over every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from insightloom.llm import hard_negatives, pivot_search, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def _whole(x, scale):
    return [math.floor(scale * float(np.float32(c))) for c in x] if x is not None and all(c is not None and math.isfinite(c) for c in x) else None


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def _order(score, vec_id):
    return (-score, vec_id is None, vec_id or 0)


def _top(rows, every, k, scale=1024):
    rows = [(i, v, w) for i, (v, e, _) in enumerate(rows) if (w := _whole(e, scale)) is not None]
    out = []
    for i, q, x in rows:
        if q is not None and q % every == 0:
            best = sorted(((_dot(x, y), v) for j, v, y in rows if j != i), key=lambda t: _order(*t))[:k]
            out += [(q, n + 1, v, s) for n, (s, v) in enumerate(best)]
    return sorted(out, key=repr)


def _negatives(rows, every, label=lambda v, y: y, scale=256):
    rows = [(i, v, label(v, y), w) for i, (v, e, y) in enumerate(rows) if y is not None and (w := _whole(e, scale)) is not None]
    out = []
    for i, a, la, x in rows:
        if a is None or a % every:
            continue
        scored = sorted(((_dot(x, y), v, lab) for j, v, lab, y in rows if j != i), key=lambda t: _order(t[0], t[1]))
        for p, pid, _ in [t for t in scored if t[2] == la][:5]:
            fit = [t for t in scored if t[2] != la and 50 * p <= 100 * t[0] <= 95 * p][:3]
            out += [(a, pid, n + 1, t[1], p, t[0]) for n, t in enumerate(fit)]
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _made(kind, n, dim, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[i % 6]
        x = [r.gauss(0, 1) for _ in range(dim)] if kind == "spread" else [a + r.gauss(0, 0.05) for a in c]
        if kind == "hot" and i % 3 == 0:
            x = centres[0]  # a third of all rows are one vector
        rows.append((i, [float(np.float32(a)) for a in x], r.randrange(4)))
    return rows


@pytest.mark.parametrize("kind", ["spread", "groups", "hot"])
def test_top_k_and_negatives_against_every_pair(spark, kind):
    rows = _made(kind, 700, 6, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _rows(pivot_search.top_k(df, F.col("vec_id") % 20 == 0, k=10, pivots=8, most_rings=8, block=32)) == _top(rows, 20, 10)
    assert _rows(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"), a_block=8, c_block=16)) == _negatives(rows, 20)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (20, [1.0, 0.5], 0), (20, [1.0, 0.5], 0), (None, [1.0, 0.5], 0), (None, [0.9, 0.1], 1), (3, [1.0, 0.5], 0), (4, [0.5, 0.0], 1), (5, [0.7, 0.0], 1), (6, [0.7, 0.0], None), (40, [-1.0, 0.0], 1)]
    rows += [(60, None, 1), (80, [None, 1.0], 1), (100, [float("nan"), 1.0], 1), (120, [float("inf"), 1.0], 1), (140, [], 1), (160, [0.25], 1), (8, [0.0, 0.0], 2), (9, [-0.001, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _rows(pivot_search.top_k(df, F.col("vec_id") % 20 == 0, k=3)) == _top(rows, 20, 3)
    assert _rows(pivot_search.top_k(df, F.col("vec_id") % 20 == 0, k=100, block=2)) == _top(rows, 20, 100)
    assert _rows(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"))) == _negatives(rows, 20)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert _rows(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, moved)) == _negatives(rows, 20, lambda v, y: (y + 1) % 10 if v is not None and v % 7 == 0 else y)


def test_empty_tables_single_rows_and_other_columns(spark):
    for rows in ([], [(0, [1.0], 0)], [(0, None, 0)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert _rows(pivot_search.top_k(df, F.col("vec_id") % 20 == 0)) == [] and _rows(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"))) == []
    rows = _made("groups", 60, 3, 1)
    df = spark.createDataFrame([(*r, "x", 1, "y", 2.0) for r in rows], SCHEMA + ", v string, row int, asks string, score double")
    assert _rows(pivot_search.top_k(df, F.col("vec_id") % 20 == 0)) == _top(rows, 20, 10)
    assert _rows(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"))) == _negatives(rows, 20)
    # no query, no anchor
    assert _rows(pivot_search.top_k(df, F.col("vec_id") < 0)) == [] and _rows(hard_negatives.mine(df, F.col("vec_id") < 0, F.col("label"))) == []


def test_many_labels_and_large_numbers(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-5e5, 5e5), r.uniform(0, 1e5)], i % 90) for i in range(400)] + [(400, [3e38, 1.0], 0), (420, [1e9, 1.0], 0)]  # the last two leave a long
    df = spark.createDataFrame(rows, SCHEMA)
    assert _rows(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"), a_block=4, c_block=8)) == _negatives(rows[:400], 20)
    small = [(i, [x / 1e4 for x in e], y) for i, e, y in rows[:400]]
    assert _rows(pivot_search.top_k(spark.createDataFrame(small, SCHEMA), F.col("vec_id") % 20 == 0, block=16)) == _top(small, 20, 10)


def test_pruning_opens_few_annuli(spark, monkeypatch):
    """On vectors in groups a query stops after a part of the annuli."""
    rows = _made("groups", 1200, 8, 9)
    table = vectors.integers(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 1024)
    some, dim, top = vectors.sample(table)
    assert dim == 8 and len(some) == 1200
    square = (some.astype(float) ** 2).sum(axis=1)
    space = pivot_search.Space(pivot_search.choose_pivots(some, np.sqrt(np.maximum(top - square, 0)), 8), top)
    d = space.of_rows(some)
    ring = np.argmin(d, axis=1)
    names = np.unique(ring)
    rings = pivot_search.Rings(names, np.array([d[ring == p, p].min() for p in names]), np.array([d[ring == p, p].max() for p in names]), names)
    q = some[:50]
    scores = vectors.products(q, some)
    kth = np.sort(scores, axis=1)[:, -11]
    bound = rings.bounds(space.of_queries(q))
    opened = bound <= space.reach(q, kth, np.ones(50, dtype=bool))[:, None]
    assert opened.mean() < 0.6
    for i in range(50):  # no better row stands in an annulus that stays shut
        assert set(ring[scores[i] >= kth[i]]) <= set(names[opened[i]])


def test_exact_products_of_large_and_small_numbers():
    r = np.random.default_rng(1)
    for scale in (10, 1 << 20, 1 << 26):
        a, b = r.integers(-scale, scale, (7, 5)), r.integers(-scale, scale, (9, 5))
        assert vectors.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
