"""Exact top-k against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest

from heddle.llm.topk import LISTS, local_best, sufficient_entries, top_k


def brute(rows, k=10):
    ok = [(i, vid, [math.floor(1024 * float(x)) for x in v]) for i, (vid, v) in enumerate(rows) if vid is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, vid, q in ok:
        if vid % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), other, j) for j, other, v in ok if j != i))[:k]
            out += [(vid, n, other, -s) for n, (s, other, _) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,scale", [(0, 1.0), (1, 1e5), (2, 1e-3)])
def test_same_as_brute_force(spark, seed, scale):
    r = random.Random(seed)
    rows = [(i * 10, [r.gauss(0, 1) * scale for _ in range(8)]) for i in range(90)]
    rows += [(200, rows[20][1]), (7, rows[20][1]), (8, rows[20][1]), (9, [-x for x in rows[20][1]])]  # ties and a repeated id
    rows += [(300, None), (400, [1.0, None] * 4), (500, [float("nan")] * 8), (600, [float("inf")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(x) for x in top_k(df.repartition(5), "id % 100 = 0").collect())
    assert got == brute(rows)


def test_whole_numbers_beyond_doubles(spark):
    rows = [(0, [2e6, 1.0]), (1, [3e6, 1.0]), (2, [3e6, 1.0009765625]), (3, [-3e6, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in top_k(df, "id % 100 = 0").collect()) == brute(rows)


def test_few_candidates_and_blocks_of_queries(spark, monkeypatch):
    rows = [(i * 100, [1.0 * i, 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in top_k(df, "id % 100 = 0").collect()) == brute(rows)
    monkeypatch.setattr("heddle.llm.topk.BLOCK_QUERIES", 2)
    assert sorted(tuple(x) for x in top_k(df, "id % 100 = 0").collect()) == brute(rows)
    assert top_k(df.limit(0), "id % 100 = 0").count() == 0
    assert top_k(df.limit(1), "id % 100 = 0").count() == 0


def test_lengths_differ(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 1.0, 9.0]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in top_k(df, "id % 100 = 0").collect()) == brute(rows)


def test_the_cutoff_saves_products():
    """Clustered vectors: most pairs are dropped before their last lists are summed, and no sufficient one is."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 64))
    v = np.floor(300 * (centres[r.integers(0, 40, 2_000)] + 0.2 * r.normal(size=(2_000, 64)))).astype(np.int64)
    q, own = v[:50], np.arange(2_000)[:, None] == np.arange(50)[None, :]
    total = np.where(own, -(1 << 60), v @ q.T)
    cut = np.sort(local_best(v, q, own, 10), axis=0)[-10]
    assert (cut <= np.sort(total, axis=0)[-10]).all()
    rows, j, score, products = sufficient_entries(v, q, own, cut)
    assert products < 0.7 * LISTS * own.size
    assert {(a, b): c for a, b, c in zip(rows.tolist(), j.tolist(), score.tolist())} .items() >= {(a, b): total[a, b] for a, b in zip(*np.nonzero(total >= cut))}.items()
