"""Skew-safe joins, prefix sums, ranks and components against brute force."""

import hashlib
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from heddle.operators.components import connected_components
from heddle.operators.skew import global_rank, hot_keys, lookup_join, prefix_sum
from heddle.plans.storage import materialize, shared_root


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


def test_components_of_random_graphs_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5001 + i) for i in range(200)]
    edges += [(7, None), (None, None), (8000, 8000), *edges[:5]]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_components(edges)


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    only_loops = connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).collect()
    assert [(x.node, x.component) for x in only_loops] == [(1, 1)]


def test_lookup_join_splits_hot_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    assert hot_keys(left, "k", 10) == ["hot"]
    got = lookup_join(left, right, "k", 10)
    assert got.count() == 3000
    assert got.where("v = 1").count() == 1000 and got.where("v = 2").count() == 1


def test_prefix_sum_of_a_hot_group(spark):
    rows = [("a" if i % 3 else "b", hashlib.md5(str(i).encode()).hexdigest(), i, i % 7 if i % 11 else None, 13) for i in range(900)]
    got = prefix_sum(spark.createDataFrame(rows, "g string, h string, i long, v long, p long"), "g", "p", ["h", "i"], "v", "before").collect()
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        before = [0, *accumulate(r[3] or 0 for r in own)][:-1]
        assert {r.i: r.before for r in got if r.g == g} == {r[2]: b for r, b in zip(own, before)}


def test_global_rank_with_nulls_and_ties(spark):
    names = ["b", "a", None, "c", "é", "B"]
    got = global_rank(spark.createDataFrame([(n,) for n in names], "n string"), [F.col("n").asc_nulls_last()], "place").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.place)] == ["B", "a", "b", "c", "é", None]
    assert global_rank(spark.createDataFrame([], "n string"), [F.col("n")], "place").count() == 0


def test_materialize_keeps_schema_and_uses_the_shared_folder(spark):
    df = materialize(spark.createDataFrame([], "a long, b array<string>"), "x")
    assert df.schema.simpleString() == "struct<a:bigint,b:array<string>>"
    assert all(shared_root(spark).removeprefix("file://") in f for f in df.inputFiles())


def test_long_chains_and_cycles_have_levels(spark):
    from heddle.operators.audit import plan_levels

    n = 104
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)] + [(None,)], "id int")
    needs = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(n, n + 1), (n + 1, n), (5, 5_000)], "id int, needs int")
    assert sorted((r.id, r.level) for r in plan_levels(nodes, needs).collect()) == sorted([*((i, i) for i in range(n)), (n + 2, 0)])


def test_vectors_meet_in_blocks(spark, monkeypatch):
    import numpy as np

    from heddle.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 7)
    x = np.round(np.random.default_rng(1).normal(size=(40, 6)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (None, [1.0] * 6)], "id long, v array<double>")
    cos = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    pairs = {(r.id_a, r.id_b) for r in vectors.similar_pairs(df, 0.5).collect()}
    assert pairs == {(i, j) for i in range(40) for j in range(i + 1, 40) if round(cos[i, j], 6) >= 0.5}
    near = {(r.query_id, r.rank): r.id for r in vectors.nearest(df, df.where("id < 10"), 3).collect()}
    for q in range(10):
        order = sorted((i for i in range(40) if i != q), key=lambda i: (-round(cos[q, i], 6), i))
        assert [near[q, k] for k in (1, 2, 3)] == order[:3]


def test_search_and_quotes_against_brute_force(spark, monkeypatch):
    import random

    from heddle.operators import matching

    monkeypatch.setattr(matching, "QUOTE_BLOCK", 3)
    r = random.Random(3)
    words = ["the"] * 8 + [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(200, None), (None, "the w1")]
    phrases = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(15)] + [(90, ""), (91, None), (92, "absent")]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = {(x.phrase_id, x.rank): (x.id, x.n_shared) for x in matching.search_hits(spark.createDataFrame(phrases, "phrase_id long, phrase string"), docs, 4).collect()}
    want = {}
    for p, t in phrases:
        n = sorted((-len(set((t or "").split()) & set(x.split())), i) for i, x in texts if x and i is not None)
        want |= {(p, k + 1): (i, -c) for k, (c, i) in enumerate(n[:4]) if c}
    assert got == want
    quotes = [(1, "w1 the"), (2, "w"), (3, "w2"), (4, "the w3 the"), (5, "w2 w3"), (6, ""), (7, None), (8, " "), (9, "he w1 w1"), (10, "w1 w2 w3 w4")]
    held = {(x.quote_id, x.id) for x in matching.verbatim(spark.createDataFrame(quotes, "quote_id long, quote string"), docs).collect()}
    assert held == {(q, i) for q, s in quotes if s for i, t in texts if t and i is not None and s in t}


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from heddle.plans.storage import shared_root

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))
