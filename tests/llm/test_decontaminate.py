"""Contamination against brute force over all windows."""

import hashlib
import random
import re

import pytest

from heddle.llm.decontaminate import clean_documents, contamination

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    named |= ids
        ids = sorted(str(i) for i in named if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "é", "x9", "rare1", "rare2", "漢字"]
    text = lambda n: r.choice((" ", ", ", "_")).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice((1, 2, 3, 9, 10, 11, 25)))) for i in range(12)] + [(3, "a b"), (3, "a b"), (None, "rare1 rare2"), (50, ""), (51, None), (52, "--"), (53, "neverseen word")]
    docs = [(i, text(r.choice((0, 1, 5, 40, 200)))) for i in range(30)]
    docs += [(100, items[0][1].upper()), (100, items[0][1].upper()), (101, None), (None, "z " + (items[5][1] or "") + " z"), (102, text(3000))]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int")
    got = [tuple(x) for x in contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contamination(docs, none).collect()] == [False, False]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("heddle.llm.decontaminate.BLOCK_ROWS", 3)
    items = [(i, f"k{i} k{i + 1} k{i + 2}") for i in range(10)]
    docs = [(1, " ".join(f"k{i}" for i in range(13))), (2, "k1 k3 k2")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items))


def test_named_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "window", 7)], "doc_id long, text string, row string, start int")
    got = contamination(docs, spark.createDataFrame([(1, "b")], "item_id long, text string"), columns=["doc_id", "text", "row", "start"])
    assert got.columns[:4] == ["doc_id", "text", "row", "start"] and got.first().n_hit == 1


def test_a_window_of_many_items_in_many_documents(spark):
    items = [(i, f"own{i} common words here") for i in range(60)] + [(100 + i, "common words") for i in range(60)]
    docs = [(i, "see common words here") for i in range(200)] + [(i, "see own3 common words here " * 900) for i in (500, 501)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items))


def test_clean_documents_stay(spark):
    docs = [(1, "a b", "x"), (1, "c", "x"), (1, "c", "x"), (None, "b a", "y"), (None, None, "y"), (2, "", None), (3, "q " * 50_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, digest string")
    got = clean_documents(df, spark.createDataFrame([(1, "b")], "item_id long, text string"))
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([d for d in docs if "b" not in (d[1] or "").split()], key=str)
    assert clean_documents(df.limit(0), spark.createDataFrame([(1, "b")], "item_id long, text string")).count() == 0
