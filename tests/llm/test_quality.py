"""Votes: accuracy on rows held out, independence of what may not be used, odd inputs."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from heddle.llm.quality import GRID, UNKNOWN, fit_voters, learn, quality_scores, vectors, vote


def texts(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 80))]
        good = int(r.random() < 0.75)
        if not good:
            kind = i % 3
            words = [w + "***" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words for _ in range(6)]
        out.append((i, " ".join(words), good))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t, _ in rows], "doc_id long, text string, lang string, score int")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_accuracy_on_held_out_rows(spark):
    rows = texts(700)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(out)
    assert np.mean([got[i].predicted == rows[i][2] for i in out]) > 0.97


def test_held_out_labels_are_never_learned(spark):
    rows = texts(200)
    docs, labels = frames(spark, rows)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda l: sorted((r.doc_id, r.score) for r in quality_scores(docs, l).collect())
    assert score(labels) == score(flipped)


def test_exact_cosine_votes():
    x = vectors([t for _, t, _ in texts(60)])
    y = np.array([q for _, _, q in texts(60)])
    v = fit_voters(x, y)
    z = x.astype(np.float64) @ v.axes
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    for i, s in enumerate(vote(x, v, 5)):
        cos = v.vectors @ z[i] / GRID
        near = np.flatnonzero((cos >= np.sort(cos)[-5]) & (cos > 0))
        assert abs(s - (cos[near] ** 8 * y[near]).sum() / (cos[near] ** 8).sum()) < 1e-4


def test_scores_do_not_depend_on_the_batch(spark):
    rows = texts(700, seed=3)
    docs, labels = frames(spark, rows)
    v = fit_voters(vectors([t for _, t, _ in rows]), np.array([q for _, _, q in rows]))
    whole = vote(vectors([t for _, t, _ in rows]), v)
    for i in range(0, len(rows), 37):
        assert vote(vectors([rows[i][1]]), v)[0] == whole[i]
        assert np.array_equal(vote(vectors([t for _, t, _ in rows[i : i + 5]]), v), whole[i : i + 5])
    score = lambda d: sorted((r.doc_id, r.score) for r in quality_scores(d, labels).collect())
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    some = score(twice.orderBy(F.xxhash64("text", "doc_id")).repartition(7))
    assert some == score(twice.repartition(3, "text"))
    by_id = dict(some)
    assert all(by_id[i] == by_id[i + 10_000] for i, _, _ in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, ""), (3, "x " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none).collect()} == {UNKNOWN}
    labels = spark.createDataFrame([(None, 1), (3, None), (3, 7), (99, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not (r.text or "").strip()} == {UNKNOWN}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_labels_without_documents_take_no_place(spark):
    docs, labels = frames(spark, texts(60))
    more = labels.unionByName(spark.createDataFrame([(i, 1, 0) for i in range(1_000, 3_000)], "doc_id long, quality int, toxic int"))
    a, b = learn(docs, labels, limit=40), learn(docs, more, limit=40)
    assert len(b.labels) == 40 and np.array_equal(a.labels, b.labels) and np.array_equal(a.vectors, b.vectors)


def test_the_fit_is_bounded(spark):
    docs, labels = frames(spark, texts(100))
    assert len(learn(docs, labels, limit=10).labels) == 10
