"""The mix against brute force."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from heddle.llm.mixing import SCHEDULES, fill_targets, invert_schedule, mix, placed_copies


def brute(docs):
    size = [len(re.findall("[^\\x20\\x09-\\x0D]+", t or "")) for _, t, _ in docs]
    names = sorted({s for _, _, s in docs if s is not None}, key=lambda s: s.encode("utf-32-be")) + ([None] if any(s is None for _, _, s in docs) else [])
    total = {s: sum(z for z, d in zip(size, docs) if d[2] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, target = sum(total.values()), set(names), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w >= 3 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
        left -= sum(3 * total[s] for s in over)
    taken = {}
    for s in names:
        at, words = 0, math.floor(target[s] + 0.5)
        q, rest = divmod(words, total[s]) if total[s] else (0, 0)
        order = sorted((hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest(), i) for i, d in enumerate(docs) if d[2] == s)
        for _, i in order:
            taken[i] = q * size[i] + max(0, min(size[i], rest - at))
            at += size[i]
    return [(d[0], size[i], total[d[2]], round(target[d[2]], 6), taken[i]) for i, d in enumerate(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    r = random.Random(seed)
    sources = ["s1", "s2", "\U0001f600", "�", "z", None, "tiny", "empty"]
    docs = [(i, "w " * r.choice((0, 1, 7, 300)), r.choice(sources[:6])) for i in range(120)]
    docs += [(500, "one two", "tiny"), (501, None, "empty"), (502, "  x\x0by", "z"), (None, "no id", "s1")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    rows = mix(df).collect()
    got = [(x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in rows]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)
    for s in {x.source for x in rows}:
        own = [x for x in rows if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 1
        assert all(x.taken <= 3 * x.size for x in own)
        placed = sorted((x.position, hashlib.md5(str(x.doc_id or "").encode()).hexdigest()) for x in own if x.position is not None)
        assert all(0 <= p <= 1 for p, _ in placed)
    assert {tuple(x) for x in rows} == {tuple(x) for x in mix(df.repartition(7)).collect()}


def test_positions_are_range_sorted(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    parts = [[x.position for x in p] for p in mix(df).rdd.glom().collect()]
    flat = [-1 if x is None else x for p in parts for x in p]
    assert flat == sorted(flat)


@pytest.mark.parametrize("knots", SCHEDULES)
def test_inverse_of_the_integral(spark, knots):
    def share(t):
        area = lambda t0, w0, t1, w1, x: w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        whole = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        return sum(area(t0, w0, t1, w1, min(max(t - t0, 0), t1 - t0)) for (t0, w0), (t1, w1) in zip(knots, knots[1:])) / whole

    times = [k / 40 for k in range(41)]
    df = spark.createDataFrame([(t, share(t)) for t in times], "t double, d double").select("t", invert_schedule(F.col("d"), knots).alias("x"))
    assert all(abs(r.t - r.x) < 1e-6 for r in df.collect())


def test_no_words_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken, r.position) for r in mix(df).collect()] == [(0, 0.0, 0, None)] * 2
    assert mix(df.limit(0)).count() == 0


def test_targets_need_no_driver_loop_over_sources(spark):
    s = spark.createDataFrame([(1, 100), (2, 1), (3, 1000)], "weight long, source_size long")
    got = {r.weight: r.target for r in fill_targets(s).collect()}
    assert got == {1: 274.5, 2: 3.0, 3: 823.5}


def test_every_copy_has_its_position(spark):
    docs = [(i, "a b", "a") for i in range(4)] + [(i, "w " * 10, "hot") for i in range(10, 110)] + [(200, "x y z", "z"), (201, None, "z")]
    mixed = mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    rows = placed_copies(mixed).collect()
    assert [x.position for x in rows] == sorted(x.position for x in rows)
    taken = {}
    for x in rows:
        taken[x.doc_id] = taken.get(x.doc_id, 0) + x.taken
    assert taken == {x.doc_id: x.taken for x in mixed.collect() if x.taken}
    # a level schedule over three passes of four documents of two words each
    assert [(x["pass"], x.position) for x in rows if x.source == "a"] == [(k // 4, round(k * 2 / 24, 9)) for k in range(12)]
    # the third schedule falls from 2 to 0.5: the last pass of the only document starts where two thirds are met
    last = [x.position for x in rows if x.source == "z"]
    assert len(last) == 3 and last[0] == 0 and abs(last[2] - 0.5) < 1e-8


def test_equal_rows_are_set_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr("heddle.llm.mixing.RUN", 7)
    docs = [(None, "a b", "hot")] * 100 + [(None, "a", "hot")] * 3 + [(1, "c d e", "hot"), (2, "x", None)] + [(3, "same", "cold")] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix(df).collect()
    key = lambda rows: sorted((str(r[0]), r[1], r[2], r[3], r[4]) for r in rows)
    assert len(got) == len(docs) and key([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got]) == key(brute(sorted(docs, key=lambda d: len(d[1] or ""))))
    hot = sorted((r.before, r.size) for r in got if r.source == "hot")
    assert all(a + n == b for (a, n), (b, _) in zip(hot, hot[1:]))


def test_very_long_texts(spark):
    docs = [(1, "w " * 1_000_000, "a"), (2, "x\n" * 7, "a"), (3, "y" * 2_000_000, "b"), (4, "", "b")]
    got = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == sorted(brute(docs))
