"""The suffix tree: brute-force base scores, proper distributions, gain on held-out text, odd inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from heddle.llm import suffix_lm as lm
from heddle.llm.block_sums import RANK_BITS, RANKS, Sums, buckets_of, pack, steps, summed, unpack


def corpus(n=400, seed=0):
    r = random.Random(seed)
    follow = {w: r.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(n):
        w, out = r.randrange(40), []
        for _ in range(r.randint(1, 60)):
            w = r.choice(follow[w]) if r.random() < 0.8 else r.randrange(40)
            out.append(f"W{w}" if r.random() < 0.97 else f"odd{r.randrange(500)}x{w}")
        rows.append((i, r.choice((" ", "\n", "\t ")).join(out)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \x0b"), (n + 3, " É one"), (5, "W1 W1"), (5, "W1 W1"), (None, "W2 only")]


def tokens(t):
    return (t or "").encode().lower().split() + [b""]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(rows):
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows]


def test_base_scores_and_gain(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    got = lm.suffix_tree_scores(df.repartition(3)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(base(rows), key=str)
    unseen = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in unseen) > 0.8 * sum(r.base_score for r in unseen)


def test_scores_do_not_depend_on_partitions_or_held_out_texts(spark):
    rows = corpus(150)
    other = [(i, "something else entirely") if out(i) else (i, t) for i, t in rows]
    score = lambda rs, n: sorted((str(r.doc_id), round(r.score, 5)) for r in lm.suffix_tree_scores(spark.createDataFrame(rs, "doc_id long, text string").repartition(n)).collect() if not r.held_out)
    assert score(rows, 1) == score(rows, 6) == score(other, 2)


def test_contexts_are_cells_of_shorter_ones():
    w = np.array([lm.word_hash(x) for x in (b"", b"", b"", b"a", b"b", b"", b"c", b"d")], np.uint64)
    (one, ok1), (two, ok2), (three, ok3) = lm.contexts_before(w)
    assert ok1[1:].all() and ok2.tolist() == [False, False, False, False, True, True, False, True] and ok3.tolist() == [False] * 5 + [True, False, False]
    assert (two[1:] == lm.cell_keys(one[:-1], w[:-1])).all() and two[4] != two[5]


def test_pieces_cover_long_texts():
    texts = [b"aa bb " * 100, b"", b"x" * 500, b"c"]
    got: dict[int, list[bytes]] = {}
    for toks, owner in lm.pieces(texts, 50):
        for t, o in zip(toks, owner.tolist()):
            got.setdefault(o, []).append(t)
    assert got == {i: t.lower().split() + [b""] for i, t in enumerate(texts)}


def test_nothing_to_learn(spark):
    only_out = [i for i in range(30) if out(i)][:2]
    df = spark.createDataFrame([(i, "a b") for i in only_out], "doc_id long, text string")
    got = lm.suffix_tree_scores(df).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got] == [(0, 0, 0.0)] * 2
    assert lm.suffix_tree_scores(df.limit(0)).count() == 0


def brute_scores(rows):
    """The tree over all words, by dictionaries."""
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    norm = sum(c.values()) + 0.5 * (len(c) + 1)
    after = {}
    before = lambda s, i: [tuple(s[i - d : i]) for d in range(1, lm.MAX_DEPTH + 1) if i >= d and b"" not in s[i - d + 1 : i]]
    for i, t in rows:
        s = [b"", *tokens(t)]
        for k in range(1, len(s)) if not out(i) else ():
            for x in before(s, k):
                after.setdefault(x, Counter())[s[k]] += 1
    kept = {}

    def p(x, w):
        if not x:
            return (c[w] + 0.5) / norm
        a = after[x]
        return (a[w] + len(a) * p(x[1:], w)) / (a.total() + len(a))

    def keep(x):
        if x not in kept:
            a = after.get(x, Counter())
            n = a.total()
            kept[x] = n >= lm.MIN_COUNT and (len(x) == 1 or keep(x[1:])) and sum(k * math.log(k / n / p(x[1:], w)) for w, k in a.items()) > 0.5 * len(a) * math.log(n)
        return kept[x]

    scores = []
    for i, t in rows:
        s, total = [b"", *tokens(t)], 0.0
        for k in range(1, len(s)):
            state = [x for x in before(s, k) if keep(x)]
            total += math.log10(p(state[-1] if state else (), s[k]))
        scores.append((str(i), round(total, 5)))
    return sorted(scores), {x: after[x].total() for x in kept if kept[x]}


def test_all_words_and_contexts_against_brute_force(spark):
    # over 60,000 tokens, where the count asked for used to rise with the corpus
    rows = corpus(3_000, 1) + [(i, "zq1 zq2") for i in range(10_000, 10_026)]
    want, kept = brute_scores(rows)
    got = lm.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert lm.MIN_COUNT <= kept[b"zq1",] < sum(r.n_tokens for r in got if not r.held_out) / 3_000
    have = sorted((str(r.doc_id), r.score) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(have, want))


@pytest.mark.parametrize("size", [50, 2_000])
def test_blocks_that_cut_texts_change_nothing(spark, size):
    """Encoded in blocks of any size, also within texts, a corpus has the same scores."""
    rows = corpus(300, 7) + [(9_000, " ".join(f"w{i % 11}" for i in range(3_000)))]
    want, _ = brute_scores(rows)
    got = lm.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), block_tokens=size)
    have = sorted((str(r.doc_id), r.score) for r in got.collect())
    assert [i for i, _ in have] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(have, want))


def test_sums_by_key_are_answered_to_every_block():
    r = np.random.default_rng(5)
    asked = []
    for block in range(5):
        keys = np.unique(r.integers(0, 60, 30).astype(np.uint64) * np.uint64(1 << 57))
        asked.append((block, {"keys": keys, "n": r.integers(0, 9, len(keys)), "most_x": r.integers(0, 9, len(keys))}))
    total, most, first = {}, {}, {}
    for block, a in asked:
        for k, n, x in zip(a["keys"].tolist(), a["n"].tolist(), a["most_x"].tolist()):
            total[k], most[k] = total.get(k, 0) + n, max(most.get(k, 0), x)
            first.setdefault(k, block)
    found = {block: [] for block, _ in asked}
    for bucket in range(4):
        part = [(block, {n: x[a:z] for n, x in v.items()}) for block, v in asked for i, a, z in buckets_of(v["keys"], 4) if i == bucket]
        part = [(block, unpack(pack(v | {"keys": steps(v["keys"])}))) for block, v in part]
        for block, answer in summed(part, lambda s: s) if part else ():
            found[block] += zip(answer["n"].tolist(), answer["most_x"].tolist(), answer["owner"].tolist())
    for block, a in asked:
        assert found[block] == [(total[k], most[k], int(first[k] == block)) for k in a["keys"].tolist()]
    assert unpack(pack({"a": np.zeros(0, np.int32), "b": np.array([1.5, -2])})) .keys() == {"a", "b"}


def answered(block, sums, asked, buckets):
    """A single block's answers, as an exchange gives them."""
    for of, ask in zip(sums, asked):
        parts = []
        for bucket, a, z in buckets_of(ask["keys"], buckets, of.span):
            part = {n: x[a:z] for n, x in ask.items()}
            sent = unpack(pack(part | {"keys": steps(part["keys"])}))
            parts += [{n: x + (bucket << RANK_BITS) if n in RANKS else x for n, x in got.items()} for _, got in summed([(0, sent)], of.decide)]
        new = unpack(pack({f"{of.tag}.{n}": np.concatenate([p[n] for p in parts]) for n in parts[0]}))
        block = block | new
    return block


def test_numbered_contexts_are_those_by_hashes_and_their_requests_are_small():
    """A cell was asked for by a hash of 6 packed bytes; numbers of contexts and words take fewer, and mean the same contexts."""
    r = np.random.default_rng(2)
    symbols = np.array([lm.word_hash(w) for w in [b"", *(b"w%d" % i for i in range(5_000))]], np.uint64)
    tokens = symbols[np.minimum(r.zipf(1.3, 200_000) - 1, 5_000)]
    tokens[: lm.BEFORE] = symbols[0]
    words, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
    place = np.empty(len(words), np.int32)
    place[lm.by_frequency(times)] = np.arange(len(words))
    block = {"words": words, "times": times, "at": place[at], "size": np.array([len(at) - lm.BEFORE]), "out": np.zeros(1, np.uint8)}
    assert (words[lm.tokens_of(block)] == tokens).all()
    block = answered(block, [Sums("w", lm.decide_words)], lm.ask_words(block), 7)
    top = lambda n: 7 * (int((block[n] & ((1 << RANK_BITS) - 1)).max()) + 1)
    space, count = lm.Space(lm.MAX_DEPTH, 7, top("w.id")), block["w.n"][lm.tokens_of(block)]
    for d, (code, valid) in enumerate(lm.contexts_before(tokens), 1):
        space = space._replace(contexts=(*space.contexts, top("w.ctx_id" if d == 1 else f"c{d - 1}.ctx_id")))
        text = lm.Text(block, space)
        for _ in range(d - 1):
            text.find().add()
        text.find()
        before = np.concatenate([[0], count[:-1]])
        assert text.places.tolist() == np.flatnonzero(valid & (before >= lm.MIN_COUNT)).tolist()
        _, own = np.unique(lm.cell_keys(code[text.at], tokens[text.at]), return_inverse=True)
        assert len(text.keys) == own.max() + 1 == len(set(zip(own.tolist(), text.number.tolist())))
        asked = text.cells()
        assert len(pack({"keys": steps(asked["keys"])})) < 4 * len(asked["keys"])
        block = answered(block, [Sums(f"c{d}", lm.decide_cells, span=1 << space.bits(d))], [asked], 7)
        count = lm.Text(block, space)
        for _ in range(d):
            count.find().add()
        count = count.after


def test_cell_keys_are_one_to_one_and_fill_their_bits():
    space = lm.Space(1, 1, 300, (70,))
    contexts, words = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(70), np.arange(300)))
    keys = np.sort(space.cells(1, contexts, words))
    assert len(np.unique(keys)) == 21_000 and keys[-1] < 1 << space.bits(1) == 1 << 15
    assert all(3_500 < z - a < 4_900 for _, a, z in buckets_of(keys, 5, 1 << 15))
    wide = lm.Space(1, 1, 1 << 40, (1 << 30,))
    assert wide.bits(1) == 64 and (wide.cells(1, contexts, words) == lm.cell_keys(contexts, words)).all()


def test_packed_signs_ranks_and_wide_numbers():
    given = {"gain": np.array([5, -3, 0, -(1 << 62), (1 << 62)]), "x.id": np.array([1, 4, 4, 3 << RANK_BITS]), "words": np.array([2, 1 << 63], np.uint64), "f": np.array([-1.5, 2]), "one": np.zeros(3, np.uint8)}
    found = unpack(pack(given))
    assert all((found[n] == x).all() and found[n].dtype == x.dtype for n, x in given.items())


def test_each_shuffled_pass_asks_for_contexts_and_the_next_cells(spark, monkeypatch):
    """Seven passes over all blocks had become too many; shuffles are released behind each."""
    seen = []
    exchange = lm.BlockTable.exchange
    monkeypatch.setattr(lm.BlockTable, "exchange", lambda self, sums, *a: (seen.append([s.tag for s in sums]), exchange(self, sums, *a)))
    lm.suffix_tree_scores(spark.createDataFrame(corpus(100), "doc_id long, text string")).collect()
    assert seen == [["w"], ["c1"], ["x1", "c2"], ["x2", "c3"], ["x3"]]


def test_answers_are_written_once_and_words_leave_the_folder(spark, monkeypatch):
    """All earlier answers had been written again with each exchange's, and the words' hashes lay beside them to the end."""
    seen = []
    stored = lm.BlockTable._stored

    def names(self, rows):
        table, drop = stored(self, rows)
        binary = [c for c, kind in table.dtypes if kind == "binary"]
        seen.append({n for r in table.select(*binary).collect() for x in r for n in unpack(bytes(x))})
        return table, drop

    monkeypatch.setattr(lm.BlockTable, "_stored", names)
    lm.suffix_tree_scores(spark.createDataFrame(corpus(100), "doc_id long, text string")).collect()
    text = {"times", "end", "at", "size", "out"}
    assert seen[:2] == [text | {"words"}, text]
    answers = [{n.partition(".")[0] for n in s} for s in seen[2:]]
    assert answers[:3] == [{"w"}, {"c1"}, {"x1", "c2"}] and len(answers) == 5
    assert answers[3] <= {"x2", "c3"} and answers[4] <= {"x3"}
