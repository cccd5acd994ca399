"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from heddle.llm.simhash import fingerprint, fingerprint_links, links_of_run, one_per_component, simhash_components, variant_keys, variant_masks


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += c
    if not words:
        return 0
    s = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(i) for i in range(len(fps))]


def near_copies(r, n):
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(1, 120))] for _ in range(n)]
    texts = [" ".join(b) for b in base]
    for b in base[: n // 2]:
        for _ in range(3):
            c = list(b)
            if r.random() < 0.8:
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(r.choice(("\n", " ", "\t ")).join(c).upper() if r.random() < 0.3 else " ".join(c))
    return texts


def test_fingerprint_is_the_definition():
    r = random.Random(1)
    for t in [*near_copies(r, 20), "", None, " \n", "É A É", "one", " ", "a\x1cb c", "the the the the the"]:
        assert fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("rest", [(1 << 64) - 1, 0x00FF_F0F0_0FF0_FFFF, 0b1011_0111])
def test_every_close_pair_shares_a_variant(rest):
    (masks, left), rng = variant_masks(rest), np.random.default_rng(0)
    assert all(int(m) & ~rest == 0 and int(m) & int(x) == 0 and int(x) & ~rest == 0 for m, x in zip(masks, left))
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 200, dtype=np.uint64)
    b = a.copy()
    bits = [x for x in range(64) if rest >> x & 1]
    for i in range(200):
        for bit in rng.choice(bits, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    assert (variant_keys(a, masks) == variant_keys(b, masks)).any(axis=1).all()


def test_too_few_segments_are_refused():
    with pytest.raises(ValueError):
        variant_masks(distance=6)


def test_links_of_a_run_span_its_groups():
    f = np.array([0, 1, 3, 1 << 20, 0xFF << 30, 0xFFF << 30], np.uint64)
    pairs = {(int(x), int(y)) for a, b in links_of_run(f) for x, y in zip(a, b)}
    assert len(pairs) == 4


@pytest.mark.parametrize("split,shared", [(1 << 15, 0), (3, 0), (3, 40)])
def test_links_give_brute_force_components(spark, split, shared):
    """Also where buckets are split again and again, and where most fingerprints have bits in common."""
    r = random.Random(5)
    fps = [r.getrandbits(64 - shared) for _ in range(60)]
    for f in fps[:40]:
        for _ in range(4):
            g = fps[r.randrange(len(fps))] if r.random() < 0.5 else f
            for bit in r.sample(range(64), r.randint(0, 6)):
                g ^= 1 << bit
            fps.append(g)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), split=split).collect()
    at = {s: i for i, s in enumerate(signed)}
    group = list(range(len(fps)))
    for x in links:
        assert bin((x.src ^ x.dst) & ((1 << 64) - 1)).count("1") <= 4
    changed = True
    while changed:
        changed = False
        for x in links:
            i, j = at[x.src], at[x.dst]
            m = min(group[i], group[j])
            changed |= group[i] != m or group[j] != m
            group[i] = group[j] = m
    assert group == brute_groups(fps)


def test_components_of_texts(spark):
    texts = [*near_copies(random.Random(2), 30), "", None, "  ", "solo text", "solo text"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "alone here", "x"), (None, texts[0], "x")], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(df).collect()]
    fps = [brute_fingerprint(t) for t in texts]
    want = [(i, f"{f:016x}", g) for i, (f, g) in enumerate(zip(fps, brute_groups(fps)))]
    want += [want[3], (None, f"{brute_fingerprint('alone here'):016x}", None), (None, want[0][1], want[0][2])]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = one_per_component(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w[2] for w in want}, key=str)


def test_long_texts_and_repeated_ids(spark):
    r = random.Random(8)
    long = " ".join(f"v{r.randrange(5000)}" for _ in range(150_000))  # crosses BLOCK_SHINGLES
    assert fingerprint(long) == brute_fingerprint(long)
    df = spark.createDataFrame([(7, long, 1), (7, long, 2), (7, "other words here now", 3), (8, long + " end", 4), (9, "other words here now", 5)], "doc_id long, text string, id long")
    kept = one_per_component(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(7, long), (7, "other words here now")])
    assert one_per_component(df.limit(0)).count() == 0


def test_no_documents(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
