"""Token counts against the library on whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.llm import tokens
from heddle.llm.tokens import boundaries, count_batch, count_huge, count_short, load_tokenizer, pieces, token_count

PARTS = ["a", "'ll", " ", "  ", "\n", "é", "1", "<|endoftext|>", "<|endof", "漢字", "!!", "'s", "\t", "x" * 50, "🙂", " ", "word "]


@pytest.fixture(scope="module")
def tok():
    return load_tokenizer(None)


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (100, 16), (150, 40)])
def test_chunked_equals_whole(tok, plain, chunk, overlap):
    r = random.Random(chunk)
    for k in range(120):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(1, 400)))
        if k % 5 == 0:  # runs longer than any overlap, and than a chunk
            s = "z" * r.randint(1, 900) + s + " " * r.randint(0, 500) + s
        assert count_huge(tok.tokenizer, s, chunk, overlap) == len(plain.encode(s, add_special_tokens=False).ids)


def test_boundaries_tile_the_text(tok):
    e = tok.tokenizer.encode("one two  three", add_special_tokens=False)
    assert boundaries(e) == {3: 1, 7: 2, 8: 3}


def test_boundaries_before_a_splice_stay_untrusted(tok, plain):
    r = random.Random(9)
    for _ in range(60):  # runs that make a chunk grow after a splice
        s = "".join(r.choice(("ab ", "c", " " * 30, "x" * 400, "'ll", "<|endoftext|>")) for _ in range(60))
        assert count_huge(tok.tokenizer, s, 90, 10) == len(plain.encode(s, add_special_tokens=False).ids)


def test_batches_keep_order(tok):
    texts = ["", "b" * 90_000, "a b c", "", "x y " * 30_000]
    assert count_batch(tok, texts, 1_000, 64) == [len(tok.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_cut_is_a_boundary(plain):
    before = plain.pre_tokenizer.pre_tokenize_str
    r = random.Random(4)
    some = [*range(0xD800), *range(0xE000, 0x10000), *(r.randrange(0x10000, 0x110000) for _ in range(20_000))]
    for c in map(chr, some):
        for text in (f"x {c}", f"x  {c}"):
            parts = pieces(text)
            if len(parts) > 1:
                assert any(a == len(parts[0]) for _, (a, _) in before(text)), hex(ord(c))


@pytest.mark.parametrize("known", [1, 5, 400_000])
def test_pieces_equal_whole(tok, plain, known, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", known)
    r = random.Random(known)
    tok.known.clear()
    for _ in range(30):
        texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(40)]
        texts += ["", " ", "  ", "a ", " a", "a  b ", "\n b\t c  "]
        want = [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert count_batch(tok, texts) == want
        assert len(tok.known) <= max(known, 200)
    clean = [t for t in texts if "<|endoftext|>" not in t]
    assert count_short(tok, clean) == [len(plain.encode(t, add_special_tokens=False).ids) for t in clean]


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "", 9), (2, "hello world", 9)], "doc_id long, text string, n_tokens long")
    got = df.select("doc_id", token_count("text").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 2)]
    assert df.limit(0).select(token_count(F.col("text"))).count() == 0
