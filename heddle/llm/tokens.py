"""Token counts of whole texts, with overlap resynchronisation for huge ones."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of more characters are encoded in overlapping chunks of that length.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: A boundary this far from a chunk's right end can't change by text beyond it: the
#: pre-tokenizer looks at most three characters past a match, and the longest added
#: token has fewer characters than this.
MARGIN_CHARS = 32
#: Characters handed to the library at once, which bounds its memory.
BATCH_CHARS = 1_000_000
#: Pieces of text whose counts a worker remembers, and characters of the longest of them.
KNOWN_PIECES, PIECE_CHARS = 400_000, 48
#: A space with something else than white space behind it, and one without.
_CUT, _NO_CUT = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")

_LOADED: dict = {}


class Counts:
    """A tokenizer with what is known of its counts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        #: Strings that are tokens before any rule is applied; texts that hold one aren't cut.
        self.whole = tuple(t["content"] for t in own["added_tokens"])
        before = own["pre_tokenizer"] or {}
        self.cuts = not own["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not own["model"].get("dropout")
        self.known: dict[str, int] = {}


def load_tokenizer(path: str | None = None) -> Counts:
    """The tokenizer of a .json file, as the library reads it but for truncation and padding; offsets keep white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        if path is None:
            import public_tokenizers

        _LOADED[path] = Counts(path or public_tokenizers.path("byte_bpe_50k.json"))
    return _LOADED[path]


def boundaries(encoding, begin: int = 0) -> dict[int, int]:
    """Where a pre-token ends and the next starts, for a text that starts at `begin`: {position: tokens before it}."""
    words, offsets = encoding.word_ids, encoding.offsets
    out = {}
    for i in range(1, len(words)):
        if (words[i] != words[i - 1] or words[i] is None) and offsets[i - 1][1] == offsets[i][0]:
            out[begin + offsets[i][0]] = i
    return out


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN_CHARS) -> int:
    """Tokens of a text of any length, from overlapping chunks.

    A chunk whose boundaries are true from some place on shows true ones up to
    `margin` before its end, as no match looks further ahead. Where the next
    chunk, which starts anywhere, shows one of these as well, it agrees with the
    whole text from there on, because a match depends only on what follows its
    start. The two are spliced there. Without a common boundary the overlap is
    doubled, at last to the whole first chunk, and then that chunk is doubled.
    """
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    total, start, end, true_from = 0, 0, min(chunk, len(text)), 0
    left = encode(start, end)
    while end < len(text):
        stable = {p: n for p, n in boundaries(left, start).items() if true_from <= p <= end - margin}
        splice, reach = None, overlap
        while splice is None and reach < end - start:
            begin, stop = end - reach, min(len(text), end + chunk)
            right = encode(begin, stop)
            mine = boundaries(right, begin)
            splice = max((p for p in stable if p in mine), default=None)
            reach *= 2
        if splice is None:
            end = min(len(text), 2 * end - start)
            left = encode(start, end)
        else:
            # What the next chunk has before the splice isn't counted.
            total += stable[splice] - mine[splice]
            start, end, left, true_from = begin, stop, right, splice
    return total + len(left.ids)


def pieces(text: str) -> list[str]:
    """A text cut before each space that has no white space behind it, without these spaces.

    A byte-level pre-tokenizer always has a boundary there: only a run of white
    space reaches past a space, and such a run leaves its last one to the word
    behind it. So the pieces' tokens (but for the first, with their spaces) are
    the text's. In the same way any of the pieces may stand behind any other.
    """
    return _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")


def count_short(counts: Counts, texts: list[str]) -> list[int]:
    """Tokens of each text by its pieces: those that come again are encoded once, the others of a text together."""
    cut = [pieces(t) for t in texts]
    known = counts.known
    fresh: Counter = Counter()
    for parts in cut:
        fresh.update(p for p in parts[1:] if p not in known)
    again = [p for p, n in fresh.items() if n > 1 and len(p) <= PIECE_CHARS]
    if len(known) + len(again) > KNOWN_PIECES:
        known.clear()
    library = counts.tokenizer
    for p, e in zip(again, library.encode_batch_fast([f" {p}" for p in again], add_special_tokens=False)):
        known[p] = len(e)
    out, rest = [], []
    for parts in cut:
        found = list(map(known.get, parts[1:]))
        if None in found:
            rest.append(" ".join([parts[0], *[p for p, n in zip(parts[1:], found) if n is None]]))
            out.append(sum(n for n in found if n is not None))
        else:
            rest.append(parts[0])
            out.append(sum(found))
    return [n + len(e) for n, e in zip(out, library.encode_batch_fast(rest, add_special_tokens=False))]


def count_batch(counts: Counts, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Tokens of each text; bounded memory for any mix of lengths. Texts that come again in the batch are counted once."""
    found: dict[str, int] = {}
    batch: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        whole = [t for t in batch if not counts.cuts or any(w in t for w in counts.whole)]
        found.update(zip(whole, map(len, counts.tokenizer.encode_batch_fast(whole, add_special_tokens=False))))
        cut = [t for t in batch if t not in found]
        found.update(zip(cut, count_short(counts, cut)))
        batch.clear()
        size = 0

    for text in dict.fromkeys(texts):
        if len(text) > chunk:
            found[text] = count_huge(counts.tokenizer, text, chunk, overlap)
        else:
            if size + len(text) > BATCH_CHARS:
                flush()
            batch.append(text)
            size += len(text)
    flush()
    return [found[t] for t in texts]


def token_count(text: str | Column, path: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Number of tokens of a text column; null and empty texts have 0.

    Rows are independent, so repeated rows and ties are counted alike, and any
    other columns stay as they are. No rows: no rows. Nothing is shuffled.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = load_tokenizer(path)
        for s in batches:
            yield pd.Series(count_batch(counts, [x or "" for x in s], chunk, overlap), dtype="int64")

    return tokens(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
