"""Language-model scores by a probabilistic suffix tree over words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.block_sums import RANK_BITS, Arrays, BlockTable, Sums, block_of, numbers, pack, unpack

#: The word after the last; real words are never empty.
END = b""
MAX_DEPTH = 3
#: A context may be retained if it comes MIN_COUNT times.
MIN_COUNT = 20
#: Tokens of a block, and tokens before it that it holds as well, for the contexts of its first ones.
BLOCK_TOKENS, BEFORE = 1 << 20, 2 * MAX_DEPTH
#: Bytes of text split at once.
PIECE_BYTES = 2_000_000
#: Divergences are summed as whole numbers of 1/GAIN_UNIT, so that no order of blocks matters.
GAIN_UNIT = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space: what bytes.lower() and bytes.split() take."""
    return text.lower().split()


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(tokens, text number of each): the texts' words, each text's with END behind, in pieces of bounded size."""
    tokens: list[bytes] = []
    owner: list[tuple[int, int]] = []
    size = 0

    def piece() -> tuple[list[bytes], np.ndarray]:
        return tokens, np.repeat(np.array([o for o, _ in owner], np.int64), [n for _, n in owner])

    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            cut = len(text)
            if cut - at > limit:
                m = _BLANK.search(text, at + limit)
                cut = m.start() if m else cut
            part = words_of(text[at:cut])
            at = max(cut, 1)
            if at >= len(text):
                part.append(END)
            tokens += part
            owner.append((i, len(part)))
            size += len(part) * 8
            if size > limit:
                yield piece()
                tokens, owner, size = [], [], 0
    if tokens:
        yield piece()


def _binary(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """Texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def word_hash(word: bytes) -> int:
    """A word's symbol: its 64-bit hash."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 7)


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """The symbols of n words."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 7) for w in words), np.uint64, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cell_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Key of each context with the word behind it, which is the context that the two make."""
    return mixed(contexts * np.uint64(0x9E3779B97F4A7C15) + words)


def contexts_before(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(context, valid) before each position, by depth, by hashes alone, to compare with what `Text` finds by numbers; END may only be the oldest word of one. A context is the cell of its newest word."""
    end = np.uint64(word_hash(END))
    code, valid = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    out = []
    for depth in range(1, MAX_DEPTH + 1):
        longer, ok = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
        longer[1:] = cell_keys(code[:-1], words[:-1])
        ok[1:] = valid[:-1] & (True if depth == 1 else words[:-1] != end)
        code, valid = longer, ok
        out.append((code, valid))
    return out


class Space(NamedTuple):
    """What numbers mean: how many buckets gave them, and bounds of the numbers of words and, by depth, of contexts that come MIN_COUNT times."""

    depth: int
    buckets: int
    words: int
    contexts: tuple[int, ...] = ()

    def bits(self, depth: int) -> int:
        """Bits of a cell's key: as few as tell apart all contexts of the depth with all words behind them."""
        return min(64, max(2, (self.contexts[depth - 1] * self.words - 1).bit_length()))

    def cells(self, depth: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A key for each context with the word behind it: their numbers as one, evenly spread over its bits, one to one. Numbers of over 64 bits are hashed."""
        bits = self.bits(depth)
        if self.contexts[depth - 1] * self.words > 1 << 64:
            return cell_keys(contexts, words)
        mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
        x = contexts * np.uint64(self.words) + words
        for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
        return x ^ (x >> half)


# --- blocks ------------------------------------------------------------------------------


def by_frequency(times: np.ndarray) -> np.ndarray:
    """Places of words from the most frequent one."""
    return np.argsort(-times, kind="stable")


def tokens_of(block: Arrays) -> np.ndarray:
    """Place of each token among the block's sorted words."""
    return by_frequency(block["times"])[block["at"]]


def encoded(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`docs` (t, row, id, held_out) as blocks: (block, data, words, rows, ids, n_train).

    words has `words` (the block's different words, sorted), which only ask for
    the words' numbers. data has `times` (how often each of them comes), `end`
    (END's place among them), `at` (each token's place among them by frequency,
    which packs smaller), and `size` and `out` of each run of tokens of one text.
    A text may be cut between blocks. The first BEFORE tokens stand before the
    block and belong to no text of it.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint64(word_hash(END))
        before = np.full(BEFORE, end)
        # The block's words, numbered as they come.
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbered: list[np.ndarray] = []
        runs: list[tuple] = []
        blocks, held = 0, 0
        task = TaskContext.get().partitionId() << 32

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal before, held, blocks, number
            hashes = word_hashes(number, len(number))
            words = np.unique(np.concatenate([before, hashes]))
            at = np.concatenate([np.searchsorted(words, before), np.searchsorted(words, hashes)[np.concatenate(numbered)]])
            times = np.bincount(at, minlength=len(words))
            place = np.empty(len(words), np.int32)
            place[by_frequency(times)] = np.arange(len(words))
            size, out = np.array([r[0] for r in runs], np.int32), np.array([r[1] for r in runs], np.uint8)
            data = pack({"times": times, "end": np.array([end_of({"words": words})]), "at": place[at], "size": size, "out": out})
            columns = [pa.array([task + blocks]), pa.array([data], pa.binary()), pa.array([pack({"words": words})], pa.binary()), pa.array([[r[2] for r in runs]], pa.list_(pa.int64())), pa.array([[r[3] for r in runs]], pa.list_(id_type)), pa.array([int(size[out == 0].sum())])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "data", "words", "rows", "ids", "n_train"])
            before = np.full(BEFORE, end) if words[at[-1]] == end else words[at[-BEFORE:]]
            numbered.clear(), runs.clear()
            number = defaultdict(count().__next__)
            blocks, held = blocks + 1, 0

        for b in batches:
            rows, ids, outs = (b.column(i).to_pylist() for i in (1, 2, 3))
            for tokens, owner in pieces(_binary(b, 0), min(PIECE_BYTES, 8 * block_tokens)):
                numbered.append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))
                held += len(tokens)
                texts, sizes = np.unique(owner, return_counts=True)  # texts come in order
                runs += [(n, outs[i], rows[i], ids[i]) for i, n in zip(texts.tolist(), sizes.tolist())]
                if held >= block_tokens:
                    yield from flush(b.column(2).type)
        if numbered:
            yield from flush(b.column(2).type)

    return docs.select("t", "row", "id", "held_out").mapInArrow(encode, f"block long, data binary, words binary, rows array<long>, ids array<{kind}>, n_train long")


class Text:
    """A block's tokens, and what answers tell of their contexts of one depth at a time, from none at depth 0.

    `after` tells how often each token comes behind its context in training
    texts, `kept` whether that context is retained, and `p` is the token's
    probability behind its longest retained context; without `norm` there is
    none. `at`, `keys` and `number` are the places of the tokens whose cell is
    asked for, the cells' sorted keys and the place's among these.
    """

    def __init__(self, block: Arrays, space: Space, norm: float | None = None) -> None:
        self.block, self.space, self.depth = block, space, 0
        self.tokens, self.out = tokens_of(block), out_of(block)
        self.end = end_of(block)
        self.at, self.number = np.arange(len(self.tokens)), self.tokens
        self.after = block["w.n"][self.tokens]
        self.kept = np.ones(len(self.tokens), bool)
        self.p = None if norm is None else (self.after + 0.5) / norm

    def _answers(self, name: str) -> np.ndarray:
        """An answer for each of the depth's cells, which are words at depth 0; a block that asked for none has none."""
        return self.block.get(f"c{self.depth}.{name}" if self.depth else f"w.{name}", np.zeros(0, np.int64))

    def find(self) -> Text:
        """Goes a depth on, where a context is the last depth's cell of its newest word, and finds cells.

        A context comes MIN_COUNT times in training texts, and END may only be the
        oldest word of one. Left out are cells of tokens that never come behind the
        shorter context in training texts, so neither behind this one.
        """
        n = self._answers("n")
        # Ranks of contexts, in the order of the last depth's cells.
        self.ranks = self._answers("ctx_id")
        ends = (n >= MIN_COUNT)[self.number] & (self.at < len(self.tokens) - 1)
        if self.depth:
            ends &= self.tokens[self.at] != self.end
        self.depth += 1
        self.places, self.context = self.at[ends] + 1, self.number[ends]
        self.count = n[self.context]
        asked = self.after[self.places] > 0
        self.at = self.places[asked]
        contexts = numbers(self.ranks, self.space.buckets)[self.context[asked]]
        words = numbers(self.block["w.id"], self.space.buckets)[self.tokens[self.at]]
        self.keys, self.number = np.unique(self.space.cells(self.depth, contexts, words), return_inverse=True)
        return self

    def add(self) -> Text:
        """Takes the answers for cells."""
        self.after = np.zeros(len(self.tokens), np.int64)
        self.after[self.at] = self._answers("n")[self.number]
        return self

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, counts, sorted ranks of contexts, number of each place's) of the tokens whose shorter context is retained."""
        some = self.kept[self.places]
        context = self.context[some]
        # Ranks rise with their places, so that nothing is to be sorted.
        there = np.zeros(len(self.ranks), bool)
        there[context] = True
        return self.places[some], self.count[some], self.ranks[there].astype(np.uint64), (np.cumsum(there) - 1)[context]

    def settle(self) -> Text:
        """Takes the answers for contexts.

        Counts are smoothed towards the shorter context's distribution, by Witten
        and Bell's weight; without a context, by a half.
        """
        at, total, keys, number = self.contexts()
        t = self.block[f"x{self.depth}.t"][number] if len(keys) else np.zeros(0, np.int64)
        some = t > 0
        at, t = at[some], t[some]
        if self.p is not None:
            self.p[at] = (self.after[at] + t * self.p[at]) / (total[some] + t)
        self.kept = np.zeros(len(self.tokens), bool)
        self.kept[at] = True
        return self

    def down(self, depth: int) -> Text:
        """Goes to a depth that all is answered for."""
        while self.depth < depth:
            self.find().add().settle()
        return self

    def cells(self) -> Arrays:
        """How often each cell of the depth comes in the block's training texts."""
        return {"keys": self.keys, "n": np.bincount(self.number[~self.out[self.at]], minlength=len(self.keys)).astype(np.int64)}


# --- what is asked of all blocks ---------------------------------------------------------


def end_of(block: Arrays) -> int:
    """END's place among the block's words; -1 where it isn't one."""
    if "end" in block:
        return int(block["end"][0])
    end = np.uint64(word_hash(END))
    place = int(np.searchsorted(block["words"], end))
    return place if place < len(block["words"]) and block["words"][place] == end else -1


def out_of(block: Arrays) -> np.ndarray:
    """Whether each token is none to learn from: of a held-out text, or before the block."""
    return np.concatenate([np.ones(BEFORE, np.uint8), np.repeat(block["out"], block["size"])]) == 1


def ask_words(block: Arrays) -> list[Arrays]:
    """How often each word comes in the block's training texts."""
    return [{"keys": block["words"], "n": np.bincount(tokens_of(block)[~out_of(block)], minlength=len(block["words"])).astype(np.int64)}]


def decide_cells(sums: Arrays) -> Arrays:
    """The counts, and ranks of the contexts that cells (or words) of MIN_COUNT make."""
    return {"n": sums["n"], "ctx_id": np.cumsum(sums["n"] >= MIN_COUNT)}


def decide_words(sums: Arrays) -> Arrays:
    """Those of words, and ranks of all words."""
    return decide_cells(sums) | {"id": np.arange(len(sums["n"]))}


class Asks:
    """What blocks ask for: the counts of a depth's cells (a context with the word behind it), then what becomes of its contexts, together with the next depth's cells."""

    def __init__(self, depth: int, norm: float, space: Space) -> None:
        self.depth, self.norm, self.space = depth, norm, space

    def cells(self, block: Arrays) -> list[Arrays]:
        """The counts of the first depth's cells."""
        return [Text(block, self.space).find().cells()]

    def contexts(self, block: Arrays) -> list[Arrays]:
        """The part that each cell has in its context's divergence, from the first block that has the cell; and the counts of the next depth's cells."""
        text = Text(block, self.space, self.norm).down(self.depth - 1).find().add()
        at, total, contexts, number = text.contexts()
        # Of each cell that is the block's to count, one place.
        one = np.full(len(text.tokens), False)
        own = block[f"c{self.depth}.owner"] if len(text.keys) else np.zeros(0, np.uint8)
        places = np.zeros(len(own), np.int64)
        places[text.number] = text.at
        one[places[own == 1]] = True
        counts = one[at] & (text.after[at] > 0)
        n = text.after[at[counts]]
        gain = n * np.log(n / total[counts] / text.p[at[counts]])
        # Who counts no cell of a context only asks for it.
        most = np.zeros(len(contexts), np.int64)
        most[number[counts]] = total[counts]
        asked = {"keys": contexts, "t": np.bincount(number[counts], minlength=len(contexts)).astype(np.int64), "gain": np.rint(GAIN_UNIT * np.bincount(number[counts], gain, minlength=len(contexts))).astype(np.int64), "most": most}
        return [asked, text.find().cells()] if self.depth < self.space.depth else [asked]


def decide_contexts(sums: Arrays) -> Arrays:
    """Different next words of the contexts that are retained, 0 for others.

    A context is retained if its divergence from the shorter one, times its
    count, exceeds what its number of different next words would bring by chance
    (half a log of the count each).
    """
    return {"t": np.where(sums["gain"] / GAIN_UNIT > 0.5 * sums["t"] * np.log(np.maximum(sums["most"], 1)), sums["t"], 0)}


def same(sums: Arrays) -> Arrays:
    """The sums themselves."""
    return sums


def scores(table: BlockTable, depth: int, norm: float, space: Space) -> DataFrame:
    """(row, id, held_out, n_tokens, n_known, base, score) of each run of tokens of one text."""
    kind = table.rows.schema["ids"].dataType.elementType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = block_of(b.column(0)[i], b.column(1)[i])
                text = Text(block, space, norm)
                known, base = text.after > 0, np.log10(text.p)
                score = np.log10(text.down(depth).p)
                starts = np.cumsum(block["size"]) - block["size"]
                known, base, score = (np.add.reduceat(x[BEFORE:].astype(np.float64), starts) for x in (known, base, score))
                values = [b.column(2).slice(i, 1).flatten(), b.column(3).slice(i, 1).flatten(), pa.array(block["out"] == 1), pa.array(block["size"].astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(values, names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score"])

    return table.known("rows", "ids").mapInArrow(score, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")


def first_words(table: BlockTable) -> int:
    """Different words of all training texts: each block counts those that it is the first to have."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for x in b.column(0):
                answers = unpack(x.as_py())
                n += int(((answers["w.owner"] == 1) & (answers["w.n"] > 0)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return table.answers[0].select("answers").mapInArrow(firsts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 1. Null ids aren't."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 1, F.lit(False))


def suffix_tree_scores(df: DataFrame, id_column: str = "doc_id", text: str = "text", depth: int = MAX_DEPTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every row of `df` scored by a tree that its training rows teach.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score:
    log10 probabilities under the smoothed word counts and under the tree, whose
    symbols are all words and whose contexts are all that come MIN_COUNT times
    and diverge. Null, empty and blank texts are the end alone; repeated rows are
    counted and scored as often as they come; texts of any length are read in
    pieces. Without training rows nothing is known and every token has its
    smoothed probability. Other columns are left out, whatever their names.

    The corpus is encoded once, in blocks. Blocks ask for the counts of their
    words, of the cells behind contexts, and for what becomes of contexts;
    each sum goes to all blocks that asked. Nothing is held but a block, and no
    bound on words or contexts decides anything.
    """
    docs = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), held_out(id_column).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = BlockTable(encoded(docs, block_tokens), parts, once="words")
    blocks, train_tokens = table.rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    buckets = max(parts, blocks // 4)
    table.exchange([Sums("w", decide_words)], ask_words, buckets)
    top = table.tops()
    norm = train_tokens + 0.5 * (first_words(table) + 1)
    space = Space(depth, buckets, buckets * (top.get("w.id", 0) + 1), (buckets * (top.get("w.ctx_id", 0) + 1),))
    cells = lambda d: Sums(f"c{d}", decide_cells if d < depth else same, span=1 << space.bits(d))
    table.exchange([cells(1)], Asks(1, norm, space).cells, buckets)
    for d in range(1, depth + 1):
        sums = [Sums(f"x{d}", decide_contexts, owner=False, span=buckets << RANK_BITS)]
        if d < depth:
            space = space._replace(contexts=(*space.contexts, buckets * (table.tops().get(f"c{d}.ctx_id", 0) + 1)))
            sums.append(cells(d + 1))
        table.exchange(sums, Asks(d, norm, space).contexts, buckets)
    sums = ["n_tokens", "n_known", "base", "score"]
    whole = scores(table, depth, norm, space).groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in sums])
    return whole.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
