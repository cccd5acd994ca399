"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample that is fitted and broadcast: rows * DIMENSIONS floats.
MAX_LABELLED = 4_096
SHAPES, WORDS = 512, 512
#: Share of a document's weight that its words have; the rest have the shapes of its words.
WORD_WEIGHT = 0.25
DIMENSIONS = 64
NEIGHBOURS = 24
#: A neighbour's vote weighs its cosine to this power, a power of two.
SHARPNESS = 8
#: Score of texts without words, and of all texts if there are no labels.
UNKNOWN = 0.5
#: Documents in one block of cosine products.
BLOCK_DOCS = 512
CACHED_WORDS = 400_000
#: Vectors are whole multiples of 1 / GRID. Their products and sums stay far below 2**53, so doubles
#: hold them exactly, and a text's cosines are the same in a block of any shape.
GRID = float(1 << 20)


@dataclass
class Voters:
    """What scoring needs, in units of 1 / GRID; its size depends on the parameters only."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _shape(word: str) -> str:
    """Case class of a word's letters and the first three marks at its end."""
    core = len(word)
    while core and not word[core - 1].isalnum():
        core -= 1
    stem, tail = word[:core], word[core : core + 3]
    if not stem:
        kind = "-"
    elif stem.islower():
        kind = "l"
    elif stem.isupper():
        kind = "U" if len(stem) > 1 else "T"
    elif stem[:1].isupper() and stem[1:].islower():
        kind = "T"
    else:
        kind = "d" if stem.isdigit() else "m"
    return kind + tail


def term_counts(text: str | None, known: dict[str, tuple[int, int]]) -> np.ndarray | None:
    """Counts of hashed word shapes, of immediate repetitions and of hashed words; None without words."""
    words = (text or "").split()
    if not words:
        return None
    at: list[int] = []
    n: list[int] = []
    for w, k in Counter(words).items():
        ids = known.get(w)
        if ids is None:
            if len(known) > CACHED_WORDS:
                known.clear()
            ids = zlib.crc32(_shape(w).encode("utf-8", "surrogatepass")) % (SHAPES - 1) + 1, SHAPES + zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
            known[w] = ids
        at += ids
        n += (k, k)
    out = np.bincount(at, n, minlength=SHAPES + WORDS)
    out[0] = sum(map(str.__eq__, words, words[1:]))
    return out


def vectors(texts: list[str | None]) -> np.ndarray:
    """One row of damped, normalised term counts per text, in units of 1 / GRID; zeros without words."""
    known: dict[str, tuple[int, int]] = {}
    out = np.zeros((len(texts), SHAPES + WORDS), np.int32)
    for i, t in enumerate(texts):
        if (c := term_counts(t, known)) is not None:
            # Roots of the counts, each part divided by its length: the root of the counts' sum.
            out[i, :SHAPES] = np.rint(np.sqrt(c[:SHAPES] / c[:SHAPES].sum()) * GRID)
            out[i, SHAPES:] = np.rint(np.sqrt(c[SHAPES:] / c[SHAPES:].sum()) * (WORD_WEIGHT * GRID))
    return out


def places(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of `x` on the axes, in units of 1 / GRID; zeros where a row has no part on them."""
    z = np.rint(x.astype(np.float64) @ axes / GRID)
    norm = np.sqrt((z * z).sum(axis=1))[:, None]
    return np.rint(z / np.where(norm > 0, norm, 1) * GRID)


def fit_voters(x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Voters:
    """Latent-semantic axes of the labelled rows (a truncated SVD of their weighted terms) and the rows' places on them."""
    df = (x > 0).sum(axis=0)
    weight = np.where(df > 0, np.log((1 + len(x)) / (1 + df)) + 1, 0)
    gram = np.zeros((x.shape[1],) * 2)
    for a in range(0, len(x), BLOCK_DOCS):
        y = x[a : a + BLOCK_DOCS].astype(np.float64)
        gram += y.T @ y  # whole numbers
    _, axes = np.linalg.eigh(gram / GRID**2 * weight * weight[:, None])
    axes = np.rint(axes[:, ::-1][:, :dimensions] * weight[:, None] * GRID)
    found = [places(x[a : a + BLOCK_DOCS], axes) for a in range(0, len(x), BLOCK_DOCS)]
    return Voters(axes, np.concatenate(found), labels.astype(np.float64))


def vote(x: np.ndarray, voters: Voters, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of the rows of `x`, from exact cosines to all labelled rows; ties with the last neighbour all vote."""
    if not len(voters.labels):
        return np.full(len(x), UNKNOWN)
    out = np.empty(len(x))
    k = min(neighbours, len(voters.labels))
    for a in range(0, len(x), BLOCK_DOCS):
        cos = places(x[a : a + BLOCK_DOCS], voters.axes) @ voters.vectors.T
        least = np.partition(cos, len(voters.labels) - k, axis=1)[:, -k][:, None]
        w = np.where((cos >= least) & (cos > 0), cos / GRID**2, 0)
        power = 1
        while power < SHARPNESS:  # by squaring, as that rounds alike everywhere
            w, power = w * w, 2 * power
        total = w.sum(axis=1)
        out[a : a + BLOCK_DOCS] = np.where(total > 0, (w * voters.labels).sum(axis=1) / np.where(total > 0, total, 1), UNKNOWN)
    return np.clip(out, 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_LABELLED) -> Voters:
    """Voters from a bounded sample: of the labels that have a document, the `limit` whose ids hash lowest.

    Labels other than 0 and 1, null ids and ids without a document are passed over.
    """
    order = [F.xxhash64(id_column), F.col(id_column), F.col(label)]
    valid = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(id_column, label)
    some = valid.join(docs.select(id_column), id_column, "left_semi").orderBy(*order).limit(limit)
    # `limit` rows at most, so that this broadcast has a fixed bound.
    rows = docs.select(F.col(id_column), F.col(text).alias("_text")).join(F.broadcast(some), id_column)

    @F.pandas_udf("binary")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([v.tobytes() for v in vectors(list(s))], dtype="object")

    # Vectors reach the driver as bytes: 4 KB a row.
    known = rows.select(id_column, label, terms("_text").alias("x")).orderBy(*order, "x").limit(limit).collect()
    if not known:
        return Voters(np.zeros((SHAPES + WORDS, 0)), np.zeros((0, 0)), np.zeros(0))
    x = np.stack([np.frombuffer(r["x"], np.int32) for r in known])
    return fit_voters(x, np.array([r[label] for r in known]))


def score_column(docs: DataFrame, voters: Voters, text: str = "text") -> Column:
    """Score of a text column: 0 to 1, higher where neighbours have label 1. Needs no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = list(s)
            parts = [vote(vectors(texts[a : a + BLOCK_DOCS]), shared.value) for a in range(0, len(texts), BLOCK_DOCS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(F.col(text), F.lit("")))


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2. Null ids aren't."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with held_out, score and predicted.

    The score depends on the text and the labelled sample alone: equal texts
    have equal scores in any order, batch and partition. Null, empty and blank
    texts score UNKNOWN, as do all texts if nothing is labelled; texts of any
    length are read whole. No documents: no rows. Other columns stay (columns of
    these three names are replaced).
    """
    voters = learn(docs, labels.where(~held_out(id_column)), id_column, text)
    scored = docs.withColumns({"held_out": held_out(id_column), "score": score_column(docs, voters, text)})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
