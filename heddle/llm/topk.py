"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.plans.storage import materialize, shared_path

K = 10
SCALE = 1024
#: The lists: a vector's score is the sum of its scores in so many blocks of components.
LISTS = 4
#: Queries that are broadcast and answered together: a fixed bound on what is broadcast.
BLOCK_QUERIES = 4_096
#: Rows of a slice and queries that are multiplied at once.
BLOCK_ROWS, BLOCK_COLS = 2_048, 512
#: Share of a block's entries above which a query's list is summed for all of them at once.
DENSE_SHARE = 0.1
#: Times k: entries of the first list whose totals a slice looks at for the cutoff.
GATHERED = 4
#: Products of integers are exact in doubles below this.
EXACT = float(1 << 53)


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, id, v): floor(scale * x) of each component x as a double. Vectors that are null, or hold null or non-finite components, are left out."""
    x = F.col(vector)
    ok = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return df.where(ok).select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), v.alias("v"))


def _matrix(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of the lengths `sizes`, cut or padded by zeros to `width`."""
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out[:, :width]


def _kind(v: np.ndarray, q: np.ndarray) -> type:
    """Doubles where all sums of products are exact in them, else whole numbers of any size."""
    top = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
    return np.float64 if top < EXACT else object


def _cuts(width: int) -> list[tuple[int, int]]:
    at = np.linspace(0, width, LISTS + 1).astype(int).tolist()
    return list(zip(at, at[1:]))


def _slices(batches: Iterator[pa.RecordBatch], queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, vectors) of blocks of a partition."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            v = part.column(2)
            v = _matrix(v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False), queries.shape[1])
            yield *(part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), v


def local_best(v: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: totals (entries x queries) of the best entries of each query's first list; `own` marks the query's own row. -inf: no entry."""
    kind = _kind(v, q)
    a, b = _cuts(v.shape[1])[0]
    first = (v[:, a:b].astype(kind) @ q[:, a:b].astype(kind).T).astype(np.float64)
    first[own] = -np.inf
    k = min(GATHERED * k, len(v))
    rows = np.argpartition(first, len(v) - k, axis=0)[-k:]
    total = np.stack([(v[r].astype(kind) * q.astype(kind)).sum(axis=1).astype(np.float64) for r in rows])
    total[np.take_along_axis(own, rows, axis=0)] = -np.inf
    return total


def sufficient_entries(v: np.ndarray, q: np.ndarray, own: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (row, query, score) of all pairs that reach their query's cutoff, and the number of list products that it took.

    A total that reaches the cutoff has a list that reaches cutoff / LISTS, and
    what lists aren't summed yet adds the product of its lengths at most. Lists
    are taken one by one: a pair whose sum cannot reach the cutoff, or none of
    whose lists can reach its part, is dropped, and the rest are resolved.
    """
    kind = _kind(v, q)
    parts = _cuts(v.shape[1])
    cut = np.where(np.isfinite(cut), cut - np.abs(cut) * 1e-12 - 1, cut)[None, :]  # scores are whole numbers, and lengths are rounded
    part = cut / LISTS
    length = lambda m, a, b: np.sqrt((m[:, a:b].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    total = np.zeros((len(v), len(q)), kind)
    alive, entered, products = ~own, np.zeros(own.shape, bool), 0
    for n, (a, b) in enumerate(parts):
        many = alive.mean(axis=0) > DENSE_SHARE
        d = np.flatnonzero(many)
        one = v[:, a:b].astype(kind) @ q[d, a:b].astype(kind).T
        total[:, d] += one
        entered[:, d] |= one.astype(np.float64) >= part[:, d]
        r, j = np.nonzero(alive & ~many)
        one = (v[r, a:b].astype(kind) * q[j, a:b].astype(kind)).sum(axis=1)
        total[r, j] += one
        entered[r, j] |= one.astype(np.float64) >= part[0, j]
        products += len(v) * len(d) + len(r)
        rest = length(v, b, None)[:, None] * length(q, b, None)[None, :]
        alive &= total.astype(np.float64) + rest >= cut
        later = [length(v, *p)[:, None] * length(q, *p)[None, :] >= part for p in parts[n + 1 :]]
        alive &= np.logical_or.reduce([entered, *later])
    r, j = np.nonzero(alive)
    return r, j, total[r, j], products


def _cutoffs(vectors: DataFrame, q_rows: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Phases 1 and 2a: a score that the k-th best of each query is known to reach; -inf with fewer than k candidates.

    Each partition gathers, for every query, the best entries of its local
    lists and sends the k highest totals among them. The k-th highest of what all
    send is reached by k vectors, so it is a safe cutoff.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((q_rows, q))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q = shared.value
        best = np.full((len(q), k), -np.inf)
        for rows, _, v in _slices(batches, q):
            for c in range(0, len(q), BLOCK_COLS):
                own = rows[:, None] == q_rows[None, c : c + BLOCK_COLS]
                both = np.concatenate([best[c : c + BLOCK_COLS].T, local_best(v, q[c : c + BLOCK_COLS], own, k)])
                best[c : c + BLOCK_COLS] = np.partition(both, len(both) - k, axis=0)[-k:].T
        at = np.flatnonzero(np.isfinite(best).any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([b[np.isfinite(b)] for b in best[at]])], names=["q", "best"])

    sent = vectors.mapInArrow(gather, "q long, best array<double>").select("q", F.explode("best").alias("cut"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("cut")))
    # BLOCK_QUERIES rows reach the driver at most.
    cuts = sent.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("q", "cut").toPandas()
    out = np.full(len(q), -np.inf)
    out[cuts["q"].to_numpy(np.int64)] = cuts["cut"].to_numpy(np.float64)
    return out


def _sufficient(vectors: DataFrame, q_rows: np.ndarray, q: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """Phases 2 and 3: (q, id, row, score) of every vector that reaches its query's cutoff, with its exact score."""
    shared = vectors.sparkSession.sparkContext.broadcast((q_rows, q, cuts))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q, cuts = shared.value
        for rows, ids, v in _slices(batches, q):
            for c in range(0, len(q), BLOCK_COLS):
                own = rows[:, None] == q_rows[None, c : c + BLOCK_COLS]
                r, j, score, _ = sufficient_entries(v, q[c : c + BLOCK_COLS], own, cuts[c : c + BLOCK_COLS])
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(j + c), pa.array(ids[r]), pa.array(rows[r]), pa.array([int(x) for x in score], pa.int64())], names=["q", "id", "row", "score"])

    return vectors.mapInArrow(collect, "q long, id long, row long, score long")


def top_k(df: DataFrame, is_query: str, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest inner products of each query row with all other rows: (query_id, rank, vec_id, score).

    `is_query` is an SQL condition on the column `id`. Ties go to the smaller id;
    with fewer than k candidates all are returned. Repeated rows are candidates
    and queries of their own. Vectors of different length meet as if the shorter
    one ended in zeros beyond the query's width. Vectors that are null, or hold
    null or non-finite components, take no part, nor do rows with a null id. A
    score that no long can hold is an error. No queries: no rows.
    """
    spark = df.sparkSession
    vectors = materialize(integer_vectors(df, id_column, vector).where("id is not null"), "topk-vectors")
    out = shared_path(spark, "topk-found")
    schema = "query_row long, query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    block: list = []

    def answer() -> None:
        sizes = np.array([len(r.v) for r in block])
        q = _matrix(np.array([x for r in block for x in r.v], np.int64), sizes, int(sizes.max()))
        q_rows = np.array([r.row for r in block], np.int64)
        found = _sufficient(vectors, q_rows, q, _cutoffs(vectors, q_rows, q, k))
        order = W.partitionBy("q").orderBy(F.desc("score"), "id", "row")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.row, r.id) for i, r in enumerate(block)], "q long, query_row long, query_id long")
        ranked.join(F.broadcast(names), "q").select("query_row", "query_id", "rank", F.col("id").alias("vec_id"), "score").write.mode("append").parquet(out)
        block.clear()

    for r in vectors.where(is_query).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_QUERIES:
            answer()
    if block:
        answer()
    return spark.read.schema(schema).parquet(out).select("query_id", "rank", "vec_id", "score")
