"""Similarity of item vectors, in blocks that meet on the executors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.plans.storage import materialize

#: Vectors in a block; a task compares two blocks.
BLOCK = 4_096
#: Rows of a block that are multiplied at once.
BLOCK_ROWS = 1_024


def _blocked(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, v, block) of the vectors, dealt out evenly whatever their ids, and the number of blocks."""
    rows = materialize(vectors.where("id is not null and v is not null").select("id", "v", F.monotonically_increasing_id().alias("_row")), "vector-rows")
    blocks = max(1, -(-rows.count() // BLOCK))
    return rows.select("id", "v", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("block")), blocks


def _unit(v: pd.Series) -> np.ndarray:
    x = np.array([list(r) for r in v], np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _compare(left: DataFrame, right: DataFrame, found: Callable[[np.ndarray, np.ndarray, np.ndarray, bool], pd.DataFrame], schema: str) -> DataFrame:
    """What `found(left ids, right ids, cosines, same block)` returns for each pair of blocks (a, b); `left` and `right` have a, b, id, v.

    A group holds two blocks, so its size is fixed; it is the pairs of blocks
    that grow with the tables.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        ids, others = b["id"].to_numpy(), _unit(b["v"])
        same = bool(pdf["a"].iloc[0] == pdf["b"].iloc[0])
        parts = [found(a["id"].to_numpy()[k : k + BLOCK_ROWS], ids, _unit(a["v"][k : k + BLOCK_ROWS]) @ others.T, same) for k in range(0, len(a), BLOCK_ROWS)]
        return pd.concat(parts)

    side = lambda df, flag: df.select("a", "b", "id", "v", F.lit(flag).alias("left"))
    return side(left, True).unionByName(side(right, False)).groupBy("a", "b").applyInPandas(compare, schema)


def _times(df: DataFrame, own: str, other: str, least, most) -> DataFrame:
    """Rows under each pair of their own block with the other side's blocks from `least` to `most`."""
    return df.withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(least, most)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, similarity): the k most similar other vectors (id, v) of each query, cosines to 6 places, ties to the smaller id.

    Null ids and vectors take no part.
    """

    def best(q_ids: np.ndarray, ids: np.ndarray, cos: np.ndarray, same: bool) -> pd.DataFrame:
        cos = np.where(q_ids[:, None] == ids[None, :], -2.0, np.round(cos, 6))
        m = min(k, cos.shape[1])
        least = np.partition(cos, cos.shape[1] - m, axis=1)[:, -m][:, None]
        i, j = np.nonzero((cos >= least) & (cos > -2))
        return pd.DataFrame({"query_id": q_ids[i], "id": ids[j], "similarity": cos[i, j]})

    (q, n_q), (v, n_v) = _blocked(queries), _blocked(vectors)
    left = _times(q, "a", "b", F.lit(0), F.lit(n_v - 1))
    right = _times(v, "b", "a", F.lit(0), F.lit(n_q - 1))
    found = _compare(left, right, best, "query_id long, id long, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, similarity) with id_a < id_b of all pairs that reach the threshold. Null ids and vectors take no part."""

    def reach(a: np.ndarray, b: np.ndarray, cos: np.ndarray, same: bool) -> pd.DataFrame:
        cos = np.round(cos, 6)
        near = (cos >= threshold) & ((a[:, None] < b[None, :]) if same else (a[:, None] != b[None, :]))
        i, j = np.nonzero(near)
        return pd.DataFrame({"id_a": np.minimum(a[i], b[j]), "id_b": np.maximum(a[i], b[j]), "similarity": cos[i, j]})

    rows, blocks = _blocked(vectors)
    left = _times(rows, "a", "b", F.col("a"), F.lit(blocks - 1))
    right = _times(rows, "b", "a", F.lit(0), F.col("b"))
    return _compare(left, right, reach, "id_a long, id_b long, similarity double")
