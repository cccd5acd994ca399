"""Joins and prefix sums that stay balanced when a few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.plans.storage import materialize

#: A key is hot with more than one row in HOT_SHARE, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 500


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Keys that hold more than 1/share of the rows (and over 20 rows): fewer than `share`, whatever the size of `df`."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.where(F.col("_n") > 20).orderBy(F.desc("_n")).limit(share).collect()
    total = df.count() if most else 0
    return [r[0] for r in most if r[1] * share > total]


def lookup_join(left: DataFrame, right: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Left join of `left` with `right`, which has each key once.

    Rows of hot keys meet their (fewer than `share`) partners by a broadcast, so
    no task gets all rows of a hot key; all other rows are joined by a shuffle.
    A null key finds nothing.
    """
    spark = left.sparkSession
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, "left")
    hot_df = spark.createDataFrame([(x,) for x in hot], left.select(key).schema)
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    flagged = left.join(F.broadcast(hot_df.withColumn("_hot", F.lit(True))), key, "left")
    few = right.join(F.broadcast(hot_df), key, "left_semi")
    a = flagged.where(is_hot).drop("_hot").join(F.broadcast(few), key, "left")
    b = flagged.where(~is_hot).drop("_hot").join(right, key, "left")
    return a.unionByName(b)


def prefix_sum(df: DataFrame, group: str, parts: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows of the same group that come before, for groups of any size.

    The order within a group is that of `order`, whose first column is a
    hexadecimal digest string (evenly distributed). The group is cut into
    `parts` ranges of that digest (a column, the same for all rows of a group;
    the square root of its row count balances both steps): the ranges' sums are
    added up first, then the rows inside each range. `group` has no nulls; null
    values count as 0.
    """
    first, rest = order[0], order[1:]
    at = (F.conv(F.substring(first, 1, 8), 16, 10).cast("long") * F.col(parts) / F.lit(2**32)).cast("long")
    cut = df.withColumn("_range", at)
    sums = cut.groupBy(group, "_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = W.partitionBy(group, "_range").orderBy(first, *rest).rowsBetween(W.unboundedPreceding, -1)
    rows = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.join(starts, (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).select(*[F.col(f"`{c}`") for c in df.columns], out)


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row numbers (from 1) over the whole table without gathering it: a range sort, and an offset for each of its partitions."""
    cut = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rank")
    sizes = sorted((r[0], r[1]) for r in cut.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    ranked = cut.join(F.broadcast(offsets), "_part")
    number = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_start")
    return ranked.withColumn(out, number.cast("long")).drop("_part", "_start")
