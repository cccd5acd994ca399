"""Exact and near duplicates of items, by a lossless prefix filter on word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.components import connected_components
from heddle.operators.skew import lookup_join
from heddle.params import LIMITS
from heddle.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5


def exact_groups(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(text_md5, n, canonical_id) of texts that several items have; copies are counted, not expanded into pairs."""
    return items.groupBy(F.md5(text).alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("canonical_id")).where("n > 1 and text_md5 is not null")


def shingles(words: str, width: int = SHINGLE_WORDS) -> Column:
    """Distinct shingles of a column of words; fewer words: all of them as one; none: empty.

    It takes a column and no expression, which the lambda would evaluate anew for each shingle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(width - 1), F.lit(1)))
    each = F.transform(starts, lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(F.size(words) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def representatives(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(rep, n_copies, tokens): one row per different text, under its smallest id, with hashed shingles."""
    reps = items.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(id_column).alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    words = reps.select("rep", "n_copies", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    # Written once: inlined into later steps, the words would be cut anew for each shingle.
    return materialize(words.select("rep", "n_copies", F.transform(shingles("words"), lambda s: F.xxhash64(s)).alias("tokens")), "near-reps")


def near_pairs(reps: DataFrame, threshold: float = LIMITS.duplicate_similarity) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: all pairs of different texts whose shingles' Jaccard similarity reaches the threshold.

    In one global order by rarity, two sets that reach the threshold share a
    token among the first n - ceil(threshold * n) + 1 of each. Only these are
    joined, sizes bound the partners, and the candidates are verified exactly.
    Texts without words have no pairs.
    """
    sets = reps.where(F.size("tokens") > 0).select(F.col("rep").alias("id"), F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    # Tokens of one text alone come first in its order and are shared with none, so their number is enough.
    counts = sets.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = lookup_join(sets, counts, "token").where("n is not null").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    ordered = materialize(ordered, "near-sets")
    need = F.greatest(F.lit(0), F.size("t") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1)
    prefix = ordered.select("id", "size", F.explode(F.slice("t", F.lit(1), need.cast("int"))).alias("x")).select("id", "size", F.col("x.token").alias("token"))
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = F.col("a.size") * threshold <= F.col("b.size") + 1e-9
    fits = fits & (F.col("b.size") * threshold <= F.col("a.size") + 1e-9)
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & fits)
    pairs = met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    own = ordered.select("id", "size", F.transform("t", lambda x: x["token"]).alias("s"))
    both = pairs.join(own.toDF("id_a", "size_a", "s_a"), "id_a").join(own.toDF("id_b", "size_b", "s_b"), "id_b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.withColumn("similarity", shared / (F.col("size_a") + F.col("size_b") - shared)).where(F.col("similarity") >= threshold - 1e-12).select("id_a", "id_b", "similarity")


def clusters(items: DataFrame, id_column: str, text: str, threshold: float = LIMITS.duplicate_similarity) -> DataFrame:
    """(id, cluster_id, n_links): every item with the smallest id of its component and the number of different texts that its own is linked to.

    Copies of a text belong to its class and aren't expanded into pairs. Items
    with a null text are alone.
    """
    reps = representatives(items, id_column, text)
    pairs = materialize(near_pairs(reps, threshold), "near-pairs")
    groups = connected_components(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    links = pairs.select(F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_text = items.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("h")).agg(F.min(id_column).alias("rep"))
    named = of_text.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    named = named.select("h", F.coalesce("component", "rep").alias("cluster_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    all_items = items.select(F.col(id_column).alias("id"), F.md5(text).alias("h"))
    out = lookup_join(all_items, named, "h")
    return out.select("id", F.coalesce("cluster_id", "id").alias("cluster_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def newcomers(pairs: DataFrame, created_after: Column) -> DataFrame:
    """(newcomer_id, n_matches, established_id, route) of pairs with exactly one newcomer: a single match goes to the gate, more to the cluster judge.

    `created_after` is a condition on a column `id`.
    """
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("new", created_after)
    a = ids.toDF("id_a", "new_a")
    b = ids.toDF("id_b", "new_b")
    mixed = pairs.join(a, "id_a").join(b, "id_b").where(F.col("new_a") != F.col("new_b"))
    sides = mixed.select(F.when(F.col("new_a"), F.col("id_a")).otherwise(F.col("id_b")).alias("newcomer_id"), F.when(F.col("new_a"), F.col("id_b")).otherwise(F.col("id_a")).alias("e"))
    grouped = sides.groupBy("newcomer_id").agg(F.count(F.lit(1)).alias("n_matches"), F.min("e").alias("established_id"))
    return grouped.withColumn("route", F.when(F.col("n_matches") == 1, "gate").otherwise("cluster"))
