"""Connected components by randomized contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.skew import lookup_join
from heddle.plans.storage import drop_tables, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected graph: (node, component), component being the smallest node id reachable.

    Each round orders the nodes by a fresh hash, lets every node choose the first
    node of its closed neighbourhood and contracts the edges to the chosen nodes;
    at least a quarter of the nodes are expected to vanish per round, so a chain
    of n nodes also takes O(log n) rounds. Everything is an aggregation or an
    equi-join; rows of hub nodes are joined by a bounded broadcast. Edges with a
    null end are no edges; self-loops give a component of one node; repeated
    edges count once. No edges: no rows.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = materialize(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    now = materialize(both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    levels: list[DataFrame] = []
    k = 0
    while not now.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)), F.col(c))
        ways = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = ways.groupBy("u").agg(F.min(rank("v")).alias("b"))
        chosen = best.select("u", F.when(F.col("b") < rank("u"), F.col("b.v")).otherwise(F.col("u")).alias("to"))
        chosen = materialize(chosen, "cc-chosen")
        a = lookup_join(now, chosen.withColumnRenamed("to", "ru"), "u")
        b = lookup_join(a, chosen.select(F.col("u").alias("v"), F.col("to").alias("rv")), "v")
        nxt = materialize(b.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "cc-edges")
        drop_tables(now)
        now = nxt
        levels.append(chosen)
        k += 1
    if not levels:
        return nodes.select("node", F.col("node").alias("component"))
    end = levels.pop()
    while levels:
        step = lookup_join(levels.pop(), end.select(F.col("u").alias("to"), F.col("to").alias("nx")), "to")
        end = materialize(step.select("u", F.coalesce("nx", "to").alias("to")), "cc-found")
    found = nodes.join(end, nodes.node == end.u, "left").select("node", F.coalesce("to", "node").alias("to"))
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return lookup_join(materialize(found, "cc-nodes"), least, "to").select("node", "component")
