"""Audits of refactoring plans against what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.skew import global_rank
from heddle.plans.storage import materialize, shared_path

#: Plans run from moves to extractions.
PATTERN_ORDER = ("pure move", "unit move", "block extraction")


def commit_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(message, n_expected, n_actual, verdict) of expected and actual commit messages, each wanted exactly once."""
    e = expected.groupBy("message").agg(F.count(F.lit(1)).alias("n_expected"))
    a = actual.groupBy("message").agg(F.count(F.lit(1)).alias("n_actual"))
    both = e.join(a, "message", "full_outer").select("message", F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_actual", F.lit(0)).alias("n_actual"))
    verdict = F.when(F.col("n_actual") == 0, "missing").when(F.col("n_expected") == 0, "unexpected").when(F.col("n_actual") > F.col("n_expected"), "repeated").otherwise("ok")
    return both.withColumn("verdict", verdict)


def uncovered(decls: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """(target, symbol, side): declarations that the symbol map lacks, and mapped symbols that aren't declared."""
    d = decls.select("target", "symbol").distinct()
    m = symbol_map.select("target", "symbol").distinct()
    keys = ["target", "symbol"]
    return d.join(m, keys, "left_anti").withColumn("side", F.lit("unmapped")).unionByName(m.join(d, keys, "left_anti").withColumn("side", F.lit("undeclared")))


def compat_exports(symbol_map: DataFrame, import_edges: DataFrame) -> DataFrame:
    """Moved, exported symbols that another file imports by name: these need a compatibility re-export."""
    moved = symbol_map.where("exported and destination <> target")
    used = import_edges.where("src_file <> target_file").select(F.col("target_file").alias("target"), F.col("name").alias("symbol"))
    return moved.join(used, ["target", "symbol"], "left_semi")


def leftovers(symbol_map: DataFrame, decls_after: DataFrame) -> DataFrame:
    """Moved symbols that their source still declares; empty after a clean move."""
    return symbol_map.where("destination <> target").join(decls_after.select("target", "symbol"), ["target", "symbol"], "left_semi")


def leftover_mentions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol, path, n): how often files (path, text) still name a symbol as a whole word.

    Files are cut into words once and joined on them, instead of one search per
    symbol and file.
    """
    words = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("symbol"))
    return words.join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol", "path").agg(F.count(F.lit(1)).alias("n"))


def step_tally(steps: DataFrame, moves: DataFrame) -> DataFrame:
    """(plan, step, stated, moved, ok): symbols that a step moved against the number that it states."""
    n = moves.groupBy("plan", "step").agg(F.count(F.lit(1)).alias("moved"))
    out = steps.join(n, ["plan", "step"], "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
    return out.withColumn("ok", F.col("moved") == F.col("stated"))


def duplicated_symbols(decls: DataFrame) -> DataFrame:
    """(symbol, n_files) of names that at least two files declare."""
    return decls.groupBy("symbol").agg(F.countDistinct("file").alias("n_files")).where("n_files > 1")


def plan_order(plans: DataFrame) -> DataFrame:
    """(plan, pattern, difficulty) with place: by pattern, the easiest first, then by name; unknown patterns last."""
    kind = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PATTERN_ORDER)), F.col("pattern")), F.lit(0)), F.lit(len(PATTERN_ORDER) + 1))
    return global_rank(plans.withColumn("_kind", kind), [F.col("_kind"), F.col("difficulty"), F.col("plan")], "place").drop("_kind")


def plan_levels(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """(id, level) in dependency order: level 0 depends on nothing, others on a lower level only.

    One round per level: nodes whose dependencies (id, needs) all have a level
    get the next one, until a round finds none. Nodes on a cycle, or behind one,
    and those that need an unknown node's level get none.
    """
    spark, path = nodes.sparkSession, shared_path(nodes.sparkSession, "plan-levels")
    every = materialize(nodes.select("id").where("id is not null").distinct(), "plan-nodes")
    edges = materialize(depends.select("id", "needs").where("id is not null and needs is not null").distinct().join(every.withColumnRenamed("id", "needs"), "needs", "left_semi"), "plan-edges")
    done = spark.createDataFrame([], every.withColumn("level", F.lit(0)).schema)
    found, level = True, 0
    while found:
        waits = edges.join(done.select(F.col("id").alias("needs")), "needs", "left_anti").select("id")
        ready = every.join(done.select("id"), "id", "left_anti").join(waits, "id", "left_anti")
        # Levels share one folder, so that the plan doesn't grow with their number.
        ready.withColumn("level", F.lit(level)).write.mode("append").parquet(path)
        done = spark.read.schema(done.schema).parquet(path)
        found = not done.where(F.col("level") == level).isEmpty()
        level += 1
    return done
