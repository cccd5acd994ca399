"""Rules that keep a store of records healthy: merging, decay, bloat, supersession, orphans, proposals, reports.

Every rule returns a DataFrame; those that change something return mutations
(phase, op, target_id, replaced_by, priority), which the budget then caps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.operators.skew import lookup_join
from heddle.operators.store import beside
from heddle.params import LIMITS


def merged(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One record per cluster of (exposure, strength, sentiment, category, at, detail, name).

    Exposure and strength take the highest, sentiment the average, category the
    commonest (ties: the newest, then the name), the name the commonest (ties:
    the longest, then the first), details are the union: each different one,
    sorted, none lost. All are aggregations: categories, names and details are
    made single first, so that only what a record holds is gathered.
    """
    kinds = members.groupBy(cluster, "category").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("newest"))
    best = kinds.where(F.col("category").isNotNull()).groupBy(cluster).agg(F.min_by("category", F.struct(-F.col("n"), -F.unix_micros(F.col("newest").cast("timestamp")), F.col("category"))).alias("category"))
    called = members.where("name is not null").groupBy(cluster, "name").agg(F.count(F.lit(1)).alias("n"))
    name = called.groupBy(cluster).agg(F.min_by("name", F.struct(-F.col("n"), -F.char_length("name"), F.col("name"))).alias("name"))
    numbers = members.groupBy(cluster).agg(F.max("exposure").alias("exposure"), F.max("strength").alias("strength"), F.round(F.avg("sentiment"), 6).alias("sentiment"), F.count(F.lit(1)).alias("n_merged"))
    details = members.select(cluster, "detail").distinct().groupBy(cluster).agg(F.count("detail").alias("n_details"), F.array_sort(F.collect_list("detail")).alias("details"))
    return numbers.join(best, cluster, "left").join(name, cluster, "left").join(details, cluster, "left")


def canonical(members: DataFrame, references: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, canonical_id, n): the most referenced member, then the oldest, then the smallest id. `references` has (id, refs) once per id."""
    counted = lookup_join(members, references, "id").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return counted.groupBy(cluster).agg(F.min_by("id", F.struct(-F.col("refs"), F.col("created"), F.col("id"))).alias("canonical_id"), F.count(F.lit(1)).alias("n"))


def identifier_union(identifiers: DataFrame, owner: str) -> DataFrame:
    """(owner, type, value, is_primary): identifiers once per value, exactly one of them primary.

    Of several primaries, or of none, the smallest (type, value) is primary.
    """
    once = identifiers.groupBy(owner, "value").agg(F.min("type").alias("type"), F.max("is_primary").alias("p"))
    w = W.partitionBy(owner).orderBy(F.desc("p"), "type", "value")
    return once.withColumn("is_primary", F.row_number().over(w) == 1).select(owner, "type", "value", "is_primary")


def touched_since(items: DataFrame, last_run: str | None, first_run: int = LIMITS.first_run_items) -> DataFrame:
    """Items (id, updated) that a run looks at: those updated since the last one, or on a first run the latest few."""
    if last_run is None:
        return items.orderBy(F.desc("updated"), "id").limit(first_run)
    return items.where(F.col("updated") > F.lit(last_run).cast("timestamp"))


def stale(items: DataFrame, as_of: Column, days: int = LIMITS.stale_days) -> DataFrame:
    """Items (id, mentioned, retrieved, updated, protected) untouched for `days` before `as_of`."""
    return items.where(F.greatest("mentioned", "retrieved", "updated") < as_of - F.expr(f"interval {days} days"))


def decayed(items: DataFrame, value: str, protected: str, notch: float = LIMITS.decay_notch, floor: float = LIMITS.decay_floor) -> DataFrame:
    """`items` that aren't protected with `value` one notch lower, not below the floor."""
    return items.where(~F.coalesce(F.col(protected), F.lit(False))).withColumn(value, F.round(F.greatest(F.lit(floor), F.col(value) - notch), 6))


def expiring(items: DataFrame, trivia: str, as_of: Column, days: int = LIMITS.stale_days) -> DataFrame:
    """Of stale items those of trivia grade (a boolean column), with the time at which they expire; they are never deleted."""
    return items.where(F.coalesce(F.col(trivia), F.lit(False))).withColumn("expires_at", as_of + F.expr(f"interval {days} days"))


def bloated(items: DataFrame, id_column: str, text: str, chars: int = LIMITS.bloat_chars, splits: int = LIMITS.run_splits) -> DataFrame:
    """The longest items over the line, with their place; ties to the smaller id. A top-k, so nothing else is sorted."""
    n = F.char_length(text)
    top = items.where(n > chars).select(F.col(id_column).alias("id"), n.cast("long").alias("n_chars")).orderBy(F.desc("n_chars"), "id").limit(splits)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n_chars"), "id")))


def superseded(facts: DataFrame) -> DataFrame:
    """Facts (fact_id, subject, predicate, object, at) with superseded and conflict.

    A fact is superseded if any strictly later fact of the same subject and
    predicate has another object. Different objects at the same time are a
    conflict: proposed, never invalidated. Null objects neither replace nor are
    replaced. Aggregations decide it: a later other object exists if the latest
    object, or for that object the latest of all others, is later.
    """
    own = facts.withColumns({"_key": F.to_json(F.struct("subject", "predicate"), {"ignoreNullFields": "false"}), "_at": F.unix_micros(F.col("at").cast("timestamp"))})
    last = own.where("object is not null").groupBy("_key", "object").agg(F.max("_at").alias("last"))
    first = last.groupBy("_key").agg(F.max(F.struct("last", "object")).alias("first"))
    second = lookup_join(last, first, "_key").where(F.col("object") != F.col("first.object")).groupBy("_key").agg(F.max("last").alias("second"))
    marked = lookup_join(lookup_join(own, first, "_key"), second, "_key")
    later = F.when(F.col("object") == F.col("first.object"), F.col("second")).otherwise(F.col("first.last"))
    moment = F.concat_ws("@", "_key", F.coalesce(F.col("_at").cast("string"), F.lit("")))
    same = own.where("object is not null").groupBy(moment.alias("_moment")).agg(F.min("object").alias("_least"), F.max("object").alias("_most")).where("_least <> _most").select("_moment", F.lit(True).alias("_differ"))
    out = lookup_join(marked.withColumn("_moment", moment), same, "_moment")
    flags = [F.coalesce(F.col("_at") < later, F.lit(False)).alias("superseded"), (F.col("object").isNotNull() & F.coalesce("_differ", F.lit(False))).alias("conflict")]
    return out.select(*[F.col(f"`{c}`") for c in facts.columns], *flags)


def timeline(facts: DataFrame) -> DataFrame:
    """Facts with the time from which another object holds, null if it still holds."""
    w = W.partitionBy("subject", "predicate").orderBy("at", "fact_id")
    change = F.when(F.lead("object").over(w) != F.col("object"), F.lead("at").over(w))
    return facts.withColumn("valid_until", change).withColumn("step", F.row_number().over(w))


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes (id) at neither end of any link (src, dst)."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    return nodes.join(ends, "id", "left_anti")


def cleared_proposals(proposals: DataFrame, autonomous: bool) -> DataFrame:
    """Proposals (report_id, target_id, approved, executed) that may run now: approved ones, or in autonomous mode all, that haven't run."""
    open_ones = proposals.where(~F.coalesce("executed", F.lit(False)))
    return open_ones if autonomous else open_ones.where(F.coalesce("approved", F.lit(False)))


def budgeted(mutations: list[DataFrame], limit: int = LIMITS.run_mutations) -> DataFrame:
    """The first mutations by (phase, priority, target_id) that the run's budget allows, numbered: one capped top-k over all phases."""
    every = reduce(DataFrame.unionByName, mutations)
    order = ["phase", F.desc("priority"), "target_id", "op"]
    return every.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*order)))


def routed(removals: DataFrame, autonomous: bool) -> DataFrame:
    """Removals with where they go: the proposal queue, or execution if they're certain and the mode allows it."""
    where = F.when(~F.col("certain"), F.lit("deferred" if autonomous else "proposed")).otherwise(F.lit("executed" if autonomous else "proposed"))
    return removals.withColumn("outcome", where)


def report(done: DataFrame, limit: int = LIMITS.run_mutations) -> DataFrame:
    """The one-row report of a run, with zeros if nothing was done: counts by operation, budget used, resume point."""
    op = F.col("op")
    counts = {f"n_{name}": F.count_if(op == name) for name in ("merge", "decay", "split", "invalidate", "reconnect")}
    last = F.max_by("target_id", "place")
    return done.agg(*[v.alias(k) for k, v in counts.items()], F.count(F.lit(1)).alias("used"), F.coalesce(F.when(F.count(F.lit(1)) >= limit, last.cast("string")), F.lit("clean")).alias("resume_point"))


def store_stats(items: DataFrame, store: str, removed: DataFrame) -> DataFrame:
    """(store, n_before, n_after): counts before and after removing the ids of `removed`."""
    gone = removed.select(F.col("target_id").alias("id")).distinct().withColumn("gone", F.lit(1))
    marked = lookup_join(items.select("id", store), gone, "id")
    return marked.groupBy(store).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(F.col("gone").isNull()).alias("n_after"))


def full_report(done: DataFrame, removals: DataFrame, phases: DataFrame, limit: int = LIMITS.run_mutations) -> DataFrame:
    """`report` with the removals that are proposed, executed and deferred (outcome), and the phases that were skipped for want of a capability (phase, runs, missing)."""
    outcome = lambda name: F.count_if(F.col("outcome") == name).alias(f"n_{name}")
    skipped = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("runs"), F.concat("phase", F.lit(": "), "missing")))), "; ")
    return beside(beside(report(done, limit), removals.agg(*map(outcome, ("proposed", "executed", "deferred")))), phases.agg(skipped.alias("skipped")))
