"""Whole runs: collecting from sessions, and tending a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators import duplicates, hygiene, judge, sessions, store
from heddle.params import LIMITS, Limits
from heddle.plans.storage import materialize


def collect(listed: DataFrame, messages: DataFrame, cursor: DataFrame, machine: str, collected: str, machine_opening: str = "^$", by: judge.Judge | None = None, limits: Limits = LIMITS) -> dict[str, DataFrame]:
    """One collection run over sessions (tool, session_id, last_at) and messages (session_id, n, role, text).

    Sessions that the cursor lacks are selected oldest first within the budget,
    trivial ones resolved without reading, the others cut into windows and
    judged. Returns the records to append, the new cursor and the report; the
    caller writes them in this order, so that a run that breaks off is repeated.
    """
    by = by or judge.RuleJudge()
    fresh = sessions.unresolved(listed, cursor)
    status = sessions.with_status(messages.join(fresh.select("session_id"), "session_id", "left_semi"), machine_opening, limits.trivial_messages)
    status = materialize(status.join(fresh.select("tool", "session_id", "last_at"), "session_id"), "run-status")
    taken = sessions.within_budget(status.where("status = 'open'"), ["last_at", "session_id"], limits.run_sessions, limits.run_messages)
    taken = materialize(taken.select("session_id", "tool", "last_at", "message_count"), "run-taken")
    windows = sessions.windows(messages.join(taken.select("session_id"), "session_id", "left_semi"), limits.window_messages)
    texts = windows.groupBy("session_id", "window_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    found = by.topics(texts)
    kept = found.where("confidence >= 3").join(judge.violations(found, judge.topic_rules()).select("session_id", "window_no"), ["session_id", "window_no"], "left_anti")
    records = kept.join(taken, "session_id").withColumn("tags", store.tags(F.col("tool"), machine, F.col("session_id"), collected))
    skipped = status.where("status = 'skipped-trivial'").select("tool", "session_id", "status", F.col("last_at").alias("at"))
    done = taken.select("tool", "session_id", F.lit("processed").alias("status"), F.col("last_at").alias("at"))
    outcome = status.join(done.select("session_id", F.col("status").alias("now")), "session_id", "left").withColumn("status", F.coalesce("now", "status"))
    return {"records": records.select("session_id", "window_no", "name", "category", "tags"), "cursor": store.advanced(cursor, skipped.unionByName(done)), "report": sessions.collection_report(outcome)}


def tend(items: DataFrame, protected: DataFrame, facts: DataFrame, links: DataFrame, as_of: str, autonomous: bool = False, limits: Limits = LIMITS) -> dict[str, DataFrame]:
    """One hygiene run over items (id, text, touched), facts and links.

    Each phase proposes mutations; the budget takes the first of them over all
    phases. Removals follow the mode: proposed, or executed where certain.
    Returns mutations, removals and the report, which is never skipped.
    """
    grouped = materialize(duplicates.clusters(items, "id", "text", limits.duplicate_similarity), "tend-clusters")
    mutation = lambda df, phase, op, target, other, priority: df.select(F.lit(phase).alias("phase"), F.lit(op).alias("op"), target.cast("long").alias("target_id"), other.cast("long").alias("replaced_by"), priority.cast("double").alias("priority"))
    none = F.lit(None)
    merges = mutation(grouped.where("id <> cluster_id"), 1, "merge", F.col("id"), F.col("cluster_id"), F.lit(1))
    old = items.where(F.col("touched") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {limits.stale_days} days")).join(protected.select("id"), "id", "left_anti")
    decays = mutation(old, 2, "decay", F.col("id"), none, F.lit(0))
    splits = mutation(hygiene.bloated(items, "id", "text", limits.bloat_chars, limits.run_splits), 3, "split", F.col("id"), none, F.col("n_chars"))
    gone = mutation(hygiene.superseded(facts).where("superseded and not conflict"), 4, "invalidate", F.col("fact_id"), none, F.lit(0))
    alone = mutation(hygiene.orphans(items.select("id"), links).orderBy("id").limit(limits.run_reconnects), 5, "reconnect", F.col("id"), none, F.lit(0))
    done = materialize(hygiene.budgeted([merges, decays, splits, gone, alone], limits.run_mutations), "tend-mutations")
    removals = hygiene.routed(done.where("op = 'merge'").withColumn("certain", F.lit(True)), autonomous)
    return {"mutations": done, "removals": removals, "report": hygiene.report(done, limits.run_mutations)}
