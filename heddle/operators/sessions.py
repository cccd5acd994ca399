"""Sessions: listing, selection under a cursor and a budget, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.text import trimmed
from heddle.operators.skew import global_rank
from heddle.params import LIMITS, ROLES


def kept_messages(messages: DataFrame) -> DataFrame:
    """User and assistant messages with text: (session_id, n, role, text, ...)."""
    return messages.where(F.col("role").isin(*ROLES) & (trimmed(F.coalesce("text", F.lit(""))) != ""))


def session_list(messages: DataFrame, order: str = "n") -> DataFrame:
    """(session_id, message_count, first_n, last_n) of sessions with any kept message; one aggregation, combined before its shuffle."""
    kept = kept_messages(messages)
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.min(order).alias("first_n"), F.max(order).alias("last_n"))


def timed_sessions(events: DataFrame, session: str, ts: str) -> DataFrame:
    """(session_id, first_at, last_at, message_count) of events with a time."""
    return events.where(F.col(ts).isNotNull()).groupBy(F.col(session).alias("session_id")).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("message_count"))


def since(sessions: DataFrame, at: str | None) -> DataFrame:
    """Sessions whose last message is strictly later."""
    return sessions if at is None else sessions.where(F.col("last_at") > F.lit(at).cast("timestamp"))


def not_live(sessions: DataFrame, now: Column, minutes: int = LIMITS.live_minutes) -> DataFrame:
    """Sessions that nothing was written to in the last minutes before `now` (always given, never the clock)."""
    return sessions.where(F.col("last_at") <= now - F.expr(f"interval {minutes} minutes"))


def with_status(messages: DataFrame, machine_opening: str, least: int = LIMITS.trivial_messages) -> DataFrame:
    """session_list with status: "skipped-trivial" with few messages or a machine-made opening, else "open"."""
    kept = kept_messages(messages)
    opening = F.min_by("text", F.when(F.col("role") == "user", F.col("n"))).alias("opening")
    listed = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), opening)
    trivial = (F.col("message_count") < least) | F.coalesce(F.col("opening").rlike(machine_opening), F.lit(False))
    return listed.select("session_id", "message_count", F.when(trivial, "skipped-trivial").otherwise("open").alias("status"))


def within_budget(sessions: DataFrame, order: list[str], sessions_max: int = LIMITS.run_sessions, messages_max: int = LIMITS.run_messages) -> DataFrame:
    """The first sessions in order that fit both budgets, with run_place and run_messages.

    A session has at least one message, so that a top-k of the smaller budget
    holds all that can fit; the running sum is over that bounded set alone.
    """
    few = sessions.orderBy(*order).limit(min(sessions_max, messages_max))
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = few.withColumns({"run_place": F.row_number().over(W.orderBy(*order)), "run_messages": F.sum("message_count").over(w)})
    return run.where((F.col("run_place") <= sessions_max) & (F.col("run_messages") <= messages_max))


def unresolved(sessions: DataFrame, cursor: DataFrame) -> DataFrame:
    """Sessions that the cursor (session_id, at) lacks, or that have grown since it saw them."""
    seen = cursor.select(F.col("session_id").alias("_id"), "at")
    return sessions.join(seen, (F.col("session_id") == F.col("_id")) & (F.col("last_at") <= F.col("at")), "left_anti")


def high_water(sessions: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: the latest last_at of resolved sessions that lies strictly before every unresolved one."""
    marked = sessions.join(resolved.select("session_id").distinct().withColumn("done", F.lit(True)), "session_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    first_open = marked.where(~F.col("done")).agg(F.min("last_at")).first()[0]
    below = F.col("done") if first_open is None else F.col("done") & (F.col("last_at") < F.lit(first_open))
    return marked.where(below).agg(F.max("last_at").alias("high_water"), F.count(F.lit(1)).alias("n_resolved"))


def ordered_messages(messages: DataFrame) -> DataFrame:
    """Kept messages with place (from 1) and window_no within their session; equal orders keep file order."""
    w = W.partitionBy("session_id").orderBy("n", "role", "text")
    return kept_messages(messages).withColumn("place", F.row_number().over(w))


def windows(messages: DataFrame, size: int = LIMITS.window_messages) -> DataFrame:
    """Count-based tumbling windows of each session's messages."""
    return ordered_messages(messages).withColumn("window_no", F.floor((F.col("place") - 1) / size).cast("long"))


def window_tails(messages: DataFrame, size: int = LIMITS.window_messages, tail: int = LIMITS.tail_messages) -> DataFrame:
    """(session_id, window_no, n_recent, n_tail, tail): each window with the compact messages just before it.

    A message belongs to the tail of each window that starts at most `tail`
    places after it: a bounded expansion and one aggregation instead of a frame
    per window.
    """
    placed = windows(messages, size)
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 40))
    last = F.max("place").over(W.partitionBy("session_id"))
    first_next = F.floor((F.col("place") - 1) / size) + 1
    final = F.floor((F.col("place") - 1 + tail) / size)
    later = F.when(final >= first_next, F.sequence(first_next, final)).otherwise(F.array().cast("array<bigint>"))
    each = placed.withColumn("last", last).select("session_id", "place", "last", line.alias("line"), F.explode(F.concat(F.array(F.struct(F.col("window_no").alias("no"), F.lit(False).alias("earlier"))), F.transform(later, lambda k: F.struct(k.alias("no"), F.lit(True).alias("earlier"))))).alias("w"))
    each = each.where(F.col("w.no") * size < F.col("last"))
    recent = F.count_if(~F.col("w.earlier")).alias("n_recent")
    earlier = F.array_sort(F.collect_list(F.when(F.col("w.earlier"), F.struct("place", "line"))))
    grouped = each.groupBy("session_id", F.col("w.no").alias("window_no")).agg(recent, earlier.alias("t"))
    return grouped.select("session_id", "window_no", "n_recent", F.size("t").cast("long").alias("n_tail"), F.array_join(F.transform("t", lambda x: x["line"]), " / ").alias("tail"))


def transcript(messages: DataFrame) -> DataFrame:
    """(session_id, transcript): speaker-labelled lines in order, one row per session at the sink."""
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))))
    return ordered_messages(messages).groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def collection_report(statuses: DataFrame) -> DataFrame:
    """One row of counts: found, skipped, taken and left for the next run."""
    s = F.col("status")
    return statuses.agg(F.count(F.lit(1)).alias("found"), F.count_if(s == "skipped-trivial").alias("skipped_trivial"), F.count_if(s == "processed").alias("processed"), F.count_if(s == "open").alias("deferred"), F.coalesce(F.sum(F.when(s == "processed", F.col("message_count"))), F.lit(0)).alias("messages"))


def by_id(sessions: DataFrame, session_id) -> DataFrame:
    """The session with an id, at most one row; of several the first by path, then by last_at."""
    order = [c for c in ("path", "last_at", "last_n") if c in sessions.columns]
    return sessions.where(F.col("session_id") == F.lit(session_id)).orderBy(*order).limit(1)


def most_recent(sessions: DataFrame, n: int = LIMITS.run_sessions) -> DataFrame:
    """What a first run takes: the latest sessions, before a backfill goes through the rest."""
    return sessions.orderBy(F.desc("last_at"), "session_id").limit(n)


def listing(sessions: DataFrame) -> DataFrame:
    """(place, json): the sessions as documents, oldest first by last_at; only the sink's text is built here."""
    named = {"session_id": "id", "first_at": "firstMessageAt", "last_at": "lastMessageAt", "message_count": "messageCount"}
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if c in ("first_at", "last_at") else F.col(c)
    doc = F.to_json(F.struct(*[iso(c).alias(named.get(c, c)) for c in sessions.columns]))
    return global_rank(sessions.select("last_at", "session_id", doc.alias("json")), [F.col("last_at"), F.col("session_id")], "place").select("place", "json")
