"""Decisions on records by rule, and what follows from them: merges, splits, people, events and facts.

Each function stands where a model would decide; its output has the form that
the contracts in `judge` ask for. Text is moved, never made up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.text import NOT_PROFILE
from heddle.operators.hygiene import canonical
from heddle.operators.skew import lookup_join
from heddle.params import LIMITS

WORD = r"[^\x20\x09-\x0D]+"
#: Two capitalized ASCII words; a name ends where no ASCII letter, digit or underscore follows. Java's \b takes letters such as ä for parts of it, SQL's doesn't.
PERSON = r"(?<![0-9A-Za-z_])[A-Z][a-z]+ [A-Z][a-z]+(?![0-9A-Za-z_])"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def _phrase(c: Column, words: int) -> Column:
    return F.array_join(F.slice(_words(c), F.lit(1), F.lit(words)), " ")


# --- duplicates -------------------------------------------------------------------------


def dedup_decisions(members: DataFrame, references: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, action, id, replaced_by) over members (cluster, id, created): the canonical member is updated, each other one removed for it.

    A cluster of one is an update that changes nothing. Repeated members count
    once; members without a cluster or an id are left out.
    """
    known = members.where(F.col(cluster).isNotNull() & F.col("id").isNotNull()).groupBy(cluster, "id").agg(F.min("created").alias("created"))
    kept = canonical(known, references, cluster).select(cluster, "canonical_id")
    both = lookup_join(known.select(cluster, "id"), kept, cluster)
    same = F.col("id") == F.col("canonical_id")
    return both.select(cluster, F.when(same, "update").otherwise("remove").alias("action"), "id", F.when(~same, F.col("canonical_id")).alias("replaced_by"))


def decision_counts(decisions: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per cluster what `judge.merge_rules` checks: n_members, n_update, n_remove, n_add, n_unreplaced."""
    removed = F.col("action") == "remove"
    return decisions.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("action") == "update").alias("n_update"), F.count_if(removed).alias("n_remove"), F.count_if(F.col("action") == "add").alias("n_add"), F.count_if(removed & F.col("replaced_by").isNull()).alias("n_unreplaced"))


def within_comparisons(pairs: DataFrame, limit: int = LIMITS.run_comparisons) -> DataFrame:
    """(place, id_a, id_b, similarity) of the pairs that a run may judge: the most similar ones, a top-k; the others wait."""
    order = [F.desc("similarity"), "id_a", "id_b"]
    return pairs.select("id_a", "id_b", "similarity").orderBy(*order).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*order)))


def within_searches(phrases: DataFrame, cluster: str = "cluster_id", limit: int = LIMITS.cluster_searches) -> DataFrame:
    """`phrases` (cluster, phrase_id, priority) with place: the searches that each cluster may make, highest priority first."""
    w = W.partitionBy(cluster).orderBy(F.desc("priority"), "phrase_id")
    return phrases.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


# --- splits -----------------------------------------------------------------------------


def topic_subjects(items: DataFrame, chars: int = LIMITS.bloat_chars) -> DataFrame:
    """(id, n, phrase, content): lines behind the first of an item (id, text) over the line, each a subject named by its first words (2 to 5)."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    each = items.where(F.char_length("text") > chars).select("id", F.posexplode(lines).alias("n", "content")).where("n > 0")
    return each.withColumn("phrase", _phrase(F.col("content"), 5)).where(F.size(_words(F.col("content"))) >= 2)


def _sentences(text: str) -> Column:
    """Sentences of a text with something in them, without white space at their ends."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda s: s != "")


def person_subjects(people: DataFrame) -> DataFrame:
    """(id, n, phrase, content): sentences of a person's description (id, text) that are no part of a relationship profile, named by 3 to 8 words."""
    each = people.select("id", F.posexplode(_sentences("text")).alias("n", "content"))
    return each.where(F.col("content").rlike(NOT_PROFILE)).withColumn("phrase", _phrase(F.col("content"), 8)).where(F.size(_words(F.col("content"))) >= 3)


def split(items: DataFrame, subjects: DataFrame, named: DataFrame, core: Column) -> DataFrame:
    """(id, kind, target_id, name, description): each item's split.

    Subjects (id, phrase, content) go to the record of that name (name,
    target_id, a row per name) where there is another one: "existing"; else they
    become "new" records. The item itself stays as "original", with `core` as
    its description if it has subjects, and unchanged if it has none.
    """
    homes = lookup_join(subjects.select("id", F.col("phrase").alias("name"), F.col("content").alias("description")), named, "name")
    found = F.col("target_id").isNotNull() & (F.col("target_id") != F.col("id"))
    moved = homes.select("id", F.when(found, "existing").otherwise("new").alias("kind"), F.when(found, F.col("target_id")).alias("target_id"), "name", "description")
    slim = items.join(subjects.select("id").distinct().withColumn("_cut", F.lit(True)), "id", "left")
    original = slim.select("id", F.lit("original").alias("kind"), F.col("id").alias("target_id"), F.lit(None).cast("string").alias("name"), F.when(F.col("_cut"), core).otherwise(F.col("text")).alias("description"))
    return original.unionByName(moved)


def split_topics(items: DataFrame, named: DataFrame, chars: int = LIMITS.bloat_chars) -> DataFrame:
    """The split of items (id, text) over the line: an item keeps its first line."""
    long_ones = items.where(F.char_length("text") > chars)
    return split(long_ones, topic_subjects(long_ones, chars), named, F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)), F.lit(0)))


def split_people(people: DataFrame, named: DataFrame, sentences: int = 4) -> DataFrame:
    """The split of people (id, text): a description keeps its first sentences that belong to a relationship profile; what has no name of three words is dropped."""
    profile = F.filter(_sentences("text"), lambda s: ~s.rlike(NOT_PROFILE))
    return split(people, person_subjects(people), named, F.array_join(F.slice(profile, 1, sentences), ". "))


def split_counts(splits: DataFrame, items: DataFrame) -> DataFrame:
    """Per item what `judge.split_rules` checks: keeps_original, n_subjects, n_new, changed."""
    own = F.col("kind") == "original"
    per = splits.groupBy("id").agg((F.count_if(own & (F.col("target_id") == F.col("id"))) == 1).alias("keeps_original"), F.count_if(~own).alias("n_subjects"), F.count_if(F.col("kind") == "new").alias("n_new"), F.max(F.when(own, F.col("description"))).alias("_now"))
    return per.join(items.select("id", "text"), "id").select("id", "keeps_original", "n_subjects", "n_new", (~F.col("_now").eqNullSafe(F.col("text"))).alias("changed"))


# --- people, events, facts --------------------------------------------------------------


def people(messages: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(session_id, name, confidence) of people in messages (session_id, text): a name counts as often as it is said, up to 5; known participants are left out."""
    said = messages.select("session_id", F.explode(F.regexp_extract_all("text", F.lit(PERSON), F.lit(0))).alias("name"))
    if excluded is not None:
        said = said.join(excluded.select("name").distinct(), "name", "left_anti")
    return said.groupBy("session_id", "name").agg(F.least(F.count(F.lit(1)), F.lit(5)).cast("int").alias("confidence"))


def updated_people(found: DataFrame, known: DataFrame, confidence: int = LIMITS.person_confidence) -> DataFrame:
    """(person_id, name, description, sentiment, relationship, n_primary): the record of each person that is sure enough in some session.

    `known` has (name, person_id); a name that it lacks is a new person with a
    null id. The name is the one primary identifier; nothing is said of how the
    user feels, so sentiment is 0.
    """
    sure = found.where(F.col("confidence") >= confidence).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("said"))
    ids = known.groupBy("name").agg(F.min("person_id").alias("person_id"))
    text = F.concat(F.col("name"), F.lit(" comes up in "), F.col("n").cast("string"), F.lit(" sessions."))
    return lookup_join(sure, ids, "name").select("person_id", "name", text.alias("description"), F.lit(0.0).alias("sentiment"), F.lit("Unknown").alias("relationship"), F.lit(1).alias("n_primary"))


def events(messages: DataFrame) -> DataFrame:
    """(session_id, n, name): at most one event of a session, its most emphatic message (session_id, n, text), if any; ties to the first.

    The name is what the message starts with, of 5 to 50 characters.
    """
    marks = F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit("")))
    name = F.regexp_replace(F.substring(_phrase(F.col("text"), 8), 1, 50), r"[\x20\x09-\x0D]+$", "")
    each = messages.select("session_id", "n", name.alias("name"), marks.alias("_marks")).where("_marks > 0 and char_length(name) >= 5")
    return each.groupBy("session_id").agg(F.min_by(F.struct("n", "name"), F.struct(-F.col("_marks"), F.col("n"), F.col("name"))).alias("x")).select("session_id", "x.n", "x.name")


def facts(messages: DataFrame, missing: DataFrame) -> DataFrame:
    """(name, value, session_id, n): the first place where a message (session_id, n, text) states a missing fact (name), as the name with its value behind it."""
    words = F.transform(_words(F.lower("text")), lambda w: F.regexp_replace(w, r"^\W+|\W+$", ""))
    pairs = messages.withColumn("_w", words).select("session_id", "n", F.explode(F.zip_with("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))), lambda a, b: F.struct(a.alias("name"), b.alias("value")))).alias("p"))
    said = pairs.select("p.name", "p.value", "session_id", "n").where("value <> ''").join(missing.select("name").distinct(), "name", "left_semi")
    return said.groupBy("name").agg(F.min(F.struct("session_id", "n", "value")).alias("x")).select("name", "x.value", "x.session_id", "x.n")


def still_missing(missing: DataFrame, found: DataFrame) -> DataFrame:
    """The list of missing facts (name) without those that were found."""
    return missing.select("name").distinct().join(found.select("name"), "name", "left_anti")
