"""Judgements behind one interface, with rules as the default, and checks that hold for any judge.

A judge maps a DataFrame of payloads to a DataFrame of decisions; a language
model would do so in `mapInPandas`. The rules here are deterministic stand-ins:
they satisfy the contracts and make no claim to a model's quality.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.store import description_cap
from heddle.params import CATEGORIES, LIMITS


class Judge(Protocol):
    """What a judgement takes and gives."""

    def topics(self, windows: DataFrame) -> DataFrame: ...

    def match(self, candidates: DataFrame, hits: DataFrame) -> DataFrame: ...

    def same(self, pairs: DataFrame) -> DataFrame: ...

    def subjects(self, items: DataFrame) -> DataFrame: ...


class RuleJudge:
    """The default: decisions by rule."""

    def topics(self, windows: DataFrame) -> DataFrame:
        """(session_id, window_no, name, category, confidence): a window (…, text) is about its longest word and the one behind it."""
        words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
        longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
        name = F.substring(F.concat_ws(" ", longest["w"], F.get(words, 1 - longest["i"]), F.lit("discussion")), 1, 75)
        return windows.select("session_id", "window_no", name.alias("name"), F.lit("Interest").alias("category"), F.lit(3).alias("confidence"))

    def match(self, candidates: DataFrame, hits: DataFrame) -> DataFrame:
        """(candidate_id, result): the best hit (candidate_id, id, score) of at least 0.9, else "new"; unsure is new."""
        best = hits.groupBy("candidate_id").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))
        joined = candidates.select("candidate_id").join(best, "candidate_id", "left")
        return joined.select("candidate_id", F.when(F.col("score") >= 0.9, F.col("id").cast("string")).otherwise("new").alias("result"))

    def same(self, pairs: DataFrame) -> DataFrame:
        """Pairs (…, similarity) with certain: over 0.85 of the core is shared; the default is to keep both."""
        return pairs.withColumn("certain", F.col("similarity") >= 0.85)

    def subjects(self, items: DataFrame) -> DataFrame:
        """(id, phrase): the first words of each paragraph of an item (id, text) that is over the line."""
        lines = items.where(F.char_length("text") > LIMITS.bloat_chars).select("id", F.explode(F.split("text", "\n")).alias("line"))
        phrase = F.array_join(F.slice(F.regexp_extract_all("line", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.lit(5)), " ")
        return lines.select("id", phrase.alias("phrase")).where(F.size(F.split("phrase", " ")).between(2, 8)).distinct()


def violations(decisions: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Decisions with the names of the rules that they break; an unknown truth breaks a rule, too."""
    broken = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return decisions.withColumn("broken", F.array_join(broken, ",")).where("broken <> ''")


def topic_rules() -> dict[str, Column]:
    """Contract of a topic candidate (name, category)."""
    return {"name_length": F.char_length("name").between(10, 75), "category": F.col("category").isin(*CATEGORIES)}


def event_rules() -> dict[str, Column]:
    """Contract of an event (name)."""
    return {"name_length": F.char_length("name").between(5, 50)}


def person_rules() -> dict[str, Column]:
    """Contract of a person candidate (confidence, n_primary)."""
    return {"confidence": F.col("confidence").between(1, 5), "one_primary": F.col("n_primary") == 1}


def record_rules() -> dict[str, Column]:
    """Contract of a record (category, description, sentiment, exposure)."""
    cap = F.when(F.col("category") == "Technical", LIMITS.technical_chars).otherwise(LIMITS.description_chars)
    return {"category": F.col("category").isin(*CATEGORIES), "sentiment": F.col("sentiment").between(-1, 1), "exposure": F.col("exposure").between(0, 1), "description_length": F.char_length("description") <= cap}


def merge_rules() -> dict[str, Column]:
    """Contract of a merge decision (n_members, n_update, n_remove, n_add, n_unreplaced): nothing is lost, nothing vanishes."""
    return {"update": F.col("n_update") >= 1, "removed": F.col("n_remove") == F.col("n_members") - F.col("n_update"), "replaced_by": F.col("n_unreplaced") == 0, "add": F.col("n_add") == 0}


def split_rules() -> dict[str, Column]:
    """Contract of a split decision (keeps_original, n_subjects, n_new, changed): the original stays; without subjects nothing changes."""
    return {"original": F.col("keeps_original"), "no_subjects": (F.col("n_subjects") > 0) | ((F.col("n_new") == 0) & ~F.col("changed"))}


def discipline_rules() -> dict[str, Column]:
    """Contract of a description's length by kind (category, n_sentences)."""
    return {"sentences": F.col("n_sentences") <= description_cap(F.col("category"))}


def payload(items: DataFrame, kind: str) -> DataFrame:
    """What a judge is sent of records: of people name, description and relationship alone, of others all but vectors."""
    if kind == "person":
        return items.select("id", "name", "description", "relationship")
    return items.select(*[f"`{f.name}`" for f in items.schema.fields if f.dataType.typeName() != "array" or f.dataType.elementType.typeName() not in ("float", "double")])
