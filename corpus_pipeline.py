"""Documents to a training mix: quality, near-duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet in the shared folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.decontaminate import clean_documents
from heddle.llm.mixing import all_positions, mix
from heddle.llm.quality import quality_scores
from heddle.llm.simhash import one_per_component
from heddle.plans.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.

    The score depends on the text alone, so repeated rows share their fate. Null
    and blank texts score 0.5, below the threshold: they go. Rows with null ids
    are scored like others; a tie with the threshold stays. No documents: none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the smallest id, null last, and one of its repeated rows.

    Null and blank texts are one component. No documents: none.
    """
    return one_per_component(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item, each of repeated rows.

    Null and blank texts hold none and stay, whatever their ids. No documents: none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return clean_documents(docs, benchmark).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in the order of their first copies, with the positions of all copies.

    A document that is cut at its source's target counts `taken` words; one that
    the mix doesn't reach, or that has no words, leaves. Null sources are one
    source, repeated rows are placed separately, ties follow the ids' digests.
    No documents: none.
    """
    mixed = mix(docs).where(F.col("taken") > 0)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "position", all_positions().alias("positions"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the classifier nor SimHash can be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
