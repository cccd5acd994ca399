"""Matching of candidates to records: identifiers, names, search hits, quotes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.operators.skew import lookup_join
from heddle.params import LIMITS
from heddle.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Short quotes that are broadcast at once.
QUOTE_BLOCK = 20_000


def person_match(candidates: DataFrame, by_identifier: DataFrame, by_name: DataFrame) -> DataFrame:
    """(candidate_id, person_id, matched_by): the identifier decides; name and relationship only where it finds nothing; else "new".

    `by_identifier` has (identifier, person_id) and `by_name` (name, relationship,
    person_id); the smallest person_id of several is taken.
    """
    ids = by_identifier.groupBy("identifier").agg(F.min("person_id").alias("p1"))
    names = by_name.groupBy("name", "relationship").agg(F.min("person_id").alias("p2"))
    first = lookup_join(candidates, ids, "identifier")
    both = first.join(names, ["name", "relationship"], "left")
    how = F.when(F.col("p1").isNotNull(), "identifier").when(F.col("p2").isNotNull(), "name").otherwise("new")
    return both.select("candidate_id", F.coalesce("p1", "p2").alias("person_id"), how.alias("matched_by"))


def storable(candidates: DataFrame, excluded: DataFrame, confidence: int = LIMITS.person_confidence) -> DataFrame:
    """Candidates (name, confidence) that are sure enough and not excluded by name."""
    return candidates.where(F.col("confidence") >= confidence).join(excluded.select("name").distinct(), "name", "left_anti")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def search_hits(phrases: DataFrame, items: DataFrame, k: int = LIMITS.search_hits) -> DataFrame:
    """(phrase_id, id, n_shared, rank): the k items that share most different words with a phrase; ties to the smaller id.

    Words are ordered by rarity. The items that have one of a phrase's two
    rarest words give it a score that its k-th item reaches. An item that
    reaches it shares one of the phrase's words but for the commonest score - 1,
    so only the others are joined, and the candidates are counted exactly.
    Phrases and items without words, and null ids, have no hits.
    """
    listed = lambda df, key, c: df.where(f"{key} is not null").select(key, F.array_distinct(_words(F.lower(F.col(c)))).alias("words"))
    p = materialize(listed(phrases, "phrase_id", "phrase"), "search-phrases")
    i = materialize(listed(items, "id", "text"), "search-items")
    wanted = p.select(F.explode("words").alias("word")).distinct()
    has = materialize(i.select("id", F.explode("words").alias("word")).join(wanted, "word", "left_semi"), "search-words")
    n = has.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ordered = p.select("phrase_id", F.explode("words").alias("word")).join(n, "word").groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("t"))
    ordered = materialize(ordered.select("phrase_id", F.transform("t", lambda x: x["word"]).alias("t")), "search-ordered")
    # Of an item only the words that some phrase has are compared.
    own = has.groupBy("id").agg(F.collect_list("word").alias("own"))

    def counted(prefix: Column) -> DataFrame:
        """(phrase_id, id, n_shared) of items that have a word of the phrase's prefix."""
        keys = ordered_by.select("phrase_id", F.explode(F.slice("t", F.lit(1), prefix)).alias("word"))
        met = has.join(keys, "word").select("phrase_id", "id").distinct()
        return met.join(own, "id").join(ordered, "phrase_id").select("phrase_id", "id", F.size(F.array_intersect("own", "t")).cast("long").alias("n_shared"))

    ordered_by = ordered
    rank = F.row_number().over(W.partitionBy("phrase_id").orderBy(F.desc("n_shared"), "id"))
    first = counted(F.lit(2)).withColumn("rank", rank).where(F.col("rank") == k).select("phrase_id", F.col("n_shared").alias("least"))
    ordered_by = materialize(ordered.join(first, "phrase_id", "left").withColumn("least", F.coalesce("least", F.lit(1))), "search-least")
    return counted((F.size("t") - F.col("least") + 1).cast("int")).withColumn("rank", rank).where(F.col("rank") <= k)


def _short_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, id) for quotes without an inner word: one automaton for each QUOTE_BLOCK of them reads all texts once."""
    blocks = -(-quotes.count() // QUOTE_BLOCK)
    found = []
    for k in range(blocks):
        block = quotes.where(F.pmod(F.xxhash64("quote", "quote_id"), F.lit(blocks)) == k)
        shared = texts.sparkSession.sparkContext.broadcast([(r["quote"], r["quote_id"]) for r in block.collect()])

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            ids: dict[str, list] = {}
            for quote, quote_id in shared.value:
                ids.setdefault(quote, []).append(quote_id)
            automaton = ahocorasick.Automaton()
            for quote in ids:
                automaton.add_word(quote, quote)
            automaton.make_automaton()
            for pdf in batches:
                out = [(q, i) for i, t in zip(pdf["id"], pdf["text"]) if t for quote in {q for _, q in automaton.iter(t)} for q in ids[quote]]
                yield pd.DataFrame(out, columns=["quote_id", "id"])

        kinds = f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}, id {texts.schema['id'].dataType.simpleString()}"
        found.append(texts.where("id is not null").select("id", "text").mapInPandas(find, kinds))
    return reduce(DataFrame.unionByName, found).distinct()


def verbatim(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, id): quotes that stand verbatim in a text.

    All words of a quote but its first and last are whole words of a text that
    holds it. The rarest of them is joined, and `contains` decides; a text comes
    in once for all of its candidates. Quotes of fewer than three words have no
    such word: blocks of them are looked for in all texts. Null and empty quotes
    stand nowhere, null ids are left out.
    """
    q = quotes.where("quote <> '' and quote_id is not null").withColumn("w", _words(F.col("quote")))
    inner = q.where(F.size("w") > 2).select("quote_id", "quote", F.explode(F.slice("w", F.lit(2), F.size("w") - 2)).alias("word"))
    occurring = texts.where("id is not null").select("id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    counts = occurring.select("word").join(inner.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = inner.join(counts, "word", "left").groupBy("quote_id", "quote").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0")
    keyed = rarest.select("quote_id", "quote", F.col("r.word").alias("word"))
    # Ids alone are exploded and met; the texts that are candidates come in afterwards, each once.
    wanted = occurring.join(keyed, "word").groupBy("id").agg(F.collect_set(F.struct("quote_id", "quote")).alias("quotes"))
    met = texts.select("id", "text").join(wanted, "id").select("id", F.filter("quotes", lambda x: F.contains(F.col("text"), x["quote"])).alias("held"))
    long_ones = met.select(F.explode("held.quote_id").alias("quote_id"), "id").distinct()
    short = materialize(q.where(F.size("w") <= 2).select("quote_id", "quote").distinct(), "short-quotes")
    return long_ones if short.isEmpty() else long_ones.unionByName(_short_quotes(short, texts))
