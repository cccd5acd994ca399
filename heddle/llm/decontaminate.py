"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.skew import lookup_join
from heddle.plans.storage import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
#: Tokens or windows that are broadcast at once; a larger benchmark is joined in blocks of that size.
BLOCK_ROWS, BLOCK_BYTES = 100_000, 32_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_text(text: str) -> Column:
    """The words of a text column, A-Z lower-cased, joined by single spaces (which no word holds). Null: empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lower = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_join(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), " ")


def item_windows(items: DataFrame, id_column: str = "item_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """(window, item): each run of `width` words of an item, or all words of a shorter one; items without words have none."""
    words = items.select(F.col(id_column).cast("string").alias("item"), normal_text(text).alias("norm")).where("norm <> ''").withColumn("words", F.split("norm", " "))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width - 1), F.lit(1)))).alias("at")
    cut = words.select("item", "words", starts)
    return cut.select(F.array_join(F.slice("words", F.col("at"), F.lit(width)), " ").alias("window"), "item").distinct()


def _blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """`df` in parts of about BLOCK_ROWS rows, and BLOCK_BYTES bytes of `key`, by the hash of `key`."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    n = max(-(-rows // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def necessary_tokens(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, window, words, width, offset) of windows that can occur at all.

    For a window's words to be contained as a whole, the prefix in the order of
    rarity is one token long: the window's rarest word by its count in all
    documents. A document without it can't hold the window; a window with a word
    that no document has is dropped.
    """
    # `key` is the column that is exploded beside its offset.
    tokens = windows.select("window", F.posexplode(F.split("window", " ")).alias("offset", "token"))
    vocabulary = materialize(tokens.select("token").distinct(), "decon-vocabulary")
    occurring = docs.select(F.explode(F.split("norm", " ")).alias("token"))
    counted = [occurring.join(F.broadcast(b), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")) for b in _blocks(vocabulary, "token")]
    counts = materialize(reduce(DataFrame.unionByName, counted), "decon-counts")
    ranked = tokens.join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest")
    chosen = ranked.groupBy("window").agg(rarest).where("rarest.n > 0")
    words = F.split("window", " ")
    return chosen.select(F.col("rarest.token").alias("token"), "window", words.alias("words"), F.size(words).alias("width"), F.col("rarest.offset").alias("offset"))


def contained_windows(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, start, width, window): each occurrence of a window in `docs` (row, norm, n_words).

    A document's words meet the necessary tokens; the token's offset gives the
    only place where the window could be, the lengths bound that place, and the
    words there are compared one by one. The document's text isn't shuffled.
    """
    found = []
    for block in _blocks(prefixes, "window"):
        small = block.select("token", F.col("words").alias("wanted"), "width", "offset", "window")
        each = docs.withColumn("words", F.split("norm", " ")).select("row", "n_words", "words", F.posexplode("words").alias("at", "token"))
        met = each.join(F.broadcast(small), "token").withColumn("start", F.col("at") - F.col("offset"))
        fits = (F.col("start") >= 0) & (F.col("start") + F.col("width") <= F.col("n_words"))
        same = F.when(fits, F.slice("words", F.col("start") + 1, F.col("width")) == F.col("wanted")).otherwise(F.lit(False))
        found.append(met.where(same).select("row", "start", "width", "window"))
    return reduce(DataFrame.unionByName, found)


def _covered(spans: str) -> Column:
    """Words inside the union of (start, width) spans."""

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["width"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))
        return F.struct((acc["n"] + new).cast("long").alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), add, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS, columns: list[str] | None = None) -> DataFrame:
    """Each row of `docs` with what it shares with the items.

    Adds n_words, n_hit (words inside occurring windows), n_items, items_sha256
    (of the sorted, comma-joined ids of items with occurring windows) and
    contaminated to the id, or to the `columns` named. Null and empty texts have
    no words. Repeated items and windows count once, repeated documents stay
    separate rows. An item with a null id marks words, but isn't counted or
    named. An empty benchmark hits nothing; no documents: no rows.
    """
    kept = [F.col(f"`{c}`") for c in columns or [id_column]]
    names = columns or [id_column]
    aliased = [c.alias(f"_c{i}") for i, c in enumerate(kept)]
    norm = docs.select(F.monotonically_increasing_id().alias("row"), *aliased, normal_text(text).alias("norm"))
    count = F.when(F.col("norm") == "", F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    table = materialize(norm.withColumn("n_words", count), "decon-docs")
    of_item = materialize(item_windows(items, item_id, item_text, width), "decon-windows")
    words = table.where("n_words > 0").select("row", "n_words", "norm")
    prefixes = materialize(necessary_tokens(of_item.select("window").distinct(), words), "decon-prefixes")
    hits = materialize(contained_windows(words, prefixes), "decon-hits")
    of_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", "width")).alias("spans"), F.array_sort(F.collect_set("window")).alias("windows"))
    of_row = materialize(of_row.select("row", _covered("spans").alias("n_hit"), F.sha2(F.array_join("windows", ","), 256).alias("key"), "windows"), "decon-rows")
    # Documents with the same windows have the same items, which are gathered once for all of them.
    each = of_row.dropDuplicates(["key"]).select("key", F.explode("windows").alias("window"))
    named = each.join(of_item.where("item is not null"), "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = materialize(named.select("key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("list")), "decon-lists")
    out = table.drop("norm").join(lookup_join(of_row.select("row", "n_hit", "key"), listed, "key"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)],
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("list", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """The rows of `docs` that hold no window of an item, with all their columns.

    What is found is named by id and digest of the text, so it holds for rows
    with null or repeated ids, too, and texts aren't kept beside their words.
    Null and empty texts stay; no rows: no rows.
    """
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    named = docs.select(F.col(f"`{id_column}`").alias("own_id"), digest.alias("digest"), F.col(f"`{text}`").alias("own_text"))
    found = contamination(named, items, "own_id", "own_text", item_id, item_text, width, ["own_id", "digest"])
    found = materialize(found.where("contaminated").select(F.col("own_id").alias("_found_id"), F.col("digest").alias("_found_digest")).distinct(), "decon-found")
    same = docs[f"`{id_column}`"].eqNullSafe(F.col("_found_id")) & (digest == F.col("_found_digest"))
    return docs.join(found, same, "left_anti")
