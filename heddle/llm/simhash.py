"""Near-duplicate groups by SimHash fingerprints, found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.components import connected_components
from heddle.operators.skew import lookup_join
from heddle.plans.storage import drop_tables, materialize

BITS = 64
MAX_DISTANCE = 4
SHINGLE_WORDS = 4
SEED = 42
#: Shingles hashed before their bits are counted, which bounds the memory for one text.
BLOCK_SHINGLES = 65_536
#: Fingerprints that are indexed at once.
BLOCK_ROWS = 2_048
SEGMENTS = 3
#: A bucket of more fingerprints isn't compared but indexed again, by the bits that it leaves open.
SPLIT_ROWS = 32_768
#: With fewer open bits a bucket is small: its fingerprints differ in these and in a wildcard a level.
LEAST_BITS = 6


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is set if over half of the shingles' hashes have it; no words: 0."""
    from xxhash import xxh64_intdigest

    # Of bytes, lower() changes A-Z alone and split() cuts at ASCII white space alone.
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    if len(starts) > words:
        starts, ends = starts[: -(words - 1) or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK_SHINGLES):
        spans = zip(starts[at : at + BLOCK_SHINGLES].tolist(), ends[at : at + BLOCK_SHINGLES].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str | Column) -> Column:
    """The fingerprint of a text column as a (signed) long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(x) for x in s], np.uint64).view(np.int64), dtype="int64")

    return of(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def variant_masks(rest: int = (1 << BITS) - 1, distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the one-wildcard variants of the bits in `rest`, and the bits that each variant's segment leaves open.

    The bits are cut into SEGMENTS parts of nearly equal width. Of `distance`
    differing bits, the least affected part has at most distance // SEGMENTS;
    where that is 1, two fingerprints differ by one bit at most in some part, and
    so share the variant of that part in which just this bit is the wildcard.
    """
    if distance // SEGMENTS > 1:
        raise ValueError("too few segments: each could differ by two bits")
    bits = [b for b in range(BITS) if rest >> b & 1]
    cuts = np.linspace(0, len(bits), SEGMENTS + 1).round().astype(int)
    masks, left = [], []
    for a, b in zip(cuts, cuts[1:]):
        full = sum(1 << x for x in bits[a:b])
        masks += [full & ~(1 << x) for x in bits[a:b]]
        left += [rest & ~full] * int(b - a)
    return np.array(masks, np.uint64), np.array(left, np.uint64)


def variant_keys(fp: np.ndarray, masks: np.ndarray, above: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit key for each fingerprint (rows) and variant (columns): a mix of the key above, the variant and the bits that it keeps."""
    with np.errstate(over="ignore"):
        x = (fp[:, None] & masks[None, :]) + np.arange(1, len(masks) + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x += np.asarray(above, np.uint64).reshape(-1, 1) * np.uint64(0xD6E8FEB86659FD93)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def links_of_run(fp: np.ndarray, distance: int = MAX_DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups within one bucket: at most one per fingerprint, not all pairs."""
    left = fp
    out = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            nxt = []
            for pivot in front:
                near = np.bitwise_count(left ^ pivot) <= distance
                if near.any():
                    found = left[near]
                    out.append((np.full(len(found), pivot), found))
                    nxt.append(found)
                    left = left[~near]
            front = np.concatenate(nxt) if nxt else front[:0]
    return out


def _batch(names: str, *columns: np.ndarray | None) -> pa.RecordBatch:
    n = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(n, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names.split())


def index_variants(rows: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """`rows` (key, fp, open) under all their variants of the open bits: (key, fp, open), with the bits that are still open."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                above, fp, left = (b.column(i).slice(at, BLOCK_ROWS).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
                for rest in np.unique(left):
                    some = left == rest
                    masks, after = variant_masks(int(rest), distance)
                    keys = variant_keys(fp[some], masks, above[some])
                    yield _batch("key fp open", keys.ravel(), np.repeat(fp[some], len(masks)), np.tile(after, int(some.sum())))

    return rows.select("key", "fp", "open").mapInArrow(index, "key long, fp long, open long")


def compare_buckets(index: DataFrame, distance: int = MAX_DISTANCE, split: int = SPLIT_ROWS) -> DataFrame:
    """(src, dst) of links in the buckets of `index`, and (src, key, open) of all fingerprints in buckets of over `split`, which aren't compared.

    Rows pass sorted by key; no more than `split` of one key are held, beside a batch.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64))
        large = None  # the key whose rows are passed on
        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = tuple(np.concatenate([h, x.view(h.dtype)]) for h, x in zip(held, new))
            if not len(held[0]):
                continue
            done = int(np.searchsorted(held[0], held[0][-1]))
            yield from found(*(h[:done] for h in held), large)
            held = tuple(h[done:] for h in held)
            if (len(held[0]) > split or held[0][0] == large) and int(held[2][0]).bit_count() >= LEAST_BITS:
                large = held[0][0]
                yield from found(*held, large)
                held = tuple(h[:0] for h in held)
        yield from found(*held, large)

    def found(key: np.ndarray, fp: np.ndarray, left: np.ndarray, large: int | None) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        first, size = edge[:-1], np.diff(edge)
        later = ((size > split) | (key[first] == large)) & (np.bitwise_count(left[first]) >= LEAST_BITS)
        if later.any():
            rows = np.repeat(later, size)
            yield _batch("src dst key open", fp[rows], None, key[rows], left[rows])
        two = first[(size == 2) & ~later]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        links = [(fp[near], fp[near + 1])]
        for a, n in zip(first[(size > 2) & ~later], size[(size > 2) & ~later]):
            links += links_of_run(fp[a : a + n], distance)
        src, dst = (np.concatenate([x[i] for x in links]).view(np.int64) for i in (0, 1))
        if len(src):
            pairs = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], axis=1), axis=0)
            yield _batch("src dst key open", pairs[:, 0], pairs[:, 1], None, None)

    runs = index.repartition("key").sortWithinPartitions("key", "fp")
    return runs.mapInArrow(compare, "src long, dst long, key long, open long")


def fingerprint_links(fps: DataFrame, column: str = "fp", distance: int = MAX_DISTANCE, split: int = SPLIT_ROWS) -> DataFrame:
    """Links (src, dst) between different fingerprints that span the same groups as all pairs within `distance` bits.

    `fps` has each fingerprint once. Every fingerprint is indexed under all its
    one-wildcard variants; those that share a variant meet in one run of the
    sorted index and are verified exactly. A bucket of over `split` fingerprints
    is indexed again by the bits that its variant leaves open, where they still
    differ by `distance` at most, until all buckets are small.
    """
    rows = fps.select(F.lit(0).cast("long").alias("key"), F.col(column).cast("long").alias("fp"), F.lit(-1).cast("long").alias("open"))
    levels = []
    while not levels or not rows.isEmpty():
        levels.append(materialize(compare_buckets(index_variants(rows, distance), distance, split), "simhash-links"))
        rows = levels[-1].where("dst is null").select("key", F.col("src").alias("fp"), "open")
    return reduce(DataFrame.unionByName, levels).where("dst is not null").select("src", "dst").distinct()


def fingerprint_groups(rows: DataFrame) -> DataFrame:
    """(fp, group, component_id) of every fingerprint in `rows` (id, fp): a fingerprint that names its component, and the component's smallest id."""
    reps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-reps")
    groups = connected_components(fingerprint_links(reps.select("fp")))
    named = reps.join(groups, reps.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = materialize(named, "simhash-groups")
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of_fp = materialize(lookup_join(named, least, "group").select("fp", "group", "component_id"), "simhash-of")
    drop_tables(reps, named)
    return of_fp


def simhash_components(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `df` as (id, fingerprint, component_id).

    Texts whose fingerprints differ by MAX_DISTANCE bits or fewer are linked;
    component_id is the smallest id that is reachable. Null, empty and blank
    texts have fingerprint 0 and are linked like any other. Repeated rows and
    ids stay separate rows of the same component. Rows with a null id belong to
    components, too; a component of null ids alone has a null component_id. No
    rows: no rows. Other columns are left out, whatever their names.
    """
    rows = materialize(df.select(F.col(id_column).alias("id"), fingerprint_column(text).alias("fp")), "simhash")
    out = lookup_join(rows, fingerprint_groups(rows).drop("group"), "fp")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each near-duplicate component, with all its columns: that with the smallest id.

    Null ids come last; of rows with that id and one fingerprint one stays.
    Null, empty and blank texts are one component like any other. No rows: no
    rows. Texts are shuffled once, past the ids that stay; only rows of ids that
    come repeatedly have their fingerprints taken again.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    own_id, own_text = names[id_column], names[text]
    rows = materialize(docs.select(F.col(id_column).alias("id"), fingerprint_column(text).alias("fp")), "simhash")
    grouped = lookup_join(rows, fingerprint_groups(rows), "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "fp")).alias("first")
    kept = materialize(grouped.groupBy("group").agg(first).select("first.id", "first.fp"), "simhash-kept")
    many = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "simhash-many")
    same = whole[own_id].eqNullSafe(F.col("id"))
    repeats = not many.isEmpty()
    once = kept.join(many.withColumnRenamed("id", "m"), F.col("id").eqNullSafe(F.col("m")), "left_anti") if repeats else kept
    # The ids are hashed, so that the texts stream past them and aren't sorted.
    out = whole.join(once.select("id").hint("shuffle_hash"), same, "left_semi")
    if repeats:
        again = whole.join(many, same, "left_semi").withColumn("_fp", fingerprint_column(own_text))
        out = out.unionByName(again.join(kept, again[own_id].eqNullSafe(F.col("id")) & (F.col("_fp") == F.col("fp")), "left_semi").dropDuplicates([own_id, "_fp"]).drop("_fp"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
