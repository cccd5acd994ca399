"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.skew import global_rank, lookup_join, prefix_sum
from heddle.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Equal rows that one task sets out at once.
RUN = 10_000
#: A source gives at most so many times its own size.
MAX_REPEATS = 3
#: Weight schedules over training time 0 to 1, as knots (time, weight) joined by lines.
#: Only their shape counts: each is scaled to its source's target. Sources take them in turn.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
)


def invert_schedule(demand: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Training time at which a source's cumulative demand reaches the given share (0 to 1) of its whole.

    The integral of each line is a parabola; its inverse is taken in the form
    that has no cancellation and stays right for level lines. Weights are
    positive somewhere and negative nowhere, knots run from 0 to 1.
    """
    pieces = [(t0, t1, w0, w1, (w0 + w1) / 2 * (t1 - t0)) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole = sum(p[-1] for p in pieces)
    out, done = F.lit(float(knots[-1][0])), whole
    for t0, t1, w0, w1, area in reversed(pieces):
        done -= area
        a = F.greatest(demand * whole - F.lit(done), F.lit(0.0))
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + a * F.lit(2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        x = F.lit(t0) + F.when(root > 0, a * 2 / root).otherwise(F.lit(0.0))
        out = F.when(demand * whole < F.lit(done + area), F.least(x, F.lit(t1))).otherwise(out)
    return out


def position_at(met: Column, schedules: tuple) -> Column:
    """Training time at which a source of the row's `schedule` has met a share of its demand."""
    return F.coalesce(*[F.when(F.col("schedule") == i, invert_schedule(met, k)) for i, k in enumerate(schedules)])


def all_positions(schedules: tuple = SCHEDULES) -> Column:
    """Of a row of `mix`: the position of each copy, the cut one last.

    A copy of pass k (from 0) stands behind k whole passes of its source and the
    words before its row: at demand (k * source_size + before) / words.
    """
    n = F.col("copies") + (F.col("cut") > 0).cast("long")
    place = lambda k: F.round(position_at((k * F.col("source_size") + F.col("before")) / F.col("words"), schedules), 9)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), place)).otherwise(F.array().cast("array<double>"))


def placed_copies(mixed: DataFrame, id_column: str = "doc_id", schedules: tuple = SCHEDULES) -> DataFrame:
    """One row for each copy that `mix` takes, range-sorted by its position, with its pass (from 0) and the words taken of it."""
    copies = mixed.select(id_column, "source", "size", "copies", "cut", F.posexplode(all_positions(schedules)).alias("pass", "position"))
    words = F.when(F.col("pass") < F.col("copies"), F.col("size")).otherwise(F.col("cut"))
    return copies.select(id_column, "source", "size", "pass", words.alias("taken"), "position").repartitionByRange("position", id_column, "pass").sortWithinPartitions("position", id_column, "pass")


def fill_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds `target` to (source_size, weight): shares of the total size by weight, none above max_repeats * source_size.

    A target is the smaller of its cap and level * weight. The level starts at
    total / weights; with each round the sources at their cap leave and the rest
    share what is left, until none is above. A round is one aggregation; only
    its three totals reach the driver.
    """
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, capped = (total / weights if weights else 0.0), -1
    cap = F.col("source_size") * max_repeats
    while True:
        at_cap = cap <= F.col("weight") * F.lit(level)
        n, fixed, free = sources.agg(F.count_if(at_cap), F.coalesce(F.sum(F.when(at_cap, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            break
        level, capped = (total - fixed) / free, n
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def set_out(rows: DataFrame) -> DataFrame:
    """Each of `rows` as often as its `same` says, `before` rising by `size` from one to the next; many at once are dealt out over tasks."""
    few = rows.where(F.col("same") <= RUN).withColumns({"_from": F.lit(0).cast("long"), "_n": F.col("same")})
    many = rows.where(F.col("same") > RUN).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, F.lit(RUN).cast("long"))))
    many = many.withColumn("_n", F.least(F.lit(RUN).cast("long"), F.col("same") - F.col("_from"))).repartition("key", "digest", "size", "_from")
    each = few.unionByName(many).withColumn("_k", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)))
    return each.withColumn("before", F.col("before") + F.col("_k") * F.col("size")).drop("same", "_from", "_n", "_k", "_all")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", schedules: tuple = SCHEDULES) -> DataFrame:
    """Each row of `docs` with its part in the mix, range-sorted by training position.

    Adds size (words), source_size, target, copies (times that the row is taken
    as a whole), cut (words of one more copy, cut at the source's target),
    taken = copies * size + cut, and position (0 to 1; null if nothing is taken):
    the training time of its first copy's first word. From before (the source's
    words ahead of it in a pass), words (the source's rounded target) and
    schedule, `all_positions` and `placed_copies` place each copy. Within a source the rows follow the MD5
    of their ids. Words before a row are its source's demand met before it;
    inverting the integral of the source's weight schedule gives the position.
    No row is taken more than MAX_REPEATS times. Texts without words have size
    0 and take no part; null sources are one source, the last; repeated rows
    take part separately; the result is the same on every run. No rows: no rows.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    digest = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    sized = docs.select(F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"), key.alias("key"), size.alias("size"), digest.alias("digest"))
    # Rows that agree in all of this are interchangeable: they are counted, and set out again one behind the other.
    sized = materialize(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("same")), "mix-sizes")
    totals = sized.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "place")
    turn = lambda n: (F.col("place") - 1) % F.lit(n)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn(len(WEIGHTS)) + 1).cast("int")))
    sources = materialize(fill_targets(materialize(ranked, "mix-ranked")), "mix-targets")
    parts = sources.select("key", "source_size", "target", turn(len(schedules)).alias("schedule"), F.round("target").cast("long").alias("words"), F.ceil(F.sqrt("rows")).cast("long").alias("parts"))
    weighed = lookup_join(sized.withColumn("_all", F.col("size") * F.col("same")), parts, "key")
    rows = set_out(prefix_sum(weighed, "key", "parts", ["digest", "id", "size"], "_all", "before"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("long"))
    rest = F.col("words") - whole * F.col("source_size")
    rows = rows.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size") + F.col("cut"))
    position = position_at(F.col("before") / F.col("words"), schedules)
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, F.round(position, 9)))
    rows = materialize(rows.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", "copies", "cut", "taken", "position", "before", "words", "schedule"), "mix-rows")
    return rows.repartitionByRange("position", id_column).sortWithinPartitions("position", id_column)
