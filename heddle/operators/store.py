"""Writing to a store: shaping and tagging records, cursor tables, snapshots, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.plans.storage import drop_path

#: What a phase of a hygiene run needs of a store.
PHASES = {
    "dedup": ("search", "mutate"),
    "decay": ("mutate",),
    "split": ("search", "mutate"),
    "invalidate": ("graph", "mutate"),
    "reconnect": ("graph", "mutate"),
    "summarize": ("diary",),
    "report": (),
}
#: Sentences that a description may have, by kind of record.
SENTENCES = {"Event": 4, "Technical": 8, "person": 4}


def shaped(records: DataFrame, schema: StructType) -> DataFrame:
    """`records` in a store's schema: fields without a home are dropped, missing ones null, values cast where they fit."""
    have = set(records.columns)
    return records.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def tags(tool: Column, machine: str, session: Column, collected: str) -> Column:
    """Where a record is from, and the day that it was collected."""
    return F.array(F.concat(F.lit("source:"), F.concat_ws(":", tool, F.lit(machine), session.cast("string"))), F.lit(f"collected:{collected}"))


def append(records: DataFrame, path: str) -> None:
    """Add to a store; nothing is ever deleted by a collection."""
    records.write.mode("append").parquet(path)


def advanced(cursor: DataFrame, resolved: DataFrame) -> DataFrame:
    """The cursor (tool, session_id, status, at) after a run: the latest row of each session stays."""
    every = cursor.unionByName(resolved)
    newest = F.max_by(F.struct("status", "at"), F.struct("at", "status"))
    return every.groupBy("tool", "session_id").agg(newest.alias("x")).select("tool", "session_id", "x.status", "x.at")


def read_version(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, int]:
    """The newest whole snapshot below `path` and its number; empty and 0 without one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    numbers = sorted(int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found or [])
    if not numbers:
        return spark.createDataFrame([], schema), 0
    return spark.read.schema(schema).parquet(f"{path}/version={numbers[-1]}"), numbers[-1]


def write_version(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write the next snapshot below `path`; older ones than the last `keep` go. A reader sees the old one until the new one is whole."""
    spark = df.sparkSession
    _, last = read_version(spark, path, df.schema)
    df.write.mode("overwrite").parquet(f"{path}/version={last + 1}")
    if last + 1 - keep > 0:
        drop_path(spark, f"{path}/version={last + 1 - keep}")
    return last + 1


def phases(capabilities: DataFrame) -> DataFrame:
    """(store, phase, runs, missing): which phases can run on each store (store, capability); a missing capability skips a phase."""
    listed = F.array(*[F.struct(F.lit(p).alias("phase"), F.array(*map(F.lit, needs)).cast("array<string>").alias("needs")) for p, needs in PHASES.items()])
    have = capabilities.groupBy("store").agg(F.collect_set("capability").alias("have")).select("store", "have", F.explode(listed).alias("p"))
    missing = F.array_join(F.array_sort(F.array_except("p.needs", "have")), ",")
    return have.select("store", F.col("p.phase").alias("phase"), (missing == "").alias("runs"), missing.alias("missing"))


def description_cap(category: Column) -> Column:
    """Sentences that a description of a category may have."""
    out = F.lit(6)
    for kind, n in SENTENCES.items():
        out = F.when(category == kind, F.lit(n)).otherwise(out)
    return out


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """`rows` with the columns of a table of one row."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def diary(report: DataFrame, notable: DataFrame, sentences: int = 6) -> DataFrame:
    """(text): the diary entry of a run, 2 to 6 sentences: how much was added, the names of the latest records (name, at), and the health of the store."""
    top = notable.where("name is not null").orderBy(F.desc("at"), "name").limit(sentences - 2)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.unix_micros(F.col("at").cast("timestamp")), "name"))), lambda x: F.concat(F.lit(" New: "), x["name"], F.lit("."))), "")
    added = notable.agg(F.count(F.lit(1)).alias("n"))
    parts = [F.concat(F.lit(f"{n} "), F.col(f"n_{n}").cast("string")) for n in ("merge", "decay", "split", "invalidate", "reconnect")]
    health = F.concat(F.lit(" Garden health: "), F.concat_ws(", ", *parts), F.lit("; resume at "), F.col("resume_point"), F.lit("."))
    both = beside(beside(report, added), top.agg(listed.alias("listed")))
    return both.select(F.concat(F.lit("The interval brought "), F.col("n").cast("string"), F.lit(" records."), "listed", health).alias("text"))


def diary_records(entry: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(store, kind, text, tags): the entry for each store (store, capability): a diary entry, or where there is no diary a tagged memory."""
    have = capabilities.groupBy("store").agg(F.max(F.col("capability") == "diary").alias("diary"))
    kind = F.when(F.col("diary"), "diary").otherwise("memory")
    return beside(have, entry).select("store", kind.alias("kind"), "text", F.when(F.col("diary"), F.array().cast("array<string>")).otherwise(F.array(F.lit("garden-summary"))).alias("tags"))
