"""Streaming twins of the batch flows, for stores that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.plans.storage import shared_path


def event_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)


def drain_sessions(stream: DataFrame, session: str, ts: str) -> DataFrame:
    """(session_id, first_at, last_at, message_count) after all that has arrived: partial aggregates per micro-batch, merged when read.

    A batch writes below a folder of its own number, overwriting it on a replay,
    so each is counted once.
    """
    spark = stream.sparkSession
    out = shared_path(spark, "stream-sessions")

    def put(batch: DataFrame, number: int) -> None:
        part = batch.where(F.col(ts).isNotNull()).groupBy(F.col(session).alias("session_id")).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("message_count"))
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    fields = [f for f in stream.schema.fields if f.name in (session, ts)]
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    schema = f"session_id {kinds[session]}, first_at {kinds[ts]}, last_at {kinds[ts]}, message_count long, batch int"
    parts = spark.read.schema(schema).option("basePath", out).parquet(out)
    return parts.groupBy("session_id").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("message_count").alias("message_count"))


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Closed tumbling windows of a stream by event time: (window_start, kind, n), with a bound on late data."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")
