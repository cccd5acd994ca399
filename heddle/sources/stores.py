"""Readers of the three kinds of transcript stores: sessions and messages as DataFrames.

messages: tool, session_id, line_no, id, role, content, ts, raw_ts
sessions: tool, id, title, cwd, first_at, last_at, message_count, path
A store that isn't there gives empty tables of the same schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.text import decoded_directory, timestamp_of_epoch, title, title_from_path, trimmed

MESSAGES = "tool string, session_id string, line_no long, id string, role string, content string, ts timestamp, raw_ts string"
SESSIONS = "tool string, id string, title string, cwd string, first_at timestamp, last_at timestamp, message_count long, path string"
FILES = "path string, folder string, name string, modified timestamp, text string"


def matching(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def transcript_files(spark: SparkSession, roots: list[str], glob: str = "*/*.jsonl") -> DataFrame:
    """(path, folder, name, modified, text) of the roots' transcripts, a file per row; folders that start with a dot are left out."""
    there = [f"{r.rstrip('/')}/{glob}" for r in roots if matching(spark, f"{r.rstrip('/')}/{glob}")]
    if not there:
        return spark.createDataFrame([], FILES)
    read = spark.read.text(there, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_name", "_metadata.file_modification_time")
    folder = F.element_at(F.split("file_path", "/"), -2)
    return read.select(F.col("file_path").alias("path"), folder.alias("folder"), F.col("file_name").alias("name"), F.col("file_modification_time").alias("modified"), F.col("value").alias("text")).where(~folder.startswith("."))


def records(files: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, line_no (from 1, every physical line counts) and rec (a variant) of each line that holds a JSON object."""
    lines = files.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    parsed = lines.select(*keep, (F.col("pos") + 1).cast("long").alias("line_no"), F.try_parse_json(trimmed(F.col("line"))).alias("rec"))
    return parsed.where("rec is not null and not is_variant_null(rec)").where(F.schema_of_variant("rec").startswith("OBJECT"))


def text_of(content: Column, blocks: bool | Column = True) -> Column:
    """Trimmed text of a content variant: a string, or, where `blocks` allows it, its text blocks joined by a blank line."""
    kind = F.schema_of_variant(content)
    items = F.try_variant_get(content, "$", "array<variant>")
    field = lambda b, f: F.when(F.schema_of_variant(F.try_variant_get(b, f"$.{f}", "variant")) == "STRING", F.try_variant_get(b, f"$.{f}", "string"))
    texts = F.filter(F.transform(F.filter(items, lambda b: field(b, "type") == "text"), lambda b: field(b, "text")), lambda t: t.isNotNull())
    joined = F.when(F.lit(blocks) if isinstance(blocks, bool) else blocks, F.array_join(texts, "\n\n"))
    return trimmed(F.coalesce(F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), joined), F.lit("")))


def _string(path: str) -> Column:
    v = F.try_variant_get("rec", path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("rec", path, "string"))


def _time(raw: Column) -> Column:
    return F.try_to_timestamp(raw)


def _message_columns(tool: str) -> list[Column]:
    epoch = F.lit("1970-01-01").cast("timestamp")
    return [F.lit(tool).alias("tool"), "session_id", "line_no", "id", "role", "content", F.coalesce(_time(F.col("raw_ts")), epoch).alias("ts"), "raw_ts"]


def ordered(messages: DataFrame) -> DataFrame:
    """Messages numbered within their session by time; equal times keep file order."""
    return messages.withColumn("n", F.row_number().over(W.partitionBy("tool", "session_id").orderBy("ts", "line_no")))


def project_store(spark: SparkSession, root: str, tool: str = "store1") -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of <root>/<project>/<session>.jsonl; files of sub-agents are skipped.

    User content counts if it is a string (arrays are tool results); the span of
    a session takes all user and assistant records, its directory is the first
    that a record names.
    """
    files = transcript_files(spark, [root]).where(~F.col("name").startswith("agent-"))
    files = files.withColumn("session_id", F.regexp_replace("name", r"\.jsonl$", ""))
    rec = records(files, ["path", "session_id"]).withColumn("role", _string("$.type")).where(F.col("role").isin("user", "assistant"))
    content = F.try_variant_get("rec", "$.message.content", "variant")
    rec = rec.withColumns({"raw_ts": _string("$.timestamp"), "id": _string("$.uuid"), "cwd": _string("$.cwd"), "content": text_of(content, F.col("role") == "assistant")}).drop("rec")
    kept = rec.where("content <> ''")
    span = rec.groupBy("session_id").agg(F.min(_time(F.col("raw_ts"))).alias("first_at"), F.max(_time(F.col("raw_ts"))).alias("last_at"), F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line_no"))).alias("cwd"), F.count_if(F.col("content") != "").alias("message_count"), F.min("path").alias("path"))
    listed = span.where("message_count > 0 and last_at is not null")
    sessions = listed.select(F.lit(tool).alias("tool"), F.col("session_id").alias("id"), title_from_path(F.col("cwd")).alias("title"), F.coalesce("cwd", F.lit("")).alias("cwd"), "first_at", "last_at", "message_count", "path")
    return sessions, kept.select(*_message_columns(tool))


def session_store(spark: SparkSession, roots: list[str], tool: str = "store2") -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of <root>/<encoded directory>/<time>_<uuid>.jsonl below several roots.

    The uuid is what follows the first "_" of the name; files without one are
    skipped. Content may be a string or blocks for both roles; the span takes kept
    messages, the directory is that of the last header, else the folder's name.
    """
    files = transcript_files(spark, roots).where(F.instr("name", "_") > 0)
    files = files.withColumn("session_id", F.regexp_extract("name", r"^[^_]*_(.*)\.jsonl$", 1)).where("session_id <> ''")
    rec = records(files, ["path", "folder", "session_id"]).withColumn("type", _string("$.type"))
    header = rec.where("type = 'session'").groupBy("session_id").agg(F.max_by(_string("$.cwd"), F.when(_string("$.cwd") != "", F.col("line_no"))).alias("cwd"))
    said = rec.where("type = 'message'").withColumn("role", _string("$.message.role")).where(F.col("role").isin("user", "assistant"))
    said = said.withColumns({"content": text_of(F.try_variant_get("rec", "$.message.content", "variant")), "raw_ts": _string("$.timestamp"), "id": F.concat(F.col("session_id"), F.lit("/"), F.coalesce(_string("$.id"), F.lit("")))}).drop("rec").where("content <> ''")
    span = said.groupBy("session_id").agg(F.min(_time(F.col("raw_ts"))).alias("first_at"), F.max(_time(F.col("raw_ts"))).alias("last_at"), F.count(F.lit(1)).alias("message_count"), F.min("path").alias("path"), F.min("folder").alias("folder"))
    named = span.where("last_at is not null").join(header, "session_id", "left").withColumn("cwd", F.coalesce("cwd", decoded_directory(F.col("folder"))))
    sessions = named.select(F.lit(tool).alias("tool"), F.col("session_id").alias("id"), title_from_path(F.col("cwd")).alias("title"), "cwd", "first_at", "last_at", "message_count", "path")
    return sessions, said.select(*_message_columns(tool))


def thread_store(threads: DataFrame, rollouts: DataFrame, since: str | None = None, tool: str = "store3") -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of a thread table joined with its rollout files (path, text).

    The table's own update time filters threads before any file is joined. A
    thread without a readable file, or without messages, is no session. Messages
    without a time have the epoch, but don't count for the span, for which the
    table's times stand in.
    """
    created = F.coalesce(timestamp_of_epoch(F.col("created_at_ms").cast("double")), timestamp_of_epoch(F.col("created_at").cast("double")))
    updated = F.coalesce(timestamp_of_epoch(F.col("updated_at_ms").cast("double")), timestamp_of_epoch(F.col("updated_at").cast("double")))
    t = threads.where("rollout_path is not null and rollout_path <> ''").select("id", "rollout_path", F.col("title").alias("own_title"), "first_user_message", F.coalesce("cwd", F.lit("")).alias("cwd"), created.alias("created"), updated.alias("updated"))
    if since is not None:
        t = t.where(F.col("updated").isNull() | (F.col("updated") > F.lit(since).cast("timestamp")))
    files = t.join(rollouts.select(F.regexp_replace("path", "^file:/+", "/").alias("rollout_path"), "text"), "rollout_path").withColumn("session_id", F.col("id"))
    rec = records(files, ["session_id"]).where(_string("$.type") == "event_msg").withColumn("kind", _string("$.payload.type")).where(F.col("kind").isin("user_message", "agent_message"))
    said = rec.withColumns({"content": trimmed(F.coalesce(_string("$.payload.message"), F.lit(""))), "raw_ts": _string("$.timestamp"), "id": F.concat(F.lit("evt_"), F.col("line_no").cast("string")), "role": F.when(F.col("kind") == "user_message", "user").otherwise("assistant")}).drop("rec", "kind").where("content <> ''")
    span = said.groupBy(F.col("session_id").alias("id")).agg(F.min(_time(F.col("raw_ts"))).alias("first_said"), F.max(_time(F.col("raw_ts"))).alias("last_said"), F.count(F.lit(1)).alias("message_count"))
    named = t.join(span, "id").withColumns({"first_at": F.coalesce("first_said", "created"), "last_at": F.coalesce("last_said", "updated")})
    if since is not None:
        named = named.where(F.col("last_at") > F.lit(since).cast("timestamp"))
    sessions = named.select(F.lit(tool).alias("tool"), "id", title(F.col("own_title"), F.col("first_user_message"), F.col("cwd"), "Untitled Session").alias("title"), "cwd", "first_at", "last_at", "message_count", F.col("rollout_path").alias("path"))
    return sessions, said.select(*_message_columns(tool))


def session_json(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(tool, id, json): each session with its ordered messages; nesting happens at this sink alone."""
    m = F.struct("n", F.struct("id", "role", "content", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")).alias("m"))
    nested = ordered(messages).groupBy("tool", F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(m)).alias("l"))
    both = sessions.join(nested, ["tool", "id"])
    fields = [F.col(c) for c in sessions.columns if c not in ("first_at", "last_at", "message_count")]
    return both.select("tool", "id", F.to_json(F.struct(*fields, F.col("message_count").alias("messageCount"), F.transform("l", lambda x: x["m"]).alias("messages"))).alias("json"))
