"""WARC archives with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.skew import lookup_join
from heddle.plans.storage import materialize, shared_path

#: A file is closed when it holds so many bytes, so that it can be read back as one row.
FILE_BYTES = 16_000_000
GZIP_LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Records in one batch, and bytes of payload after which a batch ends.
BATCH_RECORDS, BATCH_BYTES = 1_000, 8_000_000


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five bits of the digest to a digit, 40 at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def captured(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Numbered records of `pages`: (row, page_id, url, payload, payload_bytes, payload_digest, payload_sha256); a null html is an empty payload."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return materialize(rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload")), "payload_sha256": F.sha2("payload", 256)}), "warc-captured")


def resolve_revisits(headers: DataFrame, min_payload: int = 0) -> DataFrame:
    """(row, refers_to, refers_row, refers_url) of the records that revisit another one.

    `headers` has row, page_id, url, payload_bytes, payload_digest and
    payload_sha256, but no payload, and is what is shuffled. Payloads that share
    the archive's SHA-1 are equal if their SHA-256 is, too, so that no collision
    of the former makes a revisit. Of equal ones the
    one with the smallest page_id (null last), then row, is the response;
    payloads below `min_payload` bytes are left alone. Digests with a single
    record leave before the join, and frequent ones are joined by a broadcast.
    """
    same = headers.where(F.col("payload_bytes") >= min_payload)
    key = F.concat_ws(":", "payload_digest", "payload_sha256").alias("key")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row", "url")).alias("first")
    groups = same.groupBy(key).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    met = lookup_join(same.select("row", key), groups, "key").where(F.col("first.row") != F.col("row"))
    return met.select("row", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row"), F.col("first.url").alias("refers_url"))


def record_id(page_id: int | None, row: int) -> str:
    """A record's own name, the same on every run."""
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{row}").urn


def render(page_id: int | None, row: int, url: str | None, payload: bytes | None, size: int, digest: str, refers: tuple[int | None, int, str | None] | None) -> bytes:
    """One uncompressed WARC record with fresh headers; a revisit has the HTTP headers alone as its block."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    safe = lambda u: quote(u or "", safe="%/:=&?~#+!$,;'@()*[]", errors="replace")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{record_id(page_id, row)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers[0], refers[1])}>", f"WARC-Refers-To-Target-URI: {safe(refers[2])}", f"WARC-Refers-To-Date: {DATE}"]
        if refers[0] is not None:
            head.append(f"X-Refers-To-Page-Id: {refers[0]}")
    else:
        block += payload or b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES, level: int = GZIP_LEVEL) -> DataFrame:
    """Write `records` (captured columns plus refers_to, refers_row, refers_url) as .warc.gz files, a gzip member each.

    A task sorts its records, writes under a name of its own attempt and renames
    each file once it is whole, so a task that runs again after a lost executor
    replaces the same files by equal ones. Returns the manifest (file, records,
    bytes).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        number, out, n, size, made = 0, None, 0, 0, []

        def close() -> None:
            nonlocal out, number, n, size
            out.close()
            name = f"{folder}/part-{task.partitionId():06d}-{number:05d}.warc.gz"
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)  # an equal file of an earlier attempt, over which some stores can't rename
            store.move(temporary, name)
            made.append((name.rsplit("/", 1)[1], n, size))
            out, n, size, number = None, 0, 0, number + 1

        for b in batches:
            c = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                v = {name: col[i].as_py() for name, col in c.items()}
                refers = None if v["refers_row"] is None else (v["refers_to"], v["refers_row"], v["refers_url"])
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = z.compress(render(v["page_id"], v["row"], v["url"], v["payload"], v["payload_bytes"], v["payload_digest"], refers)) + z.flush()
                if out is None:
                    temporary = f"{folder}/attempt-{task.taskAttemptId()}-{number}.tmp"
                    out = store.open_output_stream(temporary)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return materialize(records.sortWithinPartitions("row").mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            part = view[at : at + 65_536]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> dict:
    """Headers of a record by lower-case name, and its `block`."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out["block"] = rest[: int(out["content-length"])]
    return out


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all .warc.gz files below `path`: page_id, url, record_type, record_id, refers_to_id, refers_to, payload_bytes, payload_digest and, if asked for, payload.

    A response's payload is held against its digest; one that differs is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        for b in batches:
            for i in range(b.num_rows):
                for record in members(b.column(0)[i].as_py()):
                    h = parse(record)
                    http, _, payload = h["block"].partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload and digest differ: {h['warc-record-id']}")
                    own, other = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    row = (own and int(own), h["warc-target-uri"], h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), other and int(other), length, digest)
                    rows.append((*row, payload if h["warc-type"] == "response" else None) if payloads else row)
                    size += len(payload) if payloads else 0
                    if len(rows) >= BATCH_RECORDS or size > BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        yield batch()

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = "page_id long, url string, record_type string, record_id string, refers_to_id string, refers_to long, payload_bytes long, payload_digest string"
    if payloads:
        fields.append(("payload", pa.binary()))
        schema += ", payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(read, schema)


def archive(pages: DataFrame, path: str, min_payload: int = 0, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write `pages` as deduplicated archives below `path` and return their manifest.

    Headers are shuffled by payload digest, revisits resolved, and every record
    written with fresh headers. Null urls are empty, null html an empty payload;
    a null page_id is left out of the headers. Repeated rows are records of
    their own. No pages: no archives.
    """
    records = captured(pages, id_column, url, html)
    revisits = materialize(resolve_revisits(records.drop("payload"), min_payload), "warc-revisits")
    return write_archives(records.drop("payload_sha256").join(revisits, "row", "left"), path)


def rewrite_archives(spark: SparkSession, source: str, path: str, min_payload: int = 0) -> DataFrame:
    """Deduplicate existing archives: responses and revisits are resolved anew and written below `path`; the manifest.

    A revisit gets the payload of the record that it refers to, and is then
    treated like any other record; one whose original isn't there stays out.
    """
    old = materialize(read_archives(spark, source).withColumn("row", F.monotonically_increasing_id()), "warc-old")
    originals = old.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("found")).dropDuplicates(["refers_to_id"])
    again = lookup_join(old.where("record_type = 'revisit'"), originals, "refers_to_id").where("found is not null").withColumn("payload", F.col("found")).drop("found")
    columns = ["row", "page_id", "url", "payload", "payload_bytes", "payload_digest"]
    every = old.where("record_type = 'response'").select(*columns).unionByName(again.select(*columns))
    records = materialize(every.withColumn("payload_sha256", F.sha2("payload", 256)), "warc-captured")
    revisits = materialize(resolve_revisits(records.drop("payload"), min_payload), "warc-revisits")
    return write_archives(records.drop("payload_sha256").join(revisits, "row", "left"), path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """`pages` written to archives in the shared folder and read back: the digest of the round trip."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    manifest = archive(pages, path)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
