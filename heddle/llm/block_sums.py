"""Sums by key over blocks of a table, answered to every block that asked: packed, so that a key never is a row of its own."""

from __future__ import annotations

import gc
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.plans.storage import drop_path, shared_path

Arrays = dict[str, np.ndarray]


#: Arrays that rise, which are kept as distances; of these, ranks of keys within their bucket, with the bucket above RANK_BITS bits.
RANKS, RISING, RANK_BITS = ("id", "ctx_id"), ("id", "ctx_id", "words"), 40


def _kind(name: str) -> str:
    """An array's name without the tag of its exchange."""
    return name.rpartition(".")[2]


def pack(arrays: Arrays) -> bytes:
    """Named arrays of numbers as bytes: each by planes of equally weighted bytes, compressed. Signs become the lowest bits, and planes above the highest number are left out."""
    out = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        if _kind(name) in RISING:
            a = np.diff(a, prepend=a.dtype.type(0))
        signs = len(a) > 0 and a.dtype.kind == "i" and a.min() < 0
        if signs:
            a = (a << 1) ^ (a >> (8 * a.itemsize - 1))
        width = a.itemsize
        if len(a) and a.dtype.kind in "iu" and a.min() >= 0:
            width = max(1, (int(a.max()).bit_length() + 7) // 8)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes()
        data = pa.compress(planes, "zstd", asbytes=True) if planes else b""
        head = f"{name} {a.dtype.str} {width} {signs:d}".encode()
        out += [struct.pack("<HQQ", len(head), len(a), len(data)), head, data]
    return b"".join(out)


def unpack(data: bytes) -> Arrays:
    """What `pack` was given."""
    out: Arrays = {}
    at = 0
    while at < len(data):
        head, n, size = struct.unpack_from("<HQQ", data, at)
        name, kind, width, signs = data[at + 18 : at + 18 + head].decode().split(" ")
        at += 18 + head
        dtype, width = np.dtype(kind), int(width)
        items = np.zeros((n, dtype.itemsize), np.uint8)
        if n:
            items[:, :width] = np.frombuffer(pa.decompress(data[at : at + size], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
        a = items.reshape(-1).view(dtype)
        if signs == "1":
            a = ((a >> 1) & np.iinfo(dtype).max) ^ -(a & 1)
        out[name] = np.cumsum(a, dtype=dtype) if _kind(name) in RISING else a
        at += size
    return out


def numbers(ranks: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers from 0 without large gaps, for ranks within evenly filled buckets."""
    return ((ranks & ((1 << RANK_BITS) - 1)) * buckets + (ranks >> RANK_BITS)).astype(np.uint64)


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted keys as distances, which pack smaller."""
    return np.diff(sorted_keys, prepend=np.uint64(0))


def buckets_of(sorted_keys: np.ndarray, buckets: int, span: int = 1 << 64) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of sorted keys that are evenly distributed below `span`: a bucket is a range of keys."""
    bounds = np.array([i * span // buckets for i in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(sorted_keys, bounds).tolist(), len(sorted_keys)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield i, a, b


def release_shuffles(spark: SparkSession, rounds: int = 1) -> None:
    """Has Spark delete the files of shuffles that nothing refers to any more, which else stay until the driver happens to collect its garbage. Those of the job just ended are only free in a second round."""
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2 if rounds > 1 else 0)


def _batch(names: str, *columns: list, kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


def summed(requests: list[tuple[int, Arrays]], decide: Callable[[Arrays], Arrays]) -> Iterator[tuple[int, Arrays]]:
    """(block, answer) of one bucket's requests (block, arrays with `keys`): for each key what `decide` makes of the sums of all blocks, and whether the block is the first to name it (`owner`).

    Of values whose name starts with "most" the highest is taken.
    Requests come in the order of their blocks, so that sums of fractions are the same on every run.
    """
    keys = np.concatenate([np.cumsum(r["keys"], dtype=np.uint64) for _, r in requests])
    unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
    sums = {n: np.zeros(len(unique), a.dtype) for n, a in requests[0][1].items() if n != "keys"}
    at = 0
    for _, r in requests:
        own = place[at : at + len(r["keys"])]
        for n, total in sums.items():
            total[own] = np.maximum(total[own], r[n]) if n.startswith("most") else total[own] + r[n]  # a block names a key once
        at += len(own)
    owner = np.zeros(len(keys), np.uint8)
    owner[first] = 1
    decided = decide(sums)
    at = 0
    for block, r in requests:
        own = slice(at, at + len(r["keys"]))
        yield block, {"owner": owner[own], **{n: a[place[own]] for n, a in decided.items()}}
        at += len(r["keys"])


class Sums(NamedTuple):
    """What blocks ask for by key.

    `decide` makes answers of the sums. In the order of the block's keys, which
    are spread evenly below `span`, they are arrays of the block from then on,
    under the tag and their name; with `owner`, too, whether the block is the
    first that has the key. Answers named in RANKS are ranks of keys within a
    bucket, to which the bucket is added.
    """

    tag: str
    decide: Callable[[Arrays], Arrays]
    owner: bool = True
    span: int = 1 << 64


class BlockTable:
    """Blocks (block, data, and further columns) in the shared folder, and what they have been answered so far.

    The arrays of the column `once` are only there for the first exchange and
    leave the folder behind it. Each exchange's answers are a table of their own,
    which is never written again. All tables are bucketed by block, so that
    answers come to their blocks, and the blocks stay where they are. `parts`
    buckets each.
    """

    def __init__(self, rows: DataFrame, parts: int, once: str | None = None) -> None:
        self.parts, self.once = parts, once
        self.rows, self._drop = self._stored(rows)
        self.answers: list[DataFrame] = []

    def _stored(self, rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        spark = rows.sparkSession
        path, name = shared_path(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.parts, "block").sortBy("block").option("path", path).saveAsTable(name)

        def drop() -> None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(spark, path)

        return spark.table(name), drop

    def known(self, *columns: str) -> DataFrame:
        """(data, answers, columns) of every block."""
        rows, found = self.rows, [F.lit(b"")]
        for i, answers in enumerate(self.answers):
            rows = rows.join(answers.select("block", F.col("answers").alias(f"answers_{i}")), "block", "left")
            found.append(F.coalesce(f"answers_{i}", F.lit(b"")))
        data = F.concat("data", self.once) if self.once else F.col("data")
        return rows.select(data.alias("data"), F.concat(*found).alias("answers"), *columns)

    def _forget(self) -> None:
        """Leaves out what only the first exchange needed."""
        if self.once:
            drop = self._drop
            self.rows, self._drop = self._stored(self.rows.drop(self.once))
            self.once = None
            drop()

    def exchange(self, sums: list[Sums], ask: Callable[[Arrays], list[Arrays]], buckets: int) -> None:
        """Sums over all blocks, answered to each that asked.

        For each of `sums`, `ask(block)` gives sorted `keys` and values to sum by
        key. Two shuffles: requests by ranges of keys, answers by block; the files
        of the first go before the second begins. A key is in a request once for
        each block that has it, so no key is hot.
        """

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    rows: list[tuple] = []
                    for k, (of, asked) in enumerate(zip(sums, ask(block_of(b.column(0)[i], b.column(1)[i])))):
                        for bucket, a, z in buckets_of(asked["keys"], buckets, of.span):
                            part = {n: x[a:z] for n, x in asked.items()}
                            rows.append((k * buckets + bucket, b.column(2)[i].as_py(), pack(part | {"keys": steps(part["keys"])})))
                    if rows:
                        yield _batch("bucket block data", *zip(*rows), kinds=(pa.int32(), pa.int64(), pa.binary()))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []

            def answer() -> Iterator[pa.RecordBatch]:
                if held:
                    of, above = sums[now // buckets], now % buckets << RANK_BITS
                    rows = [(block, now, pack({f"{of.tag}.{n}": x + above if n in RANKS else x for n, x in a.items() if of.owner or n != "owner"})) for block, a in summed(held, of.decide)]
                    yield _batch("block bucket data", *zip(*rows), kinds=(pa.int64(), pa.int32(), pa.binary()))

            for b in batches:
                for bucket, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    if bucket != now:
                        yield from answer()
                        now, held = bucket, []
                    held.append((block, unpack(data.as_py())))
            yield from answer()

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    parts: dict[str, list[np.ndarray]] = {}
                    for x in sorted(b.column(1)[i].as_py(), key=lambda x: x["bucket"]):
                        for n, a in unpack(x["data"]).items():
                            parts.setdefault(n, []).append(a)
                    new = {n: np.concatenate(p) for n, p in parts.items()}
                    tops = [(n, int((x & ((1 << RANK_BITS) - 1)).max())) for n, x in new.items() if _kind(n) in RANKS]
                    yield _batch("block answers tops", [b.column(0)[i].as_py()], [pack(new)], [tops], kinds=(pa.int64(), pa.binary(), pa.map_(pa.string(), pa.int64())))

        spark, path, kind = self.rows.sparkSession, shared_path(self.rows.sparkSession, "sums"), "block long, bucket int, data binary"
        asked = self.known("block").mapInArrow(send, "bucket int, block long, data binary")
        asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(add, kind).write.parquet(path)
        release_shuffles(spark, rounds=2)
        self._forget()
        new = spark.read.schema(kind).parquet(path).groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("new"))
        answers, _ = self._stored(new.mapInArrow(gather, "block long, answers binary, tops map<string,bigint>"))
        self.answers.append(answers)
        drop_path(spark, path)
        release_shuffles(spark)

    def tops(self) -> dict[str, int]:
        """The highest rank of each array that the last exchange answered with ranks."""
        return {r["key"]: r["top"] for r in self.answers[-1].select(F.explode("tops")).groupBy("key").agg(F.max("value").alias("top")).collect()}


def block_of(data: pa.Scalar, answers: pa.Scalar) -> Arrays:
    """The arrays of a block, with its answers among them."""
    return unpack(data.as_py()) | unpack(answers.as_py() or b"")
