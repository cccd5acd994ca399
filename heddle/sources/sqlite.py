"""A Spark data source for a table of a SQLite file, and the choice of a state database."""

from __future__ import annotations

import logging
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

THREADS = "id string, rollout_path string, title string, first_user_message string, cwd string, created_at long, updated_at long, created_at_ms long, updated_at_ms long"


class SQLiteReader(DataSourceReader):
    """One read-only scan; columns that the table lacks are null, an unreadable file has no rows, and a note in the log."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path, self.table = schema.names, options["path"], options["table"]

    def read(self, partition) -> Iterator[tuple]:
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        try:
            with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
                have = {r[1] for r in db.execute(f"PRAGMA table_info({quoted(self.table)})")}
                if have:
                    yield from db.execute(f"SELECT {', '.join(quoted(n) if n in have else 'NULL' for n in self.names)} FROM {quoted(self.table)}")
        except sqlite3.Error as e:
            logging.getLogger(__name__).warning("%s can't be read, it gives no rows: %s", self.path, e)


class SQLiteSource(DataSource):
    """spark.read.format("sqlite_table").schema(...).option("table", ...).load(path); the path is a file that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return THREADS

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(schema, self.options)


def read_table(spark: SparkSession, path: str | None, table: str = "threads", schema: str = THREADS) -> DataFrame:
    """Rows of a table; none without a database."""
    if path is None:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite_table").schema(schema).option("table", table).option("path", path).load()


def newest_state(names: list[str]) -> str | None:
    """Of a folder's file names the state database with the highest number, else the one without, else none."""
    numbered = {int(m[1]): n for n in names if (m := re.fullmatch(r"state_(\d+)\.sqlite", n))}
    return numbered[max(numbered)] if numbered else "state.sqlite" if "state.sqlite" in names else None
