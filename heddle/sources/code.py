"""Source files as (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.inventory import LANGUAGES, PRUNED
from heddle.sources.stores import matching


def source_files(spark: SparkSession, root: str, tracked: DataFrame | None = None) -> DataFrame:
    """(path, text) of source files below `root`, paths relative to it.

    Folders of dependencies and builds, and folders that start with a dot, are
    left out. `tracked` (path) keeps listed files alone. No such folder: no rows.
    """
    if not matching(spark, root):
        return spark.createDataFrame([], "path string, text string")
    endings = "{" + ",".join(f"*{e}" for e in LANGUAGES) + "}"
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", endings).text(root, wholetext=True)
    at = F.instr("_metadata.file_path", root.removeprefix("file://").rstrip("/") + "/")
    relative = F.expr("_metadata.file_path").substr(at + len(root.removeprefix("file://").rstrip("/")) + 1, F.lit(1 << 20))
    files = read.select(relative.alias("path"), F.col("value").alias("text"))
    pruned = "|".join(p.replace(".", r"\.") for p in PRUNED)
    files = files.where(~F.col("path").rlike(rf"(^|/)(({pruned})|\.[^/]+)/"))
    return files if tracked is None else files.join(tracked.select("path").distinct(), "path", "left_semi")
