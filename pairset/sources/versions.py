"""Publishing in two phases: a version is written aside, then one row appended to ``<path>/published`` makes it the current one.

A reader takes the folder of the last published version, so it sees all tables of one version or all of the one before, and a
writer that dies half-way changes nothing: its folder is written over by the next version. One writer at a time. Folders of
earlier versions stay for readers that are still on them; the owner of the path removes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_PUBLISHED = "version int, detail string"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a folder, or an empty table of the same schema before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def last_published(spark: SparkSession, path: str) -> Row | None:
    """``version`` and ``detail`` of the current version, None before the first one."""
    return read_or_empty(spark, f"{path}/published", _PUBLISHED).orderBy(F.col("version").desc()).first()


def announce(spark: SparkSession, path: str, version: int, detail: str = "") -> None:
    """Make a written version the current one: one file, which Spark's committer renames into place."""
    spark.createDataFrame([(version, detail)], _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{path}/published")


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> int:
    """Let ``write`` write all tables of the next version below the folder that it is given, then announce it."""
    last = last_published(spark, path)
    version = last["version"] + 1 if last else 0
    write(f"{path}/version={version}")
    announce(spark, path, version)
    return version


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version."""
    last = last_published(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return f"{path}/version={last['version']}"
