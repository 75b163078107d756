"""Readers and writers. Every reader takes an explicit schema; ids are text from the first byte on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairset.schema import IMAGE_TABLE, PAIR_INDEX, SAMPLE_STATS, without_nan


def read_index(spark: SparkSession, path: str, schema: T.StructType = PAIR_INDEX) -> DataFrame:
    return without_nan(spark.read.schema(schema).parquet(path))


def read_stats(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_STATS) -> DataFrame:
    return without_nan(spark.read.schema(schema).parquet(path))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV manifest with a header; columns are matched by name, absent ones fail."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return without_nan(rows)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file they come from as ``run``."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("run"))


def read_metadata(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON documents, one per file, or one per line without ``multi_line``."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_metadata(df: DataFrame, path: str) -> None:
    """A summary of one row, or of one row per group, as JSON lines; a global aggregate is one file as it is."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded images as RGB rows, and the files that could not be decoded.

    The JVM decoder yields blue-green-red bytes; channels are put in red-green-blue order per row, grey
    images get three equal channels and an alpha channel is dropped. The id is the file name without type.
    """
    from pairset.operators.incremental import map_rows, split_outcome
    from pairset.operators import pixels
    import numpy as np

    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    stem = F.regexp_extract("origin", r"([^/]+?)(\.[^./]*)?$", 1)
    named = raw.withColumn("id", stem)
    fields = [f for f in IMAGE_TABLE.fields if f.name != "id"]

    def to_rgb(row: dict) -> dict:
        if row["height"] < 0:
            raise ValueError(f"cannot decode {row['origin']}")
        shape = (int(row["height"]), int(row["width"]), int(row["nChannels"]))
        a = pixels.raster(row["data"], shape)
        a = np.repeat(a, 3, axis=2) if shape[2] == 1 else a[..., 2::-1]
        return {"height": shape[0], "width": shape[1], "data": np.ascontiguousarray(a).tobytes()}

    good, bad = split_outcome(map_rows(named, to_rgb, T.StructType(fields), ["id", "origin"]))
    return good.select("id", "height", "width", "data"), bad.select("id", "origin", "error")


def write_splits(labelled: DataFrame, path: str) -> None:
    """A split table, one folder per part, so that reading one part opens its files only."""
    write_table(labelled, path, partition_by="part")
