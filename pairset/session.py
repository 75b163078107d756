"""Session helpers: a local session for tests and benchmarks, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = 8, app: str = "pairset", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is used where the cluster names one. Only a local master falls back to a
    scratch folder, because executors on other machines could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="pairset-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Spread a scan over all cores before CPU-heavy row work.

    A table of few files yields fewer tasks than there are cores. Larger tables already have more, and are
    returned as they are, without a shuffle. Meant for plain scans: the number of partitions is read from
    the plan, which must not contain a shuffle yet.

    With ``task_rows`` the rows are counted and dealt evenly into tasks of about so many, for rows that become
    large: Python gets a task's rows in Arrow batches, which are then as small.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if task_rows is not None:
        return scan.repartition(max(cores, -(-scan.count() // task_rows)))
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle by key into the configured number of partitions before CPU-heavy grouped Python work.

    An explicit number keeps adaptive execution from merging partitions by their bytes, which say little
    about the work in them; the grouped operator that follows reuses this shuffle. The key is hashed once
    more, so that the shuffle is never left out in favour of how a union below is partitioned: adaptive
    execution may merge the partitions of a union's branches differently.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, where it may not be installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pairset-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> DataFrame:
    """``mapInPandas`` with this package at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInPandas(fn, schema)
