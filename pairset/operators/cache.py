"""A cache of rows by key that stays cheap as it grows.

Rows are appended to ``<path>/rows/version=<v>/bucket=<b>``, the bucket being the id's hash, so a lookup of some ids reads the
folders of their buckets only. Many appends leave many small files and repeated attempts: ``compact`` writes one sorted file set
with the rows worth keeping as the next version, and then publishes it by appending one row to ``<path>/published``. Readers use
the last published version, so a compaction that dies changes nothing, and what it left behind is overwritten by the next one.
The number of buckets is published with the cache and holds for its life. One writer at a time; rows appended while a compaction
of another writer runs would be missing in its version. Versions before the published one may be removed by the owner.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairset.sources.versions import announce, last_published, read_or_empty

BUCKETS = 64
_BUCKET = "bucket"


class KeyedCache:
    """The cache at ``path`` with rows of ``schema``, keyed by ``id_col``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, id_col: str = "id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.id_col = spark, path, schema, id_col
        last = last_published(spark, path)
        self.version, self.buckets, self.fresh = (last["version"], int(last["detail"]), False) if last else (0, buckets, True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.id_col)), F.lit(self.buckets)).cast("int")

    def _folder(self, version: int) -> str:
        return f"{self.path}/rows/version={version}"

    def _publish(self, version: int) -> None:
        announce(self.spark, self.path, version, str(self.buckets))
        self.version, self.fresh = version, False

    def rows(self, ids: DataFrame | None = None) -> DataFrame:
        """All rows, or those in the buckets of the given ids: at most as many numbers as there are buckets reach the driver."""
        stored = T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        found = read_or_empty(self.spark, self._folder(self.version), stored)
        if ids is not None:
            wanted = [r[0] for r in ids.select(self._bucket()).distinct().collect()]
            found = found.where(F.col(_BUCKET).isin(wanted)) if wanted else found.limit(0)
        return found.drop(_BUCKET)

    def append(self, rows: DataFrame) -> None:
        """Add rows to the published version, by Spark's own task commit."""
        if self.fresh:
            self._publish(0)
        self._write(rows, self.version, "append")

    def compact(self, keep: Callable[[DataFrame], DataFrame]) -> None:
        """Write what ``keep`` leaves of all rows as the next version, one file per bucket and task, and publish it."""
        if self.fresh:
            return
        self._write(keep(self.rows()), self.version + 1, "overwrite")
        self._publish(self.version + 1)

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        placed = rows.select([f.name for f in self.schema.fields]).withColumn(_BUCKET, self._bucket())
        # bucket and hash together, so that a bucket is not bound to one task when there are more tasks than buckets
        spread = F.pmod(F.xxhash64(F.col(self.id_col), F.lit(1)), F.lit(max(1, self._tasks() // self.buckets)))
        placed.repartition(self._tasks(), _BUCKET, spread).write.mode(mode).partitionBy(_BUCKET).parquet(self._folder(version))

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))
