"""Training-order materialisation of token ids into fixed-stride shards.

Token ids are little-endian numbers of ``width`` bytes. A row's ids and an end marker follow one another in stored order
and are cut into sequences of ``length`` ids; the last one is filled up with a padding id. Every sequence has a
global slot, its place in training order, by a keyed permutation of ``0..n-1``: a Feistel network over the next even
number of bits, walked along its cycle until it falls below ``n``. A shard holds ``per_shard`` slots, in
order, as records of ``length * width`` bytes and a two-byte terminator, so slot ``s`` starts at byte
``(s % per_shard) * stride`` of shard ``s // per_shard``: readers go on from any slot with one seek.

Two passes read the table. The first counts ids per partition, which fixes where each begins; the second, which fails if its own count
differs, sends pieces of sequences to their shards by number. Every task holds one batch. Shards
are written by Spark's file commit as ``part-N-*``, so a retried task leaves no double.

Rows with NULL or empty tokens give an end marker only. Repeated rows give repeated sequences. An empty table gives no shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.llm.common import mixed, stored
from pairset.session import ship

TERMINATOR = "\n\n"


@dataclass(frozen=True)
class Layout:
    """How ids are laid out; ``end`` and ``pad`` are ids."""

    width: int = 1
    length: int = 4_096
    per_shard: int = 4_096
    end: int = 0xFF
    pad: int = 0xFE
    key: int = 20_260_101
    rounds: int = 6

    @property
    def stride(self) -> int:
        return self.length * self.width + len(TERMINATOR)


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int) -> np.ndarray:
    """A keyed permutation of ``0..n-1``, by cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(rounds, dtype=np.uint64) + np.uint64(key % (1 << 63)))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes as ids: 0xFF and 0xFE never stand in UTF-8, so they are free for end and padding."""
    return F.coalesce(text, F.lit("")).cast("binary")


def _counts(rows: DataFrame, layout: Layout) -> list[tuple[int, int, int]]:
    """Partition, its first id and its number of ids: one row per partition of the scan."""
    per_row = F.coalesce(F.octet_length("tokens"), F.lit(0)) / layout.width + 1
    counted = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(per_row.cast("long")).alias("n")).orderBy("part").collect()
    out, total = [], 0
    for r in counted:
        out.append((r.part, total, r.n))
        total += r.n
    return out


def _pieces(layout: Layout, starts: dict[int, tuple[int, int]], n: int, bytes_too: bool):
    """Pieces of sequences: slot, first id within the sequence, row id, place in the row, number of ids, bytes."""
    unit, end = layout.width, layout.end.to_bytes(layout.width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = None
        for batch in batches:
            if not len(batch):
                continue
            part = batch["part"][0].as_py()
            if at is None:
                at, last = starts[part][0], sum(starts[part])
            rows: list[tuple] = []
            sizes = batch["n"].to_numpy() + 1
            texts = batch["tokens"] if bytes_too else None
            for k, (row, size) in enumerate(zip(batch["doc_id"].to_pylist(), sizes.tolist(), strict=True)):
                raw = memoryview((texts[k].as_py() or b"") + end) if bytes_too else None
                done = 0
                while done < size:
                    sequence, offset = divmod(at, layout.length)
                    take = min(layout.length - offset, size - done)
                    rows.append((sequence, offset, row, done, take, bytes(raw[done * unit: (done + take) * unit]) if bytes_too else None))
                    at, done = at + take, done + take
            if at > last:
                raise RuntimeError("the table has changed between the passes")
            columns = list(zip(*rows, strict=True))
            slots = permuted(np.array(columns[0]), n, layout.key, layout.rounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]],
                ["slot", "sequence", "offset", "doc_id", "start", "size", "tokens"],
            )
        if at != last:
            raise RuntimeError("the table has changed between the passes")

    return run


_PIECE = "slot long, sequence long, offset int, doc_id long, start long, size int, tokens binary"


def _records(layout: Layout):
    """Whole records from pieces that are sorted by slot and offset."""
    pad = layout.pad.to_bytes(layout.width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = None, []

        def closed() -> bytes:
            raw = b"".join(parts)
            return raw + pad * (layout.length - len(raw) // layout.width)

        for batch in batches:
            slots, records = [], []
            for s, piece in zip(batch["slot"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                if s != slot and slot is not None:
                    slots.append(slot)
                    records.append(closed())
                    parts = []
                slot = s
                parts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(records, pa.binary())], ["slot", "record"])
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([closed()], pa.binary())], ["slot", "record"])

    return run


@dataclass
class Shards:
    """Written shards: where they are, how many sequences, and which row stands where."""

    path: str
    layout: Layout
    sequences: int
    segments: DataFrame | None


def write(rows: DataFrame, path: str, layout: Layout | None = None) -> Shards:
    """Write ``rows`` (``doc_id``, ``tokens``) in training order below ``path``. ``rows`` must be a stored table or a
    projection of one, read alike in both passes."""
    layout = layout or Layout()
    spark = rows.sparkSession
    ship(spark)
    counts = _counts(rows, layout)
    total = sum(n for _, _, n in counts)
    n = -(-total // layout.length)
    if not n:
        return Shards(path, layout, 0, None)
    starts = spark.sparkContext.broadcast({part: (first, size) for part, first, size in counts}).value  # one entry per partition
    keyed = rows.select(
        F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "tokens",
        (F.coalesce(F.octet_length("tokens"), F.lit(0)) / layout.width).cast("long").alias("n"),
    )
    pieces = keyed.mapInArrow(_pieces(layout, starts, n, True), _PIECE).select("slot", "offset", "tokens")
    shard = F.floor(F.col("slot") / layout.per_shard).cast("int")
    shards = -(-n // layout.per_shard)
    records = pieces.repartitionById(shards, shard).sortWithinPartitions("slot", "offset").mapInArrow(_records(layout), "slot long, record binary")
    # partition k holds shard k, so Spark names its file part-k
    records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).option("lineSep", TERMINATOR).text(path)
    segments = keyed.drop("tokens").mapInArrow(_pieces(layout, starts, n, False), _PIECE).drop("tokens")
    return Shards(path, layout, n, segments)


def _cut(layout: Layout):
    """Shard files cut into their records, some hundred at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, stride = layout.length * layout.width, layout.stride
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"], strict=True):
                held = memoryview(content.as_buffer())
                for at in range(0, len(held) // stride, 512):
                    places = range(at, min(at + 512, len(held) // stride))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard * layout.per_shard + k for k in places], pa.int64()), pa.array([shard] * len(places), pa.int32()),
                        pa.array([k * stride for k in places], pa.int64()), pa.array([bytes(held[k * stride: k * stride + size]) for k in places], pa.binary()),
                    ], ["slot", "shard", "offset", "record"])

    return run


def read(spark: SparkSession, shards: Shards) -> DataFrame:
    """``slot``, ``shard``, ``offset`` (byte) and ``record`` (ids as bytes) of all shards; a task holds one shard."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(shards.path)
    rows = files.select(F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("int").alias("shard"), "content")
    return rows.mapInArrow(_cut(shards.layout), "slot long, shard int, offset long, record binary")


def described(spark: SparkSession, shards: Shards) -> DataFrame:
    """One row per slot: what stands in the shards, and the rows it came from."""
    size = shards.layout.length * shards.layout.width
    stored_records = read(spark, shards).select("slot", "shard", "offset", F.sha2("record", 256).alias("sha256"), (F.octet_length("record") == size).alias("whole"))
    rows = shards.segments.groupBy("slot", "sequence").agg(
        F.sum("size").cast("long").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "size"))).alias("segments"),
    )
    return stored_records.join(stored(rows, "segments"), "slot")
