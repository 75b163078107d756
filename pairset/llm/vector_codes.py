"""Vector code compression: product codes, assigned through memoised grid cells.

Components become integers, vectors are cut into equal parts, and each part position has a codebook, which starts as that part
of the vectors of the smallest ids and is moved to the floored means of its parts in a fixed number of rounds. A part is
assigned to its nearest entry (squared Euclidean distance, ties to the lower index) by way of a grid: its coarse cell is
hashed, and the memo holds for every cell the entries that are not dominated across the cell's box, that is whose least
distance to the box is not above the smallest of all entries' greatest distances. Only those are evaluated, exactly, so the
memo changes no result. It belongs to one task and starts afresh when ``memo_cells`` cells are in it.

A round is one pass over the table: tasks sum the parts of each entry, and one row per task, position and entry is shuffled.
The driver holds the codebooks only (entries times dimensions). Nothing else is collected, and the table may be of any size.

Vectors that are NULL or hold NULL or non-finite components are left out. All kept vectors are taken as long as the longest
of them, rounded up to whole parts, with zeros at the end. Integers are held within 2**26 of zero, so that squares and sums are
exact. Of rows with one id all are kept, and smaller vectors come first; rows without an id get a code and never start an entry.
Fewer kept vectors than ``entries`` give shorter codebooks, none an empty result. Further columns are not read but for ``label``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.llm.common import shuffle_partitions, stored
from pairset.session import ship

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256.0
LIMIT = 1 << 26
#: Width of a cell of the grid, cells in a task's memo, and (part, entry) pairs that are evaluated at a time.
CELL, MEMO_CELLS, PAIRS = 32, 200_000, 1 << 20


def usable(embedding: Column) -> Column:
    """Neither NULL nor with a component that is NULL, NaN or infinite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~bad


def integers(values: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as rows of ``width`` integers, zeros after their end."""
    flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    flat = np.clip(flat, -LIMIT, LIMIT).astype(np.int64)
    lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(values), width)
    rows = np.zeros((len(values), width), np.int64)
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


class Grid:
    """The codebook of one part position with its memo of cells."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, memo_cells: int = MEMO_CELLS) -> None:
        self.entries, self.cell, self.memo_cells = entries, cell, memo_cells
        self.memo: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell, the entries that may be nearest to a point of its box, ascending."""
        found = []
        step = max(1, PAIRS // max(1, self.entries.size))
        for k in range(0, len(cells), step):
            low = cells[k:k + step, None, :] * self.cell
            high = low + self.cell - 1
            least = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
            most = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
            least, most = (least * least).sum(2), (most * most).sum(2)
            open_ = least <= most.min(1)[:, None]
            found += [np.flatnonzero(row) for row in open_]
        return found

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index and the squared distance of the nearest entry of every point."""
        cells = np.ascontiguousarray(points // self.cell)
        keys, first, which = np.unique(cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)
        names = [k.tobytes() for k in keys]
        if len(self.memo) + len(names) > self.memo_cells:
            self.memo.clear()
        new = [i for i, name in enumerate(names) if name not in self.memo]
        self.memo.update(zip([names[i] for i in new], self.undominated(cells[first[new]]), strict=True))
        lists = [self.memo[name] for name in names]
        counts = np.array([len(entries) for entries in lists], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        listed = np.concatenate(lists)
        index, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        ends = np.cumsum(counts[which])
        done = 0
        while done < len(points):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + PAIRS // max(1, points.shape[1]), "right")))
            own = which[done:upto]
            n = counts[own]
            begin = np.cumsum(n) - n
            candidates = listed[np.repeat(starts[own] - begin, n) + np.arange(n.sum())]
            gap = np.repeat(points[done:upto], n, axis=0) - self.entries[candidates]
            # distance and index in one number would not fit; the first of the smallest has the lowest index
            far = (gap * gap).sum(1)
            best = np.minimum.reduceat(far, begin)
            at = np.flatnonzero(far == np.repeat(best, n))
            chosen = at[np.searchsorted(at, begin)]
            index[done:upto], distance[done:upto] = candidates[chosen], best
            done = upto
        return index, distance


def _split(rows: np.ndarray, parts: int) -> np.ndarray:
    """Parts first: (parts, rows, width of a part)."""
    return np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def _summed(books: np.ndarray, width: int, **grid: int):
    """Counts and sums of the parts of every entry, one row per position and entry that a task has met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book, **grid) for book in books]
        counts = np.zeros(books.shape[:2], np.int64)
        sums = np.zeros(books.shape, np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for p, points in enumerate(_split(integers(batch.column(0), width), len(books))):
                index, _ = grids[p].assign(points)
                counts[p] += np.bincount(index, minlength=books.shape[1])
                np.add.at(sums[p], index, points)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray, width: int, **grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book, **grid) for book in books]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            split = _split(integers(batch.column(0), width), len(books))
            found = [g.assign(points) for g, points in zip(grids, split, strict=True)]
            codes = np.stack([index for index, _ in found], axis=1)
            error = np.sum([distance for _, distance in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(["".join([f"{c:02x}" for c in row]) for row in codes.tolist()]), pa.array(error)],
                ["vec_id", "label", "code", "error"])

    return run


def kept(vectors: DataFrame) -> DataFrame:
    return vectors.where(usable(F.col("embedding")))


def first_codebooks(vectors: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids: (parts, entries, width of a part)."""
    first = kept(vectors).where("vec_id IS NOT NULL").select("embedding", "vec_id").orderBy("vec_id", "embedding").limit(entries)
    rows = [r["embedding"] for r in first.collect()]
    return _split(integers(pa.array(rows, pa.list_(pa.float64())), width), parts) if rows else np.zeros((parts, 0, width // parts), np.int64)


def moved(vectors: DataFrame, books: np.ndarray, **grid: int) -> np.ndarray:
    """Codebooks after a round: every used entry at the floored mean of its parts."""
    width = books.shape[0] * books.shape[2]
    sums = kept(vectors).select("embedding").mapInArrow(_summed(books, width, **grid), "part int, entry int, n long, sums array<long>")
    at = sums.select("part", "entry", "n", F.posexplode("sums").alias("k", "s"))
    rows = at.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"], r["k"]] = r["s"] // r["n"]
    return out


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **grid: int,
) -> np.ndarray:
    """The codebooks of a table of ``vec_id`` and ``embedding``: (parts, entries, width of a part)."""
    ship(vectors.sparkSession)
    longest = kept(vectors).agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    books = first_codebooks(vectors, width, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(vectors, books, **grid)
    return books


def encode(vectors: DataFrame, books: np.ndarray, **grid: int) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits per part) and ``error`` of every kept row."""
    if not books.size:
        return vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    ship(vectors.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return kept(vectors).select("embedding", "vec_id", "label").mapInArrow(
        _coded(books, books.shape[0] * books.shape[2], **grid),
        f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def with_group_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of one ``key``, NULLs together; NULL where it is beyond a long.

    Sums are made before the shuffle and joined back by key. Keys with more rows than an average partition, at most as many as
    there are partitions, are marked by a broadcast of them, and their rows are dealt to all partitions.
    """
    parts = shuffle_partitions(rows.sparkSession)
    sums = stored(rows.groupBy(key).agg(F.count("*").alias("__n"), F.sum(F.col(value).cast("decimal(38,0)")).alias("__sum")), "group-sums")
    total = sums.agg(F.sum("__n")).first()[0] or 0
    sums = sums.select(F.col(key).alias("__key"), (F.col("__n") * parts > total).alias("__hot"), F.expr("try_cast(__sum AS bigint)").alias(out))
    hot = F.broadcast(sums.where("__hot").select("__key", "__hot"))
    salted = rows.join(hot, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(parts))).otherwise(0).cast("int")).drop("__hot")
    dealt = sums.withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    dealt = dealt.withColumnRenamed("__salt", "__at").hint("merge")
    return salted.join(dealt, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__at"))).drop("__key", "__at", "__salt")


def compress(vectors: DataFrame, **settings: int) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept row."""
    grid = {k: settings.pop(k) for k in ("cell", "memo_cells") if k in settings}
    books = train(vectors, **settings, **grid)
    coded = stored(encode(vectors, books, **grid), "codes")
    return with_group_sum(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, table: str = "embeddings") -> str:
    """The same codes in DuckDB's SQL, every entry evaluated; for vectors of one length that is a multiple of ``parts``."""
    steps = [f"""
    kept AS (
      SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS place,
             list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM {table}
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    part AS (
      SELECT vec_id, label, place, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x
      FROM kept, range({parts}) AS r(p)),
    book0 AS (SELECT p, place AS e, x AS c FROM part WHERE place < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
    near{k} AS (
      SELECT vec_id, any_value(label) AS label, part.p, any_value(x) AS x,
             min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best
      FROM part JOIN book{k} USING (p) GROUP BY vec_id, part.p)""")
        if k < rounds:
            steps.append(f"""
    mean{k} AS (
      SELECT p, e, list(m ORDER BY i) AS c FROM (
        SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
        FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM part)) AS r(i) GROUP BY p, best.e, i) GROUP BY p, e),
    book{k + 1} AS (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))""")
    return f"""
    WITH {','.join(steps)},
    code AS (
      SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code,
             CAST(sum(best.d) AS BIGINT) AS error
      FROM near{rounds} GROUP BY vec_id),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM code, digest"""
