"""Join of documents on the Jaccard similarity of their word shingles, by chosen paths.

1. Every text becomes a set of hashed five-word shingles, a digest of the set and a MinHash sketch. Documents
   with equal sets are one class, stood for by its smallest id.
2. Each run splits the classes recursively: a bucket chooses one place of the sketch, and members go to the child
   of their token there, so pairs are split on sampled shared tokens. A bucket of at most ``bucket`` members is a leaf.
   A larger one whose members are alike on average is a leaf too, because splitting would only lose links;
   it is compared in blocks of ``bucket`` members. Runs are independent. The splits of every path are counted, and
   members with a path of more than ``EXPECTED_SPLITS`` get further runs, until their number is enough for ``recall``
   at the threshold if every run had as many splits as the member's longest path.
3. Leaves are compared on sketches; members with a likely partner fetch their exact sets and are compared again.
   A pair counts in the first run whose leaf holds both, so every link counts once and no pair leaves a task:
   tasks return the number of links of a member, and a spanning forest of the links.

Documents without words have no shingles and link with nothing. A text shorter than five words is one shingle.
NULL texts are empty. Rows of one ``doc_id`` are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.llm import graph, shingles
from pairset.llm.common import shuffle_partitions, stored, whole_text
from pairset.session import ship

#: Splits that the first runs are planned for; members that go through more get further runs.
EXPECTED_SPLITS = 2
#: Places of the sketch that tell how alike a large bucket is, and the similarity from which it is not split.
PROBES = 8
ALIKE = 0.3


def runs_for(threshold: float, recall: float, splits: int = EXPECTED_SPLITS) -> int:
    """Independent runs of ``splits`` splits after which a pair at the threshold has met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**splits))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests, sizes, values = [], [], [], []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            s = shingles.shingle_set(text.as_py())
            if len(s):
                ids.append(doc_id)
                digests.append(shingles.digest(s))
                sizes.append(len(s))
                values.append(shingles.sketch(s).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(values, pa.list_(pa.int32()))],
            ["doc_id", "digest", "size", "sketch"],
        )


def _child(key: Column) -> Column:
    """The child that a bucket's chosen place of the sketch leads to."""
    return F.xxhash64(key, F.element_at("sketch", (F.pmod(key, F.lit(shingles.SKETCH)) + 1).cast("int")))


def _leaves(classes: DataFrame, runs: range, bucket: int, depth: int) -> DataFrame:
    """``node``, ``run``, ``key``, ``members`` and ``splits`` of every leaf with at least two members, and of those with
    one that lie deeper than ``EXPECTED_SPLITS``."""
    narrow = classes.select("node", "sketch")
    rows = narrow.select("node", F.explode(F.transform(F.sequence(F.lit(runs.start), F.lit(runs.stop - 1)), lambda r: F.struct(
        r.alias("run"), F.xxhash64(F.xxhash64(r), F.element_at("sketch", (F.pmod(F.xxhash64(r), F.lit(shingles.SKETCH)) + 1).cast("int"))).alias("key"),
    ))).alias("x")).select("node", "x.run", "x.key")
    found = None
    for level in range(1, depth + 1):
        rows = stored(rows, "paths")
        members = rows.groupBy("run", "key").agg(F.count("*").alias("members"))
        if level <= EXPECTED_SPLITS:
            members = members.where("members > 1")
        sized = stored(rows.join(members, ["run", "key"]).withColumn("splits", F.lit(level)), "buckets")
        small = sized.where(F.col("members") <= bucket)
        found = small if found is None else found.unionByName(small)
        large = sized.where(F.col("members") > bucket)
        if large.isEmpty():
            return found
        large = stored(large.join(narrow, "node"), "large")
        probes = large.select("run", "key", "members", F.posexplode(F.slice("sketch", 1, PROBES)).alias("place", "token"))
        same = probes.groupBy("run", "key", "members", "place", "token").agg(F.count("*").alias("n"))
        alike = same.groupBy("run", "key").agg(
            (F.sum(F.col("n") * (F.col("n") - 1)) / (PROBES * F.max("members") * (F.max("members") - 1))).alias("alike"),
        )
        judged = large.join(alike, ["run", "key"])
        stays = F.col("alike") >= ALIKE if level < depth else F.lit(True)
        found = found.unionByName(judged.where(stays).select(found.columns))
        rows = judged.where(~stays).select("node", "run", _child(F.col("key")).alias("key"))
    return found


def _all_leaves(classes: DataFrame, threshold: float, recall: float, bucket: int, depth: int) -> DataFrame:
    """``_leaves`` of all runs: those for ``EXPECTED_SPLITS``, and further ones for members on longer paths."""
    found, members, done = None, classes, 0
    for splits in range(EXPECTED_SPLITS, max(depth, EXPECTED_SPLITS) + 1):
        runs = range(done, runs_for(threshold, recall, splits))
        leaves = stored(_leaves(members, runs, bucket, depth).withColumn("leaf", F.xxhash64("run", "key")), "leaves")
        found, done = leaves if found is None else found.unionByName(leaves), runs.stop
        deep = stored(found.where(F.col("splits") > splits).select("node").distinct(), "deep")
        if deep.isEmpty():
            break
        members = stored(classes.join(deep, "node"), "members")
    return found.where("members > 1")


def _blocks(leaves: DataFrame, bucket: int) -> DataFrame:
    """Rows dealt to pairs of blocks: a leaf beyond ``bucket`` members is compared block by block."""
    n = F.ceil(F.col("members") / bucket)
    own = F.pmod(F.xxhash64("node"), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda o: F.struct(F.least(own, o).alias("low"), F.greatest(own, o).alias("high")))
    return leaves.withColumn("own", own).withColumn("block", F.explode(pairs)).withColumns({
        "task": F.xxhash64("run", "key", "block.low", "block.high"), "low": F.col("block.low"), "high": F.col("block.high"),
    }).drop("block")


class _Group:
    """The rows of one task key as arrays."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        self.node = table["node"].to_numpy()
        self.own, self.low, self.high = table["own"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
        self.run = table["run"][0].as_py()
        n = len(table)
        self.sketch = table["sketch"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        self.leaves = table["leaves"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.size = table["size"].to_numpy()

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(self.own == self.low)
        return left, left if self.low == self.high else np.flatnonzero(self.own == self.high)

    def likely(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may reach the threshold and first meet in this run, as row numbers."""
        left, right = self.sides()
        if not len(left) or not len(right):
            return np.zeros(0, int), np.zeros(0, int)
        need = _least_equal(threshold)
        found = []
        for at in range(0, len(left), 128):
            part = left[at: at + 128]
            equal = np.zeros((len(part), len(right)), np.int16)
            for k in range(self.sketch.shape[1]):
                equal += self.sketch[part, k][:, None] == self.sketch[right, k]
            ok = equal >= need
            big, small = np.maximum(self.size[part][:, None], self.size[right]), np.minimum(self.size[part][:, None], self.size[right])
            ok &= small >= threshold * big
            for r in range(self.run):
                ok &= (self.leaves[part, r][:, None] != self.leaves[right, r]) | (self.leaves[part, r] == 0)[:, None]
            if self.low == self.high:
                ok &= self.node[part][:, None] < self.node[right]
            else:
                ok &= self.node[part][:, None] != self.node[right]
            i, j = np.nonzero(ok)
            found.append((part[i], right[j]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _least_equal(threshold: float) -> int:
    """Equal sketch values below which a pair at the threshold is less likely than about one in 100,000."""
    n = shingles.SKETCH
    return max(1, math.floor(n * threshold - 4.5 * math.sqrt(n * threshold * (1 - threshold))))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by ``key``; holds one group and one batch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch[key].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if kept and kept[-1][key][0].as_py() != keys[a]:
                yield pa.Table.from_batches(kept)
                kept = []
            if b > a:
                kept.append(part)
    if kept:
        yield pa.Table.from_batches(kept)


def _hopeful(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "task"):
            if len(table) > 1:
                i, j = _Group(table).likely(threshold)
                if len(i):
                    yield from table.take(pa.array(np.unique(np.concatenate([i, j])))).to_batches()

    return run


def _exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold by their whole sets."""
    sizes = np.array([len(s) for s in sets])
    shared = np.zeros(len(i), np.int64)
    if len(i) < 64:
        for k, (a, b) in enumerate(zip(i, j, strict=True)):
            shared[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:  # products of 0/1 matrices over the shingles that more than one set has
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts > 1)
        rank = np.full(len(counts), -1)
        rank[again] = np.arange(len(again))
        column = rank[column]
        product = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(again), 8192):
            inside = (column >= at) & (column < at + 8192)
            part = np.zeros((len(sets), min(8192, len(again) - at)), np.float32)
            part[owners[inside], column[inside] - at] = 1
            product += part @ part.T
        shared = product[i, j].astype(np.int64)
    return shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node of the pairs, the smallest one it reaches through them."""
    least = nodes.copy()
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (least == before).all():
            return least


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "task"):
            group = _Group(table)
            i, j = group.likely(threshold)
            if not len(i):
                continue
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["hashes"]]
            ok = _exact(sets, i, j, threshold)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            copies = table["copies"].to_numpy()
            links = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
            at = np.flatnonzero(links)
            least = _forest(group.node, i, j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.node[at]), pa.array(links[at].astype(np.int64)), pa.array(least[at])], ["node", "links", "least"],
            )

    return run


def _shingle_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles.shingle_set(t.as_py()).tobytes() for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], ["node", "hashes"])


def join(docs: DataFrame, *, threshold: float = 0.8, recall: float = 0.9995, bucket: int = 500, depth: int = 8) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id reachable by links, itself included), ``n_links`` (documents linked
    directly, copies included) and ``kept`` (``doc_id = class_id``), one row per document."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sketched = stored(texts.mapInArrow(_sketches, "doc_id long, digest binary, size int, sketch array<int>"), "sketches")
    classes = stored(
        sketched.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"),
        ), "classes",
    )
    rows = _all_leaves(classes, threshold, recall, bucket, depth)
    per_node = rows.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("run", "leaf"))).alias("by_run"))
    whole = rows.select("node", "run", "key", "members").join(per_node.join(classes.drop("digest"), "node"), "node")
    earlier = F.transform(F.sequence(F.lit(0), F.col("run") - 1), lambda r: F.coalesce(F.element_at("by_run", r), F.lit(0).cast("long")))
    whole = whole.withColumn("leaves", F.when(F.col("run") > 0, earlier).otherwise(F.array().cast("array<long>"))).drop("by_run")
    dealt = _blocks(whole, bucket)
    columns = ["task", "node", "run", "own", "low", "high", "size", "copies", "sketch", "leaves"]
    n = shuffle_partitions(spark)
    dealt = dealt.select(columns).repartition(n, "task").sortWithinPartitions("task")
    hopeful = stored(dealt.mapInArrow(_hopeful(threshold), dealt.schema), "hopeful")
    wanted = hopeful.select("node").distinct()
    # joins with whole texts have one plan at every size: what a small run costs tells what a large one will
    sets = texts.withColumnRenamed("doc_id", "node").join(wanted.hint("merge"), "node").mapInArrow(_shingle_bytes, "node long, hashes binary")
    checked = hopeful.join(sets, "node").select(*columns, "hashes").repartition(n, "task").sortWithinPartitions("task")
    links = stored(checked.mapInArrow(_verified(threshold), "node long, links long, least long"), "verified")
    found = graph.components(links.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.select("digest", "node", "copies").join(counts, "node", "left").join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    members = sketched.select("doc_id", "digest").join(by_class, "digest").select("doc_id", "class_id", "n_links")
    wordless = docs.select(F.col("doc_id").cast("long").alias("doc_id")).select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
    )
    return (
        members.unionByName(wordless).groupBy("doc_id")
        .agg(F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"), F.max("n_links").alias("n_links"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    )


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, each id and text once. Rows without an id are in no class and stay."""
    kept = joined.where("kept").select(F.col("doc_id").alias("__kept"))
    rows = docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
    return rows.withColumn("__text", F.md5(whole_text().cast("binary"))).dropDuplicates(["doc_id", "__text"]).drop("__text")


def without_near_duplicates(docs: DataFrame, **settings: float) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, the one of the smallest id.

    A document is an id and a text, whose 64-bit key stands for it in the join. So different texts of one id, and texts without an id,
    are compared like all others and stay where they are near-duplicates of nothing; rows equal in both are one document.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", whole_text()))
    joined = join(keyed.select(F.col("__key").alias("doc_id"), "text"), **settings)
    classes = joined.select(F.col("doc_id").alias("__key"), "class_id")
    ids = keyed.select("__key", "doc_id").distinct()
    kept = ids.join(classes, "__key").groupBy("class_id").agg(
        F.min_by("__key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("__kept"),
    ).select("__kept")
    rows = keyed.join(kept.hint("merge"), F.col("__key") == F.col("__kept"), "left_semi")
    return rows.dropDuplicates(["__key"]).drop("__key")
