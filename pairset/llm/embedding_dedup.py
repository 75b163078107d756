"""Near-dedup of embeddings by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors of one label are one class. A label's classes are split into shards around medoids until a shard
   holds at most ``shard`` classes; a class goes to its nearest medoid, and to every other one within ``slack`` degrees
   of that, so shards overlap. A shard that does not come apart, because nearly all of it would go several
   ways, is dealt to pairs of blocks instead.
2. Each shard gives a flat graph: robust pruning keeps at most ``degree`` neighbours that are not closer to
   one another than to the class by the factor ``alpha``. Adjacency lists are united over the shards.
3. Every class is searched from the medoid of each of its shards: greedily with a beam until the neighbourhood is
   reached, then outwards through all neighbours within the range. Pairs are verified by cosine in double precision.
   A pair counts in the first task that holds both, so that no pair leaves a task.
4. The recall is audited by brute force: the mean share of links found, over the classes that have links, in a sample
   by hash that grows with the root of the table, and fourfold while it holds none. Below ``target`` the graph is built
   again with twice the slack and beam; where that is not enough, all pairs of a label are compared in blocks.

Rows whose label or vector is NULL, or whose vector is zero, empty or holds NULL or non-finite numbers, link with
nothing, and neither do vectors of different length. Repeated ids count as one vector where they are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pairset.llm import graph
from pairset.llm.common import shuffle_partitions, stored
from pairset.llm.ngram_join import _forest, grouped
from pairset.session import ship

MEDOIDS = 16
LEVELS = 6
#: A shard of which more than this share would go to several medoids does not come apart.
INSEPARABLE = 0.9
BUILDS = 4
_EPS = 1e-12


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    shard: int = 2_000
    degree: int = 16
    alpha: float = 1.2
    slack: float = 3.0
    beam: int = 24


def classes_of(vectors: DataFrame) -> DataFrame:
    """``label``, ``embedding``, ``node`` (smallest id), ``copies`` and ``unit`` (float64 bytes) of comparable vectors."""

    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where("label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND vec_id IS NOT NULL").where(finite)
    usable = usable.where(F.exists("embedding", lambda x: x != 0))
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))
    return stored(classes.mapInArrow(_units, "label bigint, embedding array<float>, node long, copies long, unit binary"), "classes")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = []
        for v in batch["embedding"]:
            x = np.array(v.as_py(), np.float64)
            x /= np.abs(x).max()
            units.append((x / np.linalg.norm(x)).tobytes())
        yield batch.append_column("unit", pa.array(units, pa.binary()))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _nearest(slack: float):
    """Which of a shard's medoids a class goes to: the nearest, and all others within ``slack`` degrees of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            choices = []
            for unit, medoids in zip(batch["unit"], batch["medoids"], strict=True):
                x = np.frombuffer(unit.as_py(), np.float64)
                angles = np.degrees(np.arccos(np.clip(np.frombuffer(b"".join(medoids.as_py()), np.float64).reshape(-1, len(x)) @ x, -1, 1)))
                order = np.argsort(angles, kind="stable")
                choices.append([int(k) for k in order if angles[k] <= angles[order[0]] + slack])
            columns = [batch[c] for c in ("shard", "node", "unit", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(choices, pa.list_(pa.int32()))], ["shard", "node", "unit", "copies", "to"])

    return run


def _apart(threshold: float):
    """Medoids of a shard of which none could link with a neighbour of another: a tight group keeps one."""
    far = math.cos(min(math.pi, 2.2 * math.acos(threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for medoids in batch["medoids"].to_pylist():
                chosen: list[bytes] = []
                for m in medoids:
                    if all(np.frombuffer(m, np.float64) @ np.frombuffer(c, np.float64) < far for c in chosen):
                        chosen.append(m)
                kept.append(chosen)
            yield pa.RecordBatch.from_arrays([batch["shard"], pa.array(kept, pa.list_(pa.binary()))], ["shard", "medoids"])

    return run


def _shards(classes: DataFrame, settings: Settings) -> DataFrame:
    """``shard``, ``members``, ``node``, ``unit``, ``copies``: every class in one or more shards."""
    rows = classes.select(F.xxhash64("label", F.size("embedding")).alias("shard"), "node", "unit", "copies")
    done = None
    for _ in range(LEVELS):
        sized = rows.join(rows.groupBy("shard").agg(F.count("*").alias("members")), "shard")
        ready = sized.where(F.col("members") <= settings.shard)
        done = ready if done is None else done.unionByName(ready)
        large = stored(sized.where(F.col("members") > settings.shard), "shards")
        if large.isEmpty():
            return done
        first = Window.partitionBy("shard").orderBy(F.xxhash64("node", "shard"), "node")
        medoids = large.withColumn("n", F.row_number().over(first)).where(F.col("n") <= MEDOIDS).groupBy("shard").agg(
            F.sort_array(F.collect_list(F.struct("n", "unit"))).getField("unit").alias("medoids"),
        ).mapInArrow(_apart(settings.threshold), "shard long, medoids array<binary>")
        dealt = stored(large.drop("members").join(medoids, "shard").mapInArrow(
            _nearest(settings.slack), "shard long, node long, unit binary, copies long, to array<int>",
        ), "dealt")
        judged = dealt.groupBy("shard").agg(F.count("*").alias("members"), F.avg((F.size("to") > 1).cast("double")).alias("both"), F.max("to").alias("top"), F.min("to").alias("low"))
        # a shard all of whose classes go the same way does not come apart either
        judged = judged.select("shard", "members", F.when(F.col("top") == F.col("low"), 1.0).otherwise(F.col("both")).alias("both"))
        dealt = dealt.join(judged, "shard")
        whole = dealt.where(F.col("both") > INSEPARABLE)
        done = done.unionByName(whole.select("shard", "node", "unit", "copies", "members"))
        rows = stored(dealt.where(F.col("both") <= INSEPARABLE).select(
            F.col("shard").alias("parent"), "node", "unit", "copies", F.explode("to").alias("k"),
        ).select(F.xxhash64("parent", "k").alias("shard"), "node", "unit", "copies"), "rows")
    return done.unionByName(rows.join(rows.groupBy("shard").agg(F.count("*").alias("members")), "shard"))


def _tasks(shards: DataFrame, settings: Settings) -> DataFrame:
    """Shards as task keys; a larger one as pairs of its blocks."""
    n = F.ceil(F.col("members") / settings.shard)
    blocks = F.when(n > 1, 2 * n).otherwise(1)
    rows = shards.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    rows = rows.withColumn("pair", F.explode(others))
    return rows.select(F.xxhash64("shard", "pair.low", "pair.high").alias("task"), "node", "unit", "copies")


def _seed(nodes: np.ndarray) -> np.random.Generator:
    return np.random.default_rng(int(nodes.min()) & 0xFFFFFFFF)


def robust_prune(x: np.ndarray, at: int, candidates: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Neighbours of ``at`` from the nearest on, dropping those that a kept one is closer to by the factor ``alpha``."""
    candidates = candidates[candidates != at]
    distance = np.sqrt(np.maximum(2 - 2 * (x[candidates] @ x[at]), 0))
    order = np.argsort(distance, kind="stable")
    candidates, distance = candidates[order], distance[order]
    kept: list[int] = []
    while len(candidates) and len(kept) < degree:
        p = int(candidates[0])
        kept.append(p)
        between = np.sqrt(np.maximum(2 - 2 * (x[candidates] @ x[p]), 0))
        stay = alpha * between > distance + _EPS
        stay[0] = False
        candidates, distance = candidates[stay], distance[stay]
    return kept


def flat_graph(x: np.ndarray, nodes: np.ndarray, settings: Settings) -> list[set[int]]:
    """Adjacency of a shard: nearest classes, a few others and the medoid are candidates, links go both ways."""
    n, rng = len(x), _seed(nodes)
    near = min(3 * settings.degree, n - 1)
    medoid = int((x @ x.mean(0)).argmax())
    adjacency: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 512):
        similar = x[at: at + 512] @ x.T
        top = np.argpartition(-similar, near, axis=1)[:, : near + 1] if near < n - 1 else np.tile(np.arange(n), (len(similar), 1))
        for k, row in enumerate(top):
            candidates = np.unique(np.concatenate([row, rng.integers(0, n, settings.degree), [medoid]]))
            adjacency[at + k].update(robust_prune(x, at + k, candidates, settings.degree, settings.alpha))
    backward: list[list[int]] = [[] for _ in range(n)]
    for i, others in enumerate(adjacency):
        for j in others:
            backward[j].append(i)
    for i, others in enumerate(backward):
        extra = adjacency[i].union(others)
        adjacency[i] = set(robust_prune(x, i, np.fromiter(extra, int, len(extra)), 2 * settings.degree, settings.alpha)) if len(extra) > 2 * settings.degree else extra
    # a class that pruning has cut off hangs on the medoid again
    reached, todo = {medoid}, [medoid]
    while todo:
        for j in adjacency[todo.pop()] - reached:
            reached.add(j)
            todo.append(j)
        if not todo and len(reached) < n:
            lost = next(i for i in range(n) if i not in reached)
            adjacency[medoid].add(lost)
            adjacency[lost].add(medoid)
            reached.add(lost)
            todo.append(lost)
    return adjacency


def _built(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "task"):
            if len(table) < 2:
                continue
            nodes = table["node"].to_numpy()
            lists = flat_graph(_matrix(table["unit"]), nodes, settings)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array([nodes[sorted(a)].tolist() for a in lists], pa.list_(pa.int64()))], ["node", "near"],
            )

    return run


def range_search(
    x: np.ndarray, q: np.ndarray, neighbours: list[np.ndarray], start: int, within: float, beam: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Members at least ``within`` similar to ``q`` and how similar: a greedy beam from ``start``, then outwards
    through all that are in range."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    ids, sims, expanded = np.array([start]), np.array([x[start] @ q]), np.zeros(1, bool)
    while True:
        todo = ~expanded & (sims >= within)
        if not todo.any():
            best = np.argpartition(-sims, beam - 1)[:beam] if len(sims) > beam else np.arange(len(sims))
            best = best[~expanded[best]]
            todo = best[np.argsort(-sims[best], kind="stable")[:4]]
            if not len(todo):
                inside = sims >= within
                return ids[inside], sims[inside]
        expanded[todo] = True
        new = np.unique(np.concatenate([neighbours[i] for i in ids[todo]]))
        new = new[~seen[new]]
        seen[new] = True
        ids, sims = np.concatenate([ids, new]), np.concatenate([sims, x[new] @ q])
        expanded = np.concatenate([expanded, np.zeros(len(new), bool)])


def _searched(settings: Settings):
    within = math.cos(math.acos(settings.threshold) * 1.25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "task"):
            if len(table) < 2:
                continue
            order = np.argsort(table["node"].to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            nodes, x = table["node"].to_numpy(), _matrix(table["unit"])
            task = table["task"][0].as_py()
            tasks = [frozenset(t) for t in table["tasks"].to_pylist()]
            kinds = list(dict.fromkeys(tasks))
            kind = np.array([kinds.index(t) for t in tasks])
            neighbours = []
            for near in table["near"].to_pylist():
                at = np.searchsorted(nodes, near)
                at[at == len(nodes)] = 0
                neighbours.append(at[nodes[at] == near] if len(near) else np.zeros(0, int))
            medoid = int((x @ x.mean(0)).argmax())
            codes = []
            for i in range(len(nodes)):
                j, similar = range_search(x, x[i], neighbours, medoid, within, settings.beam)
                j = j[(similar >= settings.threshold) & (j != i)]
                codes.append(np.minimum(i, j) * len(nodes) + np.maximum(i, j))
            i, j = np.divmod(np.unique(np.concatenate(codes)), len(nodes))
            # a pair that shares several tasks counts in the first of them
            first = np.array([[min(a & b, default=task) == task for b in kinds] for a in kinds], bool)
            own = first[kind[i], kind[j]]
            i, j = i[own], j[own]
            if not len(i):
                continue
            copies = table["copies"].to_numpy()
            links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[at]), pa.array(links[at].astype(np.int64)), pa.array(_forest(nodes, i, j)[at])], ["node", "links", "least"],
            )

    return run


def _links(classes: DataFrame, settings: Settings) -> DataFrame:
    n = shuffle_partitions(classes.sparkSession)
    tasks = stored(_tasks(_shards(classes, settings), settings), "tasks")
    built = tasks.select("task", "node", "unit").repartition(n, "task").sortWithinPartitions("task", "node")
    lists = built.mapInArrow(_built(settings), "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    held = tasks.groupBy("node").agg(F.collect_set("task").alias("tasks"))
    rows = tasks.join(united, "node").join(held, "node")
    rows = rows.select("task", "node", "unit", "copies", "near", "tasks").repartition(n, "task").sortWithinPartitions("task", "node")
    return stored(rows.mapInArrow(_searched(settings), "node long, links long, least long"), "links")


def _compared(threshold: float):
    """The links of a pair of blocks, by comparing all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "task"):
            low, high = table["low"][0].as_py(), table["high"][0].as_py()
            nodes, own, copies, x = table["node"].to_numpy(), table["own"].to_numpy(), table["copies"].to_numpy(), _matrix(table["unit"])
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            links, least = np.zeros(len(nodes), np.int64), nodes.copy()
            while True:  # smallest reachable nodes settle over passes; only a slice of the pairs is held
                before = least.copy()
                links[:] = 0
                for at in range(0, len(left), 128):
                    part = left[at: at + 128]
                    ok = x[part] @ x[right].T >= threshold
                    if low == high:
                        ok &= part[:, None] < right
                    i, j = np.nonzero(ok)
                    i, j = part[i], right[j]
                    links += np.bincount(i, copies[j], len(nodes)).astype(np.int64) + np.bincount(j, copies[i], len(nodes)).astype(np.int64)
                    lower = np.minimum(least[i], least[j])
                    np.minimum.at(least, i, lower)
                    np.minimum.at(least, j, lower)
                if (least == before).all():
                    break
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(links[at]), pa.array(least[at])], ["node", "links", "least"])

    return run


def exact_links(classes: DataFrame, settings: Settings) -> DataFrame:
    """The links of all pairs of a label, compared in pairs of blocks of about ``shard`` classes."""
    rows = classes.select(F.xxhash64("label", F.size("embedding")).alias("group"), "node", "unit", "copies")
    sized = rows.join(rows.groupBy("group").agg(F.ceil(F.count("*") / settings.shard).alias("blocks")), "group")
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    dealt = sized.withColumn("pair", F.explode(others)).select(
        F.xxhash64("group", "pair.low", "pair.high").alias("task"), "node", "unit", "copies", "own", "pair.low", "pair.high",
    ).repartition(shuffle_partitions(classes.sparkSession), "task").sortWithinPartitions("task", "node")
    return stored(dealt.mapInArrow(_compared(settings.threshold), "node long, links long, least long"), "links")


def audit(classes: DataFrame, links: DataFrame, threshold: float, queries: int) -> float:
    """The mean share of its links that a class has found, over the sampled classes that have links.

    At least about ``queries`` classes by hash, and four times the root of their number, are compared with all classes. While none
    of them has a link, four times as many are asked, at last all; without any link the recall is 1.
    """
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    n = classes.count()
    wanted = max(queries, 4 * math.isqrt(n))
    while n:
        drawn = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 40)) < int(min(1.0, wanted / n) * (1 << 40))
        asked = stored(classes.where(drawn).select("label", "node", "unit").join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0))), "asked")
        true = _true_links(classes, asked, threshold)
        share = asked.join(true, "node").agg(F.avg(F.least(F.lit(1.0), F.col("links") / F.col("true")))).first()[0]
        if share is not None:
            return share
        if wanted >= n:
            break
        wanted *= 4
    return 1.0


def _true_links(classes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """``node`` and ``true``, the number of its links by brute force, for the classes of ``asked`` that have any."""
    slices = F.ceil(F.lit(asked.count()) / 2_000)
    parts = asked.select("label", "node", "unit", F.pmod(F.xxhash64("node"), slices).alias("part"))
    total = None
    for part in range(math.ceil(asked.count() / 2_000)):  # so many queries are sent out at once
        rows = parts.where(F.col("part") == part).collect()
        by_kind: dict[tuple[int, int], list] = {}
        for r in rows:
            by_kind.setdefault((r.label, len(r.unit)), []).append((r.node, r.unit))
        shared = classes.sparkSession.sparkContext.broadcast({
            k: (np.array([i for i, _ in v]), np.frombuffer(b"".join(u for _, u in v), np.float64).reshape(len(v), -1)) for k, v in by_kind.items()
        })

        def brute(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes, labels, copies, units = batch["node"].to_numpy(), batch["label"].to_numpy(), batch["copies"].to_numpy(), batch["unit"].to_pylist()
                sizes = np.array([len(u) for u in units])
                for (label, size), (asking, q) in shared.value.items():
                    at = np.flatnonzero((labels == label) & (sizes == size))
                    for a in range(0, len(at), 512):
                        part = at[a: a + 512]
                        x = np.frombuffer(b"".join(units[k] for k in part), np.float64).reshape(len(part), -1)
                        hit = (q @ x.T >= threshold) & (asking[:, None] != nodes[part])
                        sums = hit @ copies[part]
                        some = np.flatnonzero(sums)
                        yield pa.RecordBatch.from_arrays([pa.array(asking[some]), pa.array(sums[some].astype(np.int64))], ["node", "true"])

        found = stored(classes.select("node", "label", "copies", "unit").mapInArrow(brute, "node long, true long").groupBy("node").agg(F.sum("true").alias("true")), "true")
        shared.unpersist()
        total = found if total is None else total.unionByName(found)
    return total if total is not None else asked.select("node", F.lit(0).cast("long").alias("true")).limit(0)


def near_duplicates(vectors: DataFrame, settings: Settings | None = None, target: float = 0.95, queries: int = 64) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors``, and the audited ``recall``."""
    settings = settings or Settings()
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    classes = classes_of(rows)
    for _ in range(BUILDS):
        links = _links(classes, settings)
        recall = audit(classes, links, settings.threshold, queries)
        if recall >= target:
            break
        settings = Settings(settings.threshold, settings.shard, settings.degree, settings.alpha, 2 * settings.slack, 2 * settings.beam)
    else:
        links, recall = exact_links(classes, settings), 1.0
    found = graph.components(links.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("label", "embedding", "node", "copies").join(counts, "node", "left").join(found, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"),
    )
    return rows.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("c", "vec_id")).alias("kept"), F.lit(recall).alias("recall"),
    )
