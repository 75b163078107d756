"""Conversation prefix trie by vertical bitmaps.

Every distinct sequence of first turns of a set of conversations is a node; conversations that begin with it are its members.
Conversations are laid out by id and cut into shards. A shard indexes (position, turn) to a bitset of its conversations and goes
through its part of the trie depth first: the lowest conversation left in a parent's bitset names the next turn, the
intersection of the bitset with that turn's posting is the child, its population count the members, and conversations that end
there are the node's end list. Nodes of all shards are then merged by the digest of their turns, in Spark:

* members, smallest member and words of all members add up over shards, as do the parts of a node's end list, which are read in
  the order of ids by a stream that hashes them, so no list is held whole;
* what counts distinct nodes below a node is summed in the shard that owns each of them, the one of its smallest member: a
  second pass over every shard's nodes in depth-first order takes differences of running sums, which then add up too.
  The tokens saved below a node are its members' words less the words of the distinct nodes.

Only digests of turns (128 bits and more) are shuffled. A hot prefix is one row per shard that holds it, however many
conversations share it. A shard takes conversations until it has ``shard_conversations`` or ``shard_turns``; one conversation
must fit a task (some 100 bytes a turn), and so must the turns of a block that shares a donor.

NULL ``conv_id`` is no conversation. Turns of one number are ordered by their digest, repeated rows are turns of their own, and a
NULL role or text is the empty one. Further columns are not read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.llm.common import shuffle_partitions, stored, whole_text
from pairset.session import ship

SHARD_CONVERSATIONS, SHARD_TURNS = 4_096, 200_000
#: Conversations of one block of ids may begin with turns of the block's first one.
BLOCK = 20

ROOT = b"\0" * 16
_NODES = (
    "shard long, pre int, size int, up int, node binary, parent binary, depth long, members long, conv_id long, "
    "words long, member_words long, ends array<long>"
)
_WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, the digest of role and text, and the words of the text."""
    role, text = whole_text("role"), whole_text("text")
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )


def block_of(conv_id: Column) -> Column:
    """The conversation whose first turns a conversation takes over."""
    return conv_id - conv_id % BLOCK


def taken_turns(conv_id: Column) -> Column:
    """How many first turns it takes over."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


Conversation = tuple[int, list[bytes], list[int]]


def rebuilt(block: list[tuple[int, int, list[bytes], list[int]]], donor: int) -> Iterator[Conversation]:
    """The conversations of a block, given by id, taken turns, digests and words, with the donor's first turns."""
    first: tuple[list[bytes], list[int]] = next(((d, w) for c, _, d, w in block if c == donor), ([], []))
    for c, h, digests, words in block:
        yield c, first[0][:h] + digests[h:], first[1][:h] + words[h:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """Rebuilt conversations of a partition sorted by block, id and turn, in ascending order of id."""
    block: list[tuple[int, int, list[bytes], list[int]]] = []
    at = None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("block", "conv_id", "taken", "digest", "words")]
        for b, c, h, digest, words in zip(*columns, strict=True):
            if b != at:
                yield from rebuilt(block, at)
                block, at = [], b
            if not block or block[-1][0] != c:
                block.append((c, h, [], []))
            block[-1][2].append(digest)
            block[-1][3].append(words)
    yield from rebuilt(block, at)


def _shards(conversations: Iterator[Conversation], most: int, turns: int) -> Iterator[list[Conversation]]:
    shard: list[Conversation] = []
    held = 0
    for c in conversations:
        if shard and (len(shard) >= most or held + len(c[1]) > turns):
            yield shard
            shard, held = [], 0
        shard.append(c)
        held += len(c[1])
    if shard:
        yield shard


def shard_trie(shard: list[Conversation]) -> dict[str, list]:
    """The nodes of one shard in depth-first order; bit k of a bitset is its k-th conversation by id."""
    postings: dict[tuple[int, bytes], int] = {}
    ended: dict[int, int] = {}
    for k, (_, digests, _) in enumerate(shard):
        for position, digest in enumerate(digests):
            postings[position, digest] = postings.get((position, digest), 0) | 1 << k
        ended[len(digests)] = ended.get(len(digests), 0) | 1 << k
    ids = [c for c, _, _ in shard]
    left = [np.cumsum(words[::-1])[::-1].tolist() if words else [] for _, _, words in shard]
    out: dict[str, list] = {name: [] for name in ("size", "up", "node", "parent", "depth", "members", "conv_id", "words", "member_words", "ends")}
    # an entry is a node to visit: bitset, depth, digest of the path, and its parent's number and digest
    stack: list[tuple[int, int, bytes, int, bytes | None]] = [((1 << len(shard)) - 1, 0, ROOT, -1, None)]
    while stack:
        bits, depth, node, up, parent = stack.pop()
        lowest = (bits & -bits).bit_length() - 1
        at = len(out["size"])
        for name, value in (("size", 1), ("up", up), ("node", node), ("parent", parent), ("depth", depth), ("members", bits.bit_count()), ("conv_id", ids[lowest])):
            out[name].append(value)
        out["words"].append(shard[lowest][2][depth - 1] if depth else 0)
        ends = bits & ended.get(depth, 0)
        out["ends"].append([ids[k] for k in _bits(ends)])
        rest = bits & ~ends
        out["member_words"].append(sum(left[k][max(depth - 1, 0)] for k in _bits(bits) if left[k]))
        while rest:
            digest = shard[(rest & -rest).bit_length() - 1][1][depth]
            child = rest & postings[depth, digest]
            rest &= ~child
            stack.append((child, depth + 1, hashlib.blake2b(node + digest, digest_size=16).digest(), at, node))
    for at in range(len(out["size"]) - 1, 0, -1):
        out["size"][out["up"][at]] += out["size"][at]
    return out


def _bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _indexed(most: int, turns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(_blocks(batches), most, turns):
            nodes = shard_trie(shard)
            n = len(nodes["size"])
            # a conversation is in one shard, so its smallest id names it, whatever task makes it
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard[0][0]] * n, pa.int64()), "pre": pa.array(range(n), pa.int32()),
                "size": pa.array(nodes["size"], pa.int32()), "up": pa.array(nodes["up"], pa.int32()),
                "node": pa.array(nodes["node"], pa.binary()), "parent": pa.array(nodes["parent"], pa.binary()),
                **{name: pa.array(nodes[name], pa.int64()) for name in ("depth", "members", "conv_id", "words", "member_words")},
                "ends": pa.array(nodes["ends"], pa.list_(pa.int64())),
            })

    return run


def shard_nodes(said: DataFrame, shard_conversations: int, shard_turns: int) -> DataFrame:
    """The nodes of every shard, from ``turns``: laid out by id, rebuilt and indexed."""
    rows = said.withColumns({"block": block_of(F.col("conv_id")), "taken": taken_turns(F.col("conv_id"))})
    laid = rows.repartitionByRange(shuffle_partitions(said.sparkSession), "block").sortWithinPartitions(
        "block", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return laid.select("block", "conv_id", "taken", "digest", "words").mapInArrow(_indexed(shard_conversations, shard_turns), _NODES)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``own_words`` and ``own_leaf`` below every node of a shard, and its parent's ``first``; sorted by shard and ``pre``."""
    held: pa.Table | None = None

    def summed(rows: pa.Table) -> pa.RecordBatch:
        size, up = rows["size"].to_numpy(), rows["up"].to_numpy()
        begin = np.arange(rows.num_rows)
        below = []
        for name in ("own_words", "own_leaf"):
            running = np.concatenate([[0], np.cumsum(rows[name].to_numpy())])
            below.append(running[begin + size] - running[begin])
        parent = rows["first"].to_numpy()[np.maximum(up, 0)]
        return pa.RecordBatch.from_arrays(
            [rows["node"].combine_chunks(), *map(pa.array, below), pa.array(parent, mask=up < 0)],
            ["node", "words_below", "leaves_below", "parent_conv_id"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = pa.Table.from_batches([batch])
        rows = new if held is None else pa.concat_tables([held, new])
        starts = np.flatnonzero(rows["pre"].to_numpy() == 0).tolist()
        for a, b in zip(starts, starts[1:]):
            yield summed(rows.slice(a, b - a))
        held = rows.slice(starts[-1])
    if held is not None:
        yield summed(held)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its end lists, of a stream sorted by node and shard."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1])], ["node", "ends_sha256"])

    done: tuple[list[bytes], list[str]] = ([], [])
    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = ",".join(map(str, ends)).encode()
            if key != node:
                if state is not None:
                    done[0].append(node)
                    done[1].append(state.hexdigest())
                node, state = key, hashlib.sha256(text)
            else:
                state.update(b"," + text)
        if len(done[0]) >= 10_000:
            yield row()
            done = ([], [])
    if state is not None:
        done[0].append(node)
        done[1].append(state.hexdigest())
        yield row()


def trie(
    conversations: DataFrame, *, shard_conversations: int = SHARD_CONVERSATIONS, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = conversations.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    local = stored(shard_nodes(stored(turns(conversations), "turns"), shard_conversations, shard_turns), "shard-nodes")
    merged = local.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min("words").alias("words"), F.sum("member_words").alias("member_words"), F.min("shard").alias("owner"),
    )
    children = merged.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    nodes = stored(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    facts = nodes.select("node", "owner", F.col("conv_id").alias("first"), F.col("words").alias("all_words"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    owned = F.col("shard") == F.col("owner")
    flagged = local.select("shard", "pre", "size", "up", "node").join(facts, "node").select(
        "shard", "pre", "size", "up", "node", "first",
        F.when(owned, F.col("all_words")).otherwise(0).alias("own_words"), F.when(owned, F.col("leaf")).otherwise(0).alias("own_leaf"),
    )
    ordered = flagged.repartition(parts, "shard").sortWithinPartitions("shard", "pre")
    below = ordered.mapInArrow(_subtrees, "node binary, words_below long, leaves_below long, parent_conv_id long").groupBy("node").agg(
        F.sum("words_below").alias("words_below"), F.sum("leaves_below").alias("n_leaves"), F.max("parent_conv_id").alias("parent_conv_id"))
    lists = local.where(F.size("ends") > 0).select("node", "ends", "shard")
    hashed = lists.repartition(parts, "node").sortWithinPartitions("node", "shard").select("node", "ends").mapInArrow(_digested, "node binary, ends_sha256 string")
    return nodes.join(below, "node").join(hashed, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("member_words") - F.col("words_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def sql(table: str = "conversations") -> str:
    """The same nodes in DuckDB's SQL, prefixes compared as lists; the CRC-32 is spelt out, as DuckDB has none."""
    return f"""
    WITH RECURSIVE ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id FROM {table} WHERE conv_id IS NOT NULL),
    crc AS (
      SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS r FROM ids
      UNION ALL
      SELECT conv_id, s, k + 1, CASE WHEN m & 1 = 1 THEN xor(m >> 1, 3988292384) ELSE m >> 1 END
      FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(r, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE r END AS m FROM crc WHERE k < 8 * length(s))),
    own AS (
      SELECT CAST(conv_id AS BIGINT) AS conv_id,
             list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS said
      FROM {table} WHERE conv_id IS NOT NULL GROUP BY 1),
    taken AS (SELECT conv_id, xor(r, 4294967295) % 4 AS h FROM crc WHERE k = 8 * length(s)),
    rebuilt AS (
      SELECT o.conv_id, list_concat(coalesce(list_slice(d.said, 1, h), []), list_slice(o.said, h + 1, len(o.said))) AS said
      FROM own o JOIN taken USING (conv_id) LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % {BLOCK}),
    placed AS (SELECT conv_id, said, unnest(range(len(said) + 1)) AS depth FROM rebuilt),
    members AS (SELECT conv_id, depth, len(said) = depth AS ends, list_slice(said, 1, depth) AS node FROM placed),
    nodes AS (
      SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
             CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS words
      FROM members GROUP BY node, depth),
    children AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
    above AS (SELECT list_slice(node, 1, d) AS node, n_children, (n_convs - 1) * words AS saved
              FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_nodes)),
    below AS (SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM full_nodes n JOIN below USING (node) LEFT JOIN full_nodes p ON n.depth > 0 AND p.node = list_slice(n.node, 1, n.depth - 1)"""
