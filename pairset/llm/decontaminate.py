"""Benchmark decontamination: every passage of every text is a BM25 query against an inverted index of test items.

1. *Index.* Spark counts the documents of a term over all items, weighs every posting, and writes the index to the shared folder,
   one row per shard: the postings of a term in order of their items, cut into blocks of ``BLOCK`` items, with the largest impact of
   each (term, block) and of each term. An impact is a posting's BM25 weight over what the item needs to be
   retrieved, a share ``retrieve`` of its score against itself, so an item is retrieved when its impacts sum to 1.
2. *Search*, block-max WAND. The threshold is fixed, so no decision depends on an earlier one, and the pivots of many passages
   are found at once. A passage's terms are ordered by their largest impact; those whose largest impacts together stay below 1
   can't bring an item in alone, and their lists are not read, only looked up at pivots. The lists of the others give the
   pivot blocks: those where their block maxima and the largest impacts of the rest reach 1. There all lists are looked up, blocks
   whose maxima stay below 1 are skipped, and the postings of the blocks that remain are summed.
3. *Verification* on the words themselves: the shares of the item's question and of its answer, as five-word shingles, that
   stand in the passage. An item is cut at the last end of a sentence that leaves five words on both sides, or else before its
   last third.

An item of fewer than ``LEAST_WORDS`` words has no two parts of five words, and its words stand in many texts by chance. It is
verified only by a text whose words are the item's, all of them and in its order.

Shards hold items of like lengths, within a factor of ``BAND``. Passages are windows of twice the longest item of the shard,
half overlapping, so every item lies whole in one. A *part* of the index, about ``part_words`` words of items dealt by hash, is what
the driver and a worker hold at a time; a larger benchmark takes one pass over the texts per part.

NULL and empty texts have no passages, NULL and empty items match nothing, items without an id neither, repeated items count
once, and items of one id are told apart by their text; of several retrievals of one id by a text the best verified one, then
the best scored, is reported. Without items the result is empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairset.llm.common import stored
from pairset.llm.shingles import WORDS, word_hashes
from pairset.session import ship

K1, B = 1.2, 0.75
#: Words from which an item is verified by the overlap of its parts.
LEAST_WORDS = 2 * WORDS
#: Items of a block, and the factor between the shortest and the longest item of a shard.
BLOCK = 8
BAND = 4
#: Frequencies are copied this often for the join with postings, so that a term of all items is many keys.
SALT = 16
#: Sum of impacts that retrieves, less what rounding may take.
ENOUGH = 1 - 1e-6
#: Words of texts, and entries of lists, that are searched at once.
WORDS_AT_ONCE, ENTRIES_AT_ONCE = 1 << 16, 1 << 20

_ARRAYS = {
    "item_ids": np.int64, "terms": np.uint64, "most": np.float64, "list_at": np.int64, "entry_key": np.int64,
    "entry_most": np.float64, "posting_at": np.int64, "posting_item": np.int64, "impact": np.float64,
    "word_at": np.int64, "words": np.uint64, "cut": np.int64,
}
_SHARD = "part int, band int, " + ", ".join(f"{name} binary" for name in _ARRAYS)


@dataclass
class Shard:
    """Items of like lengths. List ``t`` of a term is the entries ``list_at[t]`` to ``list_at[t + 1]``, an entry is a block of the list,
    its key ``t`` times the number of blocks plus the block, its postings ``posting_at[e]`` to ``posting_at[e + 1]``."""

    item_ids: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    list_at: np.ndarray
    entry_key: np.ndarray
    entry_most: np.ndarray
    posting_at: np.ndarray
    posting_item: np.ndarray
    impact: np.ndarray
    word_at: np.ndarray
    words: np.ndarray
    cut: np.ndarray
    _parts: dict[int, tuple[tuple[np.ndarray, int], ...]] = field(default_factory=dict)

    @property
    def blocks(self) -> int:
        return -(-len(self.item_ids) // BLOCK)

    @property
    def window(self) -> int:
        return 2 * int(np.diff(self.word_at).max())

    def words_of(self, item: int) -> np.ndarray:
        return self.words[self.word_at[item]: self.word_at[item + 1]]

    def parts_of(self, item: int) -> tuple[tuple[np.ndarray, int], ...]:
        """Question and answer as runs of words, each with the length of its runs."""
        if item not in self._parts:
            w, cut = self.words_of(item), self.cut[item]
            self._parts[item] = tuple((runs_of(p), min(WORDS, len(p))) for p in (w[:cut], w[cut:]))
        return self._parts[item]


def runs_of(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of runs of ``n`` words, or of all words where there are fewer."""
    n = min(n, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k: k + len(total)]
    return np.unique(total)


def answer_at(text: str, words: np.ndarray) -> int:
    """The number of words before an item's answer."""
    cut = None
    for m in re.finditer(r"[.?!]\s+", text):
        before = len(word_hashes(text[: m.end()]))
        if len(words) - before >= WORDS and before >= WORDS:
            cut = before
    return len(words) - max(1, len(words) // 3) if cut is None else cut


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("term", pa.int64()), ("tf", pa.int32())]))
    for batch in batches:
        rows = []
        for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if len(w := word_hashes(text)):
                terms, tf = np.unique(w, return_counts=True)
                pairs = [{"term": t, "tf": n} for t, n in zip(terms.view(np.int64).tolist(), tf.tolist(), strict=True)]
                rows.append((item_id, f"{item_id}:{hashlib.md5(text.encode()).hexdigest()}", w.tobytes(), len(w), answer_at(text, w), pairs))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "item", "words", "n_words", "cut", "terms"],
        )


def _shard(retrieve: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "ascending"), ("item", "ascending")])  # blocks of like lengths have like impacts
        postings = table["postings"].combine_chunks()
        sizes = np.diff(postings.offsets.to_numpy())
        flat = postings.flatten()
        term, weight = flat.field("term").to_numpy().view(np.uint64), flat.field("weight").to_numpy()
        item = np.repeat(np.arange(len(sizes)), sizes)
        impact = weight / (retrieve * np.bincount(item, weight))[item]
        order = np.lexsort((item, term))
        item, impact = item[order], impact[order]
        terms, at = np.unique(term[order], return_inverse=True)
        blocks = -(-len(sizes) // BLOCK)
        entry_key, posting_at = np.unique(at * blocks + item // BLOCK, return_index=True)
        list_at = np.searchsorted(entry_key, np.arange(len(terms) + 1) * blocks)
        entry_most = np.maximum.reduceat(impact, posting_at)
        arrays = {
            "item_ids": table["item_id"].to_numpy(), "terms": terms, "most": np.maximum.reduceat(entry_most, list_at[:-1]), "list_at": list_at,
            "entry_key": entry_key, "entry_most": entry_most, "posting_at": np.append(posting_at, len(item)), "posting_item": item,
            "impact": impact, "word_at": np.concatenate([[0], np.cumsum(table["n_words"].to_numpy())]),
            "words": np.frombuffer(b"".join(table["words"].to_pylist()), np.uint64), "cut": table["cut"].to_numpy(),
        }
        place = {"part": pa.array([key[0].as_py()], pa.int32()), "band": pa.array([key[1].as_py()], pa.int32())}
        return pa.table(place | {n: pa.array([np.ascontiguousarray(arrays[n], t).tobytes()], pa.binary()) for n, t in _ARRAYS.items()})

    return run


def build(items: DataFrame, *, retrieve: float = 0.5, part_words: int = 2_000_000) -> tuple[DataFrame, int]:
    """The index, a row per shard, and its number of parts. Statistics of terms are taken over all items."""
    ship(items.sparkSession)
    texts = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    schema = "item_id long, item string, words binary, n_words long, cut long, terms array<struct<term: bigint, tf: int>>"
    rows = stored(texts.mapInArrow(_item_rows, schema), "items")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n_parts = math.ceil(total / part_words)
    listed = rows.select("item", "n_words", F.inline("terms"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    known = listed.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", salts)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / (total / max(n, 1))))
    weighed = listed.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALT)).cast("int")).join(known, ["term", "salt"])
    postings = weighed.groupBy("item").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("postings"))
    dealt = rows.drop("terms").join(postings, "item").select(
        "*", F.pmod(F.xxhash64("item"), F.lit(max(n_parts, 1))).cast("int").alias("part"),
        (F.length(F.conv(F.col("n_words").cast("string"), 10, BAND)) - 1).alias("band"),
    )
    return stored(dealt.groupBy("part", "band").applyInArrow(_shard(retrieve), _SHARD), "index"), n_parts


def load(index: DataFrame, part: int) -> list[Shard]:
    """The shards of one part: at most one per band, together about ``part_words`` words."""
    rows = index.where(F.col("part") == part).orderBy("band").collect()
    return [Shard(*(np.frombuffer(r[name], kind) for name, kind in _ARRAYS.items())) for r in rows]


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges ``lo`` to ``hi``, each with the number of its range."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _looked_up(shard: Shard, passage: np.ndarray, term: np.ndarray, essential: np.ndarray, spare: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Passages, items and scores of what is retrieved, from the distinct terms of passages in order of passage."""
    lists = np.flatnonzero(essential)
    owner, entry = spread(shard.list_at[term[lists]], shard.list_at[term[lists] + 1])
    pivot, at = np.unique(passage[lists[owner]] * shard.blocks + shard.entry_key[entry] % shard.blocks, return_inverse=True)
    pivot = pivot[np.bincount(at, shard.entry_most[entry], len(pivot)) + spare[pivot // shard.blocks] >= ENOUGH]
    if not len(pivot):
        return
    p, block = np.divmod(pivot, shard.blocks)
    owner, pair = spread(np.searchsorted(passage, p), np.searchsorted(passage, p, "right"))
    wanted = term[pair] * shard.blocks + block[owner]
    entry = np.searchsorted(shard.entry_key, wanted)
    entry[entry == len(shard.entry_key)] = 0
    there = shard.entry_key[entry] == wanted
    owner, entry = owner[there], entry[there]
    kept = np.bincount(owner, shard.entry_most[entry], len(p))[owner] >= ENOUGH
    owner, entry = owner[kept], entry[kept]
    which, posting = spread(shard.posting_at[entry], shard.posting_at[entry + 1])
    found, at = np.unique(p[owner[which]] * len(shard.item_ids) + shard.posting_item[posting], return_inverse=True)
    score = np.bincount(at, shard.impact[posting], len(found))
    hit = score >= ENOUGH
    yield found[hit] // len(shard.item_ids), found[hit] % len(shard.item_ids), score[hit]


def search(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of passages ``words[start:end]``, items that they retrieve, and scores, in batches of passages."""
    at = np.searchsorted(shard.terms, words)
    at[at == len(shard.terms)] = 0
    known = shard.terms[at] == words
    bound = np.concatenate([[0.0], np.cumsum(np.where(known, shard.most[at], 0.0))])
    hopeful = np.flatnonzero(bound[ends] - bound[starts] >= ENOUGH)
    owner, place = spread(starts[hopeful], ends[hopeful])
    there = known[place]
    passage, term = np.divmod(np.unique(owner[there] * len(shard.terms) + at[place[there]]), len(shard.terms))
    order = np.lexsort((shard.most[term], passage))
    passage, term = passage[order], term[order]
    upto = np.cumsum(shard.most[term])
    before = np.concatenate([[0.0], upto])[np.searchsorted(passage, np.arange(len(hopeful)))]
    essential = upto - before[passage] >= ENOUGH
    spare = np.bincount(passage[~essential], shard.most[term[~essential]], len(hopeful))
    entries = np.bincount(passage, np.where(essential, shard.list_at[term + 1] - shard.list_at[term], 0), len(hopeful))
    read = (np.cumsum(entries) // ENTRIES_AT_ONCE)[passage]
    for part in np.unique(read[essential]).tolist():
        s = slice(*np.searchsorted(read, [part, part + 1]))
        for p, item, score in _looked_up(shard, passage[s], term[s], essential[s], spare):
            yield hopeful[p], item, score


def _share(part: np.ndarray, passage: np.ndarray) -> float:
    return float(np.isin(part, passage).mean()) if len(part) else 1.0


def _retrieved(texts: list[np.ndarray], shard: Shard) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
    """Number of the text, item id, and score with both overlaps, of all passages of some texts."""
    step = shard.window // 2
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.concatenate(texts)
    owner, number = spread(np.zeros(len(texts), np.int64), np.maximum(1, -(-(np.diff(at) - step) // step)))
    starts = at[owner] + number * step
    ends = np.minimum(starts + shard.window, at[owner + 1])
    for passages, items, scores in search(words, starts, ends, shard):
        runs: dict[tuple[int, int], np.ndarray] = {}
        for p, item, score in zip(passages.tolist(), items.tolist(), scores.tolist(), strict=True):
            text, passage = int(owner[p]), words[starts[p]: ends[p]]
            if len(shard.words_of(item)) < LEAST_WORDS:
                overlaps = [float(np.array_equal(shard.words_of(item), texts[text]))] * 2
            else:
                for _, n in shard.parts_of(item):
                    if (p, n) not in runs:
                        runs[p, n] = runs_of(passage, n)
                overlaps = [_share(part, runs[p, n]) for part, n in shard.parts_of(item)]
            yield text, int(shard.item_ids[item]), (score, *overlaps)


def retrieved(texts: list[str | None], shards: list[Shard]) -> list[dict[int, tuple[float, float, float]]]:
    """What the passages of each text retrieve: score as a multiple of what is needed, question and answer overlap, by item id."""
    found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    words = [word_hashes(t or "") for t in texts]
    group = np.cumsum([len(w) for w in words]) // WORDS_AT_ONCE
    for g in np.unique(group).tolist():
        some = [k for k in np.flatnonzero(group == g).tolist() if len(words[k])]
        for shard in shards if some else ():
            for k, item_id, hit in _retrieved([words[k] for k in some], shard):
                best = found[some[k]]
                best[item_id] = max(best.get(item_id, (0.0, 0.0, 0.0)), hit, key=lambda x: (min(x[1:]), x[0]))
    return found


def _parts(items: DataFrame, retrieve: float, part_words: int) -> Iterator[Broadcast[list[Shard]]]:
    index, n_parts = build(items, retrieve=retrieve, part_words=part_words)
    for part in range(n_parts):
        yield items.sparkSession.sparkContext.broadcast(load(index, part))


_PAIRS = "doc_id long, item_id long, score double, question double, answer double"


def pairs(docs: DataFrame, items: DataFrame, *, retrieve: float = 0.5, overlap: float = 0.5, part_words: int = 2_000_000) -> DataFrame:
    """A row per document and retrieved item: ``score`` as a share of the item's against itself, both overlaps, and ``verified`` by them."""

    def finder(index: Broadcast[list[Shard]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = retrieved(batch["text"].to_pylist(), index.value)
                ids = batch["doc_id"].to_pylist()
                rows = [(ids[k], i, s * retrieve, q, a) for k, hits in enumerate(found) for i, (s, q, a) in sorted(hits.items())]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "score", "question", "answer"],
                )

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [texts.mapInArrow(finder(index), _PAIRS) for index in _parts(items, retrieve, part_words)]
    one = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _PAIRS)
    return one.withColumn("verified", (F.col("question") >= overlap) & (F.col("answer") >= overlap))


def clean(docs: DataFrame, items: DataFrame, *, retrieve: float = 0.5, overlap: float = 0.5, part_words: int = 2_000_000) -> DataFrame:
    """The documents without a verified item, row by row: no shuffle. Between two parts of the index they are written."""

    def judge(index: Broadcast[list[Shard]]):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                found = retrieved(texts.to_pylist(), index.value)
                yield pa.array([all(q < overlap or a < overlap for _, q, a in hits.values()) for hits in found], pa.bool_())

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "boolean")

    kept, written = docs, True
    for index in _parts(items, retrieve, part_words):
        kept = (kept if written else stored(kept, "clean")).where(judge(index)("text"))
        written = False
    return kept
