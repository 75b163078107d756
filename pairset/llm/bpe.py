"""Byte-level BPE encoding and decoding of whole texts by the ranks of a public vocabulary.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary (hash and displace) finds those that
are one token already. The others are merged with a heap of ranked pairs over linked bytes, in time
``n log n`` of their length. Results are kept in a bounded two-generation memo per Python worker.

The splitting pattern always starts a new pre-token at a space between two characters that are not white
space. Texts are therefore cut at such spaces first, and the pattern runs only on chunks that are not in the
memo; a text with white space beside a space goes through the pattern as a whole.

NULL and empty texts give no ids. Ids that are NULL decode to empty bytes.
"""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.session import ship

#: Entries of one generation of the memo, and the longest chunk that is kept in it.
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64

_MASK = (1 << 64) - 1
_BESIDE_SPACE = re.compile(r" \s|\s |^ | $")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids; ids must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks have gaps or repeat")
    return [tokens[i] for i in range(len(tokens))]


def _place(key: int, displacement: int, size: int) -> int:
    if displacement < 0:
        return -displacement - 1
    z = (key ^ (displacement * 0x9E3779B97F4A7C15)) & _MASK
    z = ((z ^ (z >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    return (z ^ (z >> 29)) % size


@dataclass
class PerfectHash:
    """A minimal perfect hash of the tokens: as many places as tokens, one displacement per bucket.

    Buckets are placed from the fullest on; those of one token take the free places directly, written as a
    negative displacement.
    """

    displacements: list[int]
    ids: list[int]

    @staticmethod
    def build(tokens: list[bytes], per_bucket: int = 3) -> PerfectHash:
        size = len(tokens)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(size // per_bucket + 1)]
        for i, token in enumerate(tokens):
            key = xxhash.xxh3_64_intdigest(token)
            buckets[key % len(buckets)].append((key, i))
        displacements, ids = [0] * len(buckets), [-1] * size
        last = -1
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) == 1:
                last = ids.index(-1, last + 1)
                ids[last], displacements[b] = buckets[b][0][1], -last - 1
                continue
            displacement = 0
            while buckets[b]:
                places = [_place(key, displacement, size) for key, _ in buckets[b]]
                if len(set(places)) == len(places) and all(ids[p] < 0 for p in places):
                    for p, (_, i) in zip(places, buckets[b], strict=True):
                        ids[p] = i
                    break
                displacement += 1
            displacements[b] = displacement
        return PerfectHash(displacements, ids)

    def candidate(self, token: bytes) -> int:
        """The only id that ``token`` can have; the caller compares the bytes."""
        key = xxhash.xxh3_64_intdigest(token)
        return self.ids[_place(key, self.displacements[key % len(self.displacements)], len(self.ids))]


@dataclass
class Vocabulary:
    """What is sent to the executors: bounded by the vocabulary, whatever the corpus."""

    tokens: list[bytes]
    hash: PerfectHash
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        tokens = read_ranks(path)
        return Vocabulary(tokens, PerfectHash.build(tokens), pattern)


class Encoder:
    """Encodes texts to fixed-width little-endian ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens, self.hash = vocabulary.tokens, vocabulary.hash
        self.ranks = {token: i for i, token in enumerate(self.tokens)}
        self.split = regex.compile(vocabulary.pattern).findall
        self.width = 2 if len(self.tokens) < 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(len(self.tokens))]
        self.singles = [self.ranks[bytes([c])] for c in range(256)]
        # the pairs of tokens that make a token, as one number each
        self.pairs = {
            self.ranks[t[:k]] << 20 | self.ranks[t[k:]]: i
            for i, t in enumerate(self.tokens) for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks
        }
        #: by two bytes, the id of the token that they make, or -1
        self.doubles = [self.pairs.get(a << 20 | b, -1) for a in self.singles for b in self.singles]
        self.newline = self.packed[self.ranks[b"\n"]]
        self.runs: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left.

        ``part`` holds the id of the part that begins at a byte, ``after`` and ``before`` link the parts, and ``rank`` is that of
        a part with the next one. Heap entries are a rank and a place in one number; one whose place has another rank by
        now is passed over.
        """
        n, pair, doubles = len(piece), self.pairs.get, self.doubles
        part = [self.singles[c] for c in piece]
        rank = [doubles[a << 8 | b] for a, b in zip(piece, piece[1:])]
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return part
        rank.append(-1)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if rank[i] != r:
                continue
            j = after[i]
            part[i], part[j], rank[j] = r, -1, -1
            after[i] = k = after[j]
            x = None
            if k < n:
                before[k] = i
                x = pair(r << 20 | part[k])
            if x is None:
                rank[i] = -1
            else:
                rank[i] = x
                heappush(heap, x << 32 | i)
            if i:
                h = before[i]
                x = pair(part[h] << 20 | r)
                if x is None:
                    rank[h] = -1
                else:
                    rank[h] = x
                    heappush(heap, x << 32 | h)
        return [p for p in part if p >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        raw = piece.encode()
        i = self.hash.candidate(raw)
        if self.tokens[i] == raw:
            return self.packed[i]
        return b"".join([self.packed[i] for i in self.merged(raw)])

    def pieces(self, text: str) -> bytes:
        return b"".join([self.piece(piece) for piece in self.split(text)])

    def spaced(self, chunk: str) -> bytes:
        """The ids of a chunk with the space before it.

        Letters with the space are one pre-token, a run of marks after them is another, and so is a line break between
        two characters that are not white space; only other chunks need the pattern.
        """
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self.piece(" " + chunk)
            elif (word := chunk.rstrip(string.punctuation)).isalpha():
                return self.known(word) + self.marks(chunk[len(word):])
            elif (cut := chunk.find("\n")) > 0 and chunk[cut + 1:].isalpha() and not chunk[cut - 1].isspace():
                return self.known(chunk[:cut]) + self.newline + self.known(chunk[cut:])
            elif cut == 0 and chunk[1:].isalpha():
                ids = self.piece(chunk[1:])
            else:
                ids = self.pieces(" " + chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self.young) >= MEMO_ENTRIES:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids
        return ids

    def known(self, chunk: str) -> bytes:
        return self.young.get(chunk) or self.spaced(chunk)

    def marks(self, run: str) -> bytes:
        """The ids of a run of ASCII marks; short runs are few."""
        if len(run) > 4:
            return self.piece(run)
        if run not in self.runs:
            self.runs[run] = self.piece(run)
        return self.runs[run]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _BESIDE_SPACE.search(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        known, missing = self.young.get, self.spaced
        return self.pieces(first) + b"".join([known(chunk) or missing(chunk) for chunk in rest])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Broadcast[Vocabulary]) -> Encoder:
    """One encoder per Python worker and vocabulary, so that its memo outlives a task."""
    key = id(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


def share(spark: SparkSession, path: str, pattern: str) -> Broadcast[Vocabulary]:
    ship(spark)
    return spark.sparkContext.broadcast(Vocabulary.read(path, pattern))


def packed_ids(text: Column, vocabulary: Broadcast[Vocabulary]) -> Column:
    """The ids of a text as little-endian bytes: two a token below 65,536 ids, else four."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            yield pa.array((encoder.encode(t.as_py() or "") for t in batch), pa.binary())

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "binary")(text)


def token_ids(text: Column, vocabulary: Broadcast[Vocabulary]) -> Column:
    """The ids of a text as an array."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            packed = [encoder.encode(t.as_py() or "") for t in batch]
            ends = np.cumsum([0] + [len(p) // encoder.width for p in packed]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), f"<u{encoder.width}").astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")(text)


def decoded_bytes(ids: Column, vocabulary: Broadcast[Vocabulary]) -> Column:
    """The bytes of an array of ids."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = vocabulary.value.tokens.__getitem__
        for batch in batches:
            yield pa.array((b"".join(map(token, i.values.to_pylist())) if i.is_valid else b"" for i in batch), pa.binary())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "binary")(ids)


def both_ways(text: Column, vocabulary: Broadcast[Vocabulary]) -> Column:
    """``ids`` of a text and the ``decoded`` bytes of those ids, in one Python worker."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        token = encoder.tokens.__getitem__
        for batch in batches:
            packed = [encoder.encode(t.as_py() or "") for t in batch]
            ends = np.cumsum([0] + [len(p) // encoder.width for p in packed]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), f"<u{encoder.width}").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            decoded = pa.array((b"".join(map(token, values[a:b].tolist())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), pa.binary())
            yield pa.StructArray.from_arrays([ids, decoded], fields=list(kind))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<ids:array<int>,decoded:binary>")(text)


def encode_documents(docs: DataFrame, vocabulary: Broadcast[Vocabulary]) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` bytes of every whole text."""
    return docs.select("doc_id", both_ways(F.col("text"), vocabulary).alias("x")).select("doc_id", "x.ids", "x.decoded")


def digests(encoded: DataFrame, *further: str) -> DataFrame:
    """Counts and SHA-256 digests of encoded documents, with ``further`` columns of theirs."""
    return encoded.select(
        "doc_id", *further,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
