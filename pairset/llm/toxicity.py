"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased, look-alike digits are folded into letters, and it is cut into bags of ``bag_words`` words. The features of a bag are the byte n-grams of its
words, word boundaries included, and the words themselves, hashed into ``2^bits`` rows of an embedding. Their
mean goes through a linear softmax. A document is as toxic as its most toxic bag, so a few words in a long text
count; in training, the bags of a toxic document carry its
gradient by how toxic they are, and every bag of a clean one does.
An unseen misspelling shares most n-grams with the known word, and so most of its vector.

Training takes at most ``train_toxic`` and ``train_clean`` labelled documents, those with the smallest hash of
the id: a bounded sample whatever the corpus. Scoring is row-wise and reads the text alone.

NULL and empty texts are one empty bag: they score the bias. Labels that are NULL, or that differ for one
``doc_id``, are not learnt from; repeated labels count once. Without labels of both classes every score is the share of class 1 (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.llm.common import mixed
from pairset.session import ship

_P = np.uint64(0x100000001B3)
#: ASCII lower case, with digits and signs that stand for letters folded into them.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ013457@$!", b"abcdefghijklmnopqrstuvwxyzoieastasi")
_PLACES = mixed(np.arange(1, 256)) | np.uint64(1)


@dataclass
class Model:
    """Embedding (2^bits x dims), weights (dims x 2) and biases."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bag_words: int
    sizes: tuple[int, ...]
    bits: int

    def margins(self) -> np.ndarray:
        """What each n-gram adds to log-odds: mean and softmax are linear in the embedding."""
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def features(text: str, bag_words: int, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed n-grams of a text, the bag of each, and the number of bags. Words are runs of bytes above 0x20."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8)
    blank = raw <= 32
    begins = np.zeros(len(raw), bool)
    begins[1:] = blank[:-1] & ~blank[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    words = np.cumsum(begins)
    byte = np.where(blank, 32, raw).astype(np.uint64) + np.uint64(1)
    upto = np.concatenate([[0], np.cumsum(blank)])
    keys, at = [], []
    running = np.zeros(len(byte) + 1, np.uint64)
    for n in range(1, max(sizes) + 1):
        running = running[: len(byte) - n + 1] * _P + byte[n - 1:]
        if n in sizes:  # an n-gram may begin or end with a blank but not hold one inside
            i = np.flatnonzero(upto[n - 1: len(byte)] == upto[1: len(byte) - n + 2])
            keys.append(running[i] * np.uint64(2 * n + 1))
            at.append(i)
    # whole words: a sum of bytes weighted by their place in the word
    place = np.arange(len(byte)) - np.concatenate([[0], starts])[words]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * _PLACES[place % len(_PLACES)], dtype=np.uint64)])
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    keys.append(sums[ends] - sums[starts])
    at.append(starts)
    # a leading blank belongs to the word after it
    bag = (words[np.concatenate(at) + 1] - 1) // bag_words
    hashed = (np.concatenate(keys) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return hashed.astype(np.int64), bag, (len(starts) - 1) // bag_words + 1


def bag_margins(table: np.ndarray, bias: float, hashed: np.ndarray, bag: np.ndarray, n_bags: int) -> np.ndarray:
    """Log-odds of class 1 for every bag; a bag without n-grams has the bias."""
    sums = np.bincount(bag, table[hashed], n_bags)
    return sums / np.maximum(np.bincount(bag, minlength=n_bags), 1) + bias


def train(
    texts: list[str], labels: np.ndarray, *, dims: int = 8, bits: int = 18, bag_words: int = 6,
    sizes: tuple[int, ...] = (3, 4, 5), epochs: int = 40, rate: float = 0.5, decay: float = 1e-6, sharpness: float = 4.0, seed: int = 7,
) -> Model:
    """Fit embedding and softmax together by Adam over full batches."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (1 << bits, dims)).astype(np.float32)
    weights = rng.normal(0, 0.5, (dims, 2)).astype(np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros_like(embedding), weights, np.array([0.0, 20.0 * share - 10.0], np.float32), bag_words, sizes, bits)
    chunks = list(_chunks(texts, labels, bag_words, sizes, bits))
    totals = (labels == 0).sum(), (labels == 1).sum()
    e, w, b = embedding, weights, np.array([0.0, -2.0], np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    for epoch in range(1, epochs + 1):
        table = e @ (w[:, 1] - w[:, 0])
        per_gram, slope = np.zeros(len(e), np.float64), 0.0
        for c in chunks:
            margin = bag_margins(table, b[1] - b[0], c.hashed, c.bag, len(c.toxic))
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            bags = np.repeat(c.n_bags, c.n_bags)
            # a toxic document's bags share its weight, evenly at first and then more and more by how toxic they are
            heat = margin * (sharpness * (epoch - 1) / epochs)
            heat = np.exp(heat - np.repeat(np.maximum.reduceat(heat, c.first), c.n_bags))
            heat /= np.repeat(np.add.reduceat(heat, c.first), c.n_bags)
            part = np.where(c.toxic, heat, 1 / np.sqrt(bags))
            # each class weighs the same
            delta = (p - c.toxic) * part * np.where(c.toxic, 0.5 / totals[1], 0.5 / totals[0])
            lengths = np.maximum(np.bincount(c.bag, minlength=len(delta)), 1)
            per_gram += np.bincount(c.hashed, (delta / lengths)[c.bag], len(e))
            slope += delta.sum()
        pooled = e.T @ per_gram.astype(np.float32)
        grads = [
            np.outer(per_gram.astype(np.float32), w[:, 1] - w[:, 0]) + np.float32(decay) * e, np.stack([-pooled, pooled], 1) + decay * w,
            np.array([-slope, slope], np.float32),
        ]
        for x, g, (m, v) in zip((e, w, b), grads, state, strict=True):
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            x -= np.float32(rate) * (m / np.float32(1 - 0.9**epoch)) / (np.sqrt(v / np.float32(1 - 0.999**epoch)) + np.float32(1e-8))
    used = np.zeros(len(e), bool)
    for c in chunks:
        used[c.hashed] = True
    embedding[~used] = 0  # n-grams never seen in training add nothing
    return Model(embedding, w, b, bag_words, sizes, bits)


@dataclass
class _Chunk:
    """N-grams of some training documents, with the bags they fall into and the documents' first bags."""

    hashed: np.ndarray
    bag: np.ndarray
    n_bags: np.ndarray
    first: np.ndarray
    toxic: np.ndarray


def _chunks(texts: list[str], labels: np.ndarray, bag_words: int, sizes: tuple[int, ...], bits: int, grams: int = 1_000_000) -> Iterator[_Chunk]:
    """Training features in chunks of about a million n-grams, so that a pass over them needs little memory."""
    parts: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
    held = 0
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        hashed, bag, n = features(text, bag_words, sizes, bits)
        parts.append((hashed.astype(np.int32), bag.astype(np.int32), n, bool(label)))
        held += len(hashed)
        if held >= grams or k == len(texts) - 1:
            n_bags = np.array([p[2] for p in parts])
            first = np.concatenate([[0], np.cumsum(n_bags)[:-1]])
            yield _Chunk(
                np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + np.int32(o) for p, o in zip(parts, first, strict=True)]),
                n_bags, first, np.repeat([p[3] for p in parts], n_bags),
            )
            parts, held = [], 0


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, train_toxic: int = 600, train_clean: int = 1_800, **settings: float) -> Model:
    """Train on at most ``train_toxic`` and ``train_clean`` documents that are not held out."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
        .where(F.col("low") == F.col("high"))
        .select("doc_id", F.col("low").alias("toxic"), F.xxhash64("doc_id").alias("at"))
    )
    chosen = [known.where(F.col("toxic") == c).orderBy("at", "doc_id").limit(n) for c, n in ((0, train_clean), (1, train_toxic))]
    bounded = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most train_toxic + train_clean ids
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(bounded, "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    )
    return train([r.text for r in rows], np.array([r.toxic for r in rows], np.int64), **settings)


def score(text: Column, model: Model, docs: DataFrame) -> Column:
    """The probability of class 1 of the most toxic bag."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0]), model.bag_words, model.sizes, model.bits))

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, bias, bag_words, sizes, bits = shared.value
        for batch in batches:
            top = [bag_margins(table, bias, *features(t.as_py() or "", bag_words, sizes, bits)).max() for t in batch]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(top, np.float64), -30, 30))))

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scores, "double")(text)
