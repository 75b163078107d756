import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairset.llm import decontaminate as dc

from .conftest import words

QUESTION = "Which of the two rivers that meet below the old town carries more water in spring?"
ANSWER = "The northern one carries more because of melting snow."
ITEMS = "item_id long, text string, score string"


@pytest.fixture
def items(spark):
    rows = [(i, words(30 + i % 20, 40 * i, stem=f"t{i}")) for i in range(40)]
    rows += [(100, f"{QUESTION} {ANSWER}"), (101, None), (102, ""), (100, f"{QUESTION} {ANSWER}")]
    return spark.createDataFrame([(*r, "x") for r in rows], ITEMS)


def test_verified_pairs(docs, items):
    filler = words(400, stem="z")
    table = docs(
        (1, f"{filler} {QUESTION} {ANSWER} {filler}"), (2, f"{filler} {QUESTION} {filler}"), (3, filler), (4, None), (5, ""),
        (6, f"{QUESTION.upper()}\n{ANSWER}"), (6, f"{QUESTION.upper()}\n{ANSWER}"), (7, (filler + " ") * 60 + QUESTION + " " + ANSWER),
    )
    got = sorted((r.doc_id, r.item_id, r.verified) for r in dc.pairs(table, items).collect() if r.verified)
    assert got == [(1, 100, True), (6, 100, True), (6, 100, True), (7, 100, True)]
    assert {r.doc_id for r in dc.pairs(table, items).collect()} >= {1, 6, 7}
    kept = dc.clean(table, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == table.columns


def impacts(terms_of_items):
    """The share of what retrieves an item that each of its terms gives, from the formula."""
    n, mean = len(terms_of_items), sum(map(len, terms_of_items)) / len(terms_of_items)
    df = Counter(term for item in terms_of_items for term in set(item))
    found = []
    for item in terms_of_items:
        weight = {}
        for term, tf in Counter(item).items():
            idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
            weight[term] = idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(item) / mean))
        found.append({t: w / (0.5 * sum(weight.values())) for t, w in weight.items()})
    return found


@pytest.mark.parametrize("part_words", [100, 2_000_000])
def test_search_equals_all_scores(spark, part_words, monkeypatch):
    monkeypatch.setattr(dc, "ENTRIES_AT_ONCE", 40)
    rng = random.Random(5)
    vocabulary = [f"w{int(1.06 ** rng.uniform(0, 100))}" for _ in range(4_000)]  # a few very frequent words
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 20, 40, 90]))) for _ in range(120)]
    index, n_parts = dc.build(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), part_words=part_words)
    shards = [shard for part in range(n_parts) for shard in dc.load(index, part)]
    assert sorted(i for shard in shards for i in shard.item_ids.tolist()) == list(range(120)) and (n_parts > 1) == (part_words == 100)
    terms_of_items = [t.split() for t in items]
    shares = impacts(terms_of_items)
    texts = [rng.choices(vocabulary, k=150) + terms_of_items[k][: rng.randrange(2, 90)] + rng.choices(vocabulary, k=20) for k in range(12)]
    hits = 0
    for text in texts:
        hashes = dc.word_hashes(" ".join(text))
        for shard in shards:
            starts = np.arange(0, len(text), shard.window // 2)
            ends = np.minimum(starts + shard.window, len(text))
            got = {}
            for passage, item, score in dc.search(hashes, starts, ends, shard):
                got |= {(p, int(shard.item_ids[i])): s for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist())}
            want = {}
            for p, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                passage = set(text[s:e])
                sums = {k: sum(x for t, x in shares[k].items() if t in passage) for k in shard.item_ids.tolist()}
                want |= {(p, k): x for k, x in sums.items() if x >= dc.ENOUGH}
            assert got == pytest.approx(want)
            hits += len(want)
    assert hits > 100


def test_every_item_lies_whole_in_a_passage(spark, docs):
    items = [(k, words(n, 100 * k, stem=f"q{k}x")) for k, n in enumerate([10, 11, 15, 16, 17, 40, 63, 64, 100])]
    index = spark.createDataFrame(items, "item_id long, text string")
    table = docs(*[(100 * k + before, f"{words(before, stem='z')} {text} {words(after, stem='y')}") for k, text in items
                   for before, after in ((0, 0), (7, 0), (0, 7), (31, 3), (97, 211))])
    got = {(r.doc_id, r.item_id) for r in dc.pairs(table, index).where("question = 1 AND answer = 1").collect()}
    assert got == {(100 * k + before, k) for k, _ in items for before in (0, 7, 31, 97)} and not dc.clean(table, index).count()


def test_very_long_texts_and_equal_items(spark, docs, items):
    both = items.select("item_id", "text").unionByName(spark.createDataFrame([(7_000, f"{QUESTION} {ANSWER}"), (None, f"{QUESTION} {ANSWER}")], "item_id long, text string"))
    table = docs((1, words(200_000, stem="z") + f" {QUESTION} {ANSWER} " + words(50_000, stem="y")), (2, words(250_000, stem="z")))
    got = dc.pairs(table, both).where("verified").collect()
    assert sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in got) == [(1, 100, 1.0), (1, 7_000, 1.0)]


def test_columns_of_the_documents_stay(docs, items):
    clashing = docs((1, "a b"), (2, f"{QUESTION} {ANSWER}"))
    for name in ("contamination", "item_id", "verified", "part", "words"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    kept = dc.clean(clashing, items)
    assert kept.columns == clashing.columns and [(r.doc_id, r.contamination, r.part) for r in kept.collect()] == [(1, "mine", "mine")]
    assert [r.item_id for r in dc.pairs(clashing, items).where("verified").collect()] == [100]


def test_no_items_and_no_rows(spark, docs, items):
    none = spark.createDataFrame([], ITEMS)
    assert dc.pairs(docs((1, "a b")), none).count() == 0 and dc.clean(docs((1, "a b")), none).count() == 1
    assert dc.pairs(docs().limit(0), items).count() == 0


def test_several_parts_find_the_same(docs, items):
    table = docs((1, f"{QUESTION} {ANSWER} " + words(40, 400, stem="t10")), (2, "a b"), (3, words(40, 400, stem="t10")))
    one = dc.pairs(table, items).select("doc_id", "item_id").collect()
    many = dc.pairs(table, items, part_words=400).select("doc_id", "item_id").collect()
    assert sorted(one) == sorted(many) and len(one) == 3
    assert [r.doc_id for r in dc.clean(table, items, part_words=400).collect()] == [2]


def test_short_items_are_verified_by_equal_texts_only(spark, docs):
    items = spark.createDataFrame([(1, "the"), (2, "yes or no"), (3, words(12))], "item_id long, text string")
    rows = docs((1, "the cat and the dog say yes or no"), (2, "the"), (3, "Yes, or no?"), (4, "no or yes"), (5, "x " + words(12) + " the y"))
    assert sorted(r.doc_id for r in dc.clean(rows, items).collect()) == [1, 4]
