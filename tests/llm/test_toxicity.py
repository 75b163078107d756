import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairset.llm import toxicity

from .conftest import words


@pytest.fixture(scope="module")
def corpus():
    """Clean prose, and the same with rare insults."""
    rows = []
    for i in range(400):
        text = words(40 + i % 90, 7 * i).split(" ")
        if i % 3 == 0:
            text.insert(len(text) // 2, ("idiotic", "moronic")[i % 2])
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] + [(9_999, 1), (0, 1)], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels)


def scores(docs, model):
    return {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(F.col("text"), model, docs).alias("s")).collect()}


def test_held_out_accuracy(fitted, corpus):
    docs, _, model = fitted
    got = scores(docs, model)
    unseen = [(y, got[i] >= 0.3) for i, _, y in corpus if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([y == p for y, p in unseen]) >= 0.95


def test_misspellings_and_long_texts(spark, fitted):
    _, _, model = fitted
    long = words(3_000)
    df = spark.createDataFrame([(1, long), (2, long + " idi0tic " + long), (3, "IDIOTIC!"), (4, ""), (5, None)], "doc_id long, text string")
    got = scores(df, model)
    assert got[1] < 0.3 and got[2] >= 0.3 and got[3] >= 0.3 and got[4] == got[5] < 0.3


def test_labels_of_held_out_rows_are_never_read(spark, fitted, corpus):
    docs, labels, model = fitted
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(docs, turned).margins(), model.margins())


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None), (2, 5)], [(1, 0), (1, 1)]])
def test_without_both_classes(spark, docs, labels):
    table = docs((1, "a b"), (2, None))
    got = scores(table, toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert len(got) == 2 and all(0 <= s < 0.3 for s in got.values())


def test_empty_table(spark, docs):
    none = docs().limit(0)
    assert scores(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))) == {}
