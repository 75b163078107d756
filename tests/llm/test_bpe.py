import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairset.llm import bpe, queries

VOCABULARY = bpe.Vocabulary.read(public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)
ENCODER = bpe.Encoder(VOCABULARY)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


def ids(text):
    raw = ENCODER.encode(text)
    return [int.from_bytes(raw[i: i + 2], "little") for i in range(0, len(raw), 2)]


def test_perfect_hash_has_every_token_once():
    assert sorted(VOCABULARY.hash.ids) == list(range(len(VOCABULARY.tokens)))
    assert all(VOCABULARY.hash.candidate(t) == i for i, t in enumerate(VOCABULARY.tokens[:5000]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab E'\n\t.,é日 12#_  sldt"), max_size=60))
def test_any_text_as_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "x" * 20_000, "é" * 9_000, "it's 's a\nb", "a_\nb", "word,\nNext *** end###", "naïve 日本語 テスト"])
def test_texts(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_memo_of_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    encoder = bpe.Encoder(VOCABULARY)
    text = "one two three four five one two six seven eight one"
    assert encoder.encode(text) == ENCODER.encode(text) and len(encoder.young) <= 3


def test_query_rows(spark, docs):
    texts = [(1, "Hello wörld,\nagain"), (2, None), (3, ""), (3, ""), (None, "x")]
    got = bpe.digests(bpe.encode_documents(docs(*texts), queries.vocabulary(spark))).collect()
    assert len(got) == 5
    for r in got:
        text = dict(texts)[r.doc_id] or ""
        want = REFERENCE.encode_ordinary(text)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_null_ids_decode_to_nothing(spark):
    row = spark.range(1).select(bpe.decoded_bytes(F.lit(None).cast("array<int>"), queries.vocabulary(spark)).alias("x")).first()
    assert row.x == b""


def test_sliced_ids_decode_alone(spark):
    shared = queries.vocabulary(spark)
    df = spark.createDataFrame([(1, [64, 65]), (2, []), (3, [66])], "id long, ids array<int>")
    got = {r.id: bytes(r.x) for r in df.select("id", bpe.decoded_bytes(F.col("ids"), shared).alias("x")).collect()}
    token = VOCABULARY.tokens
    assert got == {1: token[64] + token[65], 2: b"", 3: token[66]}


def test_empty_table(docs, spark):
    assert bpe.digests(bpe.encode_documents(docs().limit(0), queries.vocabulary(spark))).count() == 0
