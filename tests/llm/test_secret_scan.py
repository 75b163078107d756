import random

import pytest
from pyspark.sql import functions as F

from pairset.llm import secret_scan as ss

from .conftest import words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(300):
        text = words(30, i)
        if i % 4 == 0:
            text += f' password={token(18)} {words(5, i)}'
        if i % 4 == 1:
            text += f' token = "{token(40)}" {words(5, i)}'
        if i % 4 == 2:
            text += f" internationalisation{'abcdefghij'[i % 10]}ofthings {words(5, i)}"
        rows.append((i, text))
    return rows


def test_held_out_findings(docs, corpus):
    table = docs(*corpus)
    hidden = lambda rows: F.when(F.col("doc_id") % 5 != 0, ss.known_formats(rows))
    got = {r.doc_id: r for r in ss.scan(table, labelled=hidden).collect()}
    unseen = [i for i in got if i % 5 == 0]
    right = [(len(got[i].secrets) == 1) == (i % 4 in (0, 1)) for i in unseen]
    assert sum(right) / len(right) >= 0.95
    secret = got[0].secrets[0]
    assert corpus[0][1][secret.start: secret.end] == secret.value and len(secret.value) == 18


def test_placeholders_paths_and_long_texts(docs, corpus):
    long = "é😀" * 40_000 + ' password=0a1b2c3d4e5f60718293 ' + "x" * 60_000
    got = {r.doc_id: r for r in ss.scan(docs(*corpus, (900, "password=your-example-1234567"), (901, long), (902, None), (903, ""), (903, ""))).collect() if r.doc_id >= 900}
    assert len(got[900].secrets) == 0 and [s.start for s in got[901].secrets] == [80_010]
    assert got[902].candidates == got[903].candidates == 0 and len(got[903].secrets) == 0


def test_repeated_rows_and_missing_path(docs, corpus):
    table = docs(*corpus, corpus[0]).drop("source")
    got = [r for r in ss.scan(table).collect() if r.doc_id == 0]
    assert len(got) == 2 and got[0] == got[1] and len(got[0].secrets) == 1


@pytest.mark.parametrize("rows", [[], [(1, "plain text")], [(1, "password=0a1b2c3d4e5f60718293")]])
def test_without_labels_of_both_kinds(docs, rows):
    table = docs(*rows) if rows else docs().limit(0)
    assert [len(r.secrets) for r in ss.scan(table).collect()] == ([1] if rows and "pass" in rows[0][1] else [0] * len(rows))
