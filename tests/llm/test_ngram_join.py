import itertools
import random

import numpy as np
import pytest

from pairset.llm import ngram_join, shingles

from .conftest import words


def brute(rows, threshold=0.8):
    """Links and classes by comparing all pairs."""
    sets = {i: set(shingles.shingle_set(t or "").tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def result(joined):
    return {r.doc_id: (r.class_id, r.n_links) for r in joined.collect()}


def family(rng, n, length, edits, first):
    base = words(length, rng.randrange(600), stem=f"f{first % 26}").split(" ")
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(length)] = f"edit{rng.randrange(10**6)}"
        out.append((first + k, " ".join(text)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, words(60, 31 * i, stem=f"u{i}")) for i in range(40)]
    rows += family(rng, 60, 90, 2, 100) + family(rng, 5, 30, 1, 200) + family(rng, 8, 400, 9, 300)
    rows += [(400, rows[3][1]), (401, rows[3][1].upper() + "!"), (402, ""), (403, None), (404, "one two"), (405, "One, two."), (406, "one")]
    shared = words(30, 9, stem="boiler")
    return rows + [(500 + i, shared + " " + words(200, 17 * i, stem=f"v{i}")) for i in range(30)]


@pytest.mark.parametrize("bucket", [500, 8])
def test_equals_brute_force(docs, corpus, bucket):
    assert result(ngram_join.join(docs(*corpus), bucket=bucket)) == brute(corpus)


def test_one_of_each(docs, corpus):
    table = docs(*corpus, corpus[0])
    kept = ngram_join.one_of_each(table, ngram_join.join(table))
    want = {c for c, _ in brute(corpus).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == table.columns


def test_rows_of_one_id_and_without_one_stay_by_their_text(docs):
    texts = [words(40, 50 * k, stem=f"t{k}") for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (7, texts[4]), (3, texts[4]), (None, texts[4])]
    left = ngram_join.without_near_duplicates(docs(*rows, (8, None), (8, ""), (9, "")))
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (3, texts[4]), (8, ""), (9, "")]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=order) == sorted(want, key=order)
    assert left.columns == docs(*rows).columns
    table = docs(*rows)
    by_id = [(r.doc_id, r.text) for r in ngram_join.one_of_each(table, ngram_join.join(table)).collect()]
    assert {t for i, t in by_id if i is None} == {texts[0], texts[1], texts[4]} and {t for i, t in by_id if i == 5} == {texts[2], texts[3]}


def test_repeated_rows_and_no_rows(docs):
    assert result(ngram_join.join(docs((1, "a b c d e f"), (1, "a b c d e f"), (2, "")))) == {1: (1, 0), 2: (2, 0)}
    assert result(ngram_join.join(docs().limit(0))) == {}


def test_sketch_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 9000).astype(np.uint64))
    same = [(shingles.sketch(a[:6000]) == shingles.sketch(a[k: 6000 + k])).mean() for k in (0, 600, 3000)]
    assert same[0] == 1 and abs(same[1] - 0.82) < 0.2 and same[2] < 0.6


def test_runs_reach_the_recall():
    n = ngram_join.runs_for(0.8, 0.9995)
    assert (1 - 0.8**2) ** n <= 0.0005 < (1 - 0.8**2) ** (n - 1)


def test_texts_of_shared_passages_meet_after_many_splits(docs):
    rng = random.Random(11)
    passages = [words(24, 29 * k, stem=f"p{k}") for k in range(24)]
    rows = []
    for i in range(250):
        text = " ".join(rng.sample(passages, 6)).split(" ")
        rows.append((2 * i, " ".join(text)))
        text[105] = text[70] = text[35] = f"edit{i}"
        rows.append((2 * i + 1, " ".join(text)))
    want = brute(rows)
    assert sum(n for _, n in want.values()) >= 500
    assert result(ngram_join.join(docs(*rows), bucket=2)) == want
