import hashlib
import math
import random
import re
import zlib

import pytest

from pairset.llm import prefix_trie as pt

ROWS = "conv_id long, turn long, role string, text string, node string, depth long, block int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS)


def brute(rows):
    said = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        said.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = said.get(int(c - math.fmod(c, 20)), [])[:h] + own[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])),
                    sum(p not in children for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **settings):
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.trie(df, **settings).collect()), key=str)


def conversations(n, seed=0, low=0):
    rng = random.Random(seed)
    texts = ["hello there", "a b  c", "", "one word", "x " * 40, None]
    rows = []
    for c in range(low, low + n):
        if rng.random() < 0.15:
            continue
        hot = c % 3 == 0
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if t or c % 7 else None, "user" if hot else rng.choice(["user", "system", None]), texts[t % 6] if hot else rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard_conversations": 3}, {"shard_turns": 5}])
def test_equals_brute_force(spark, settings):
    rows = conversations(150)
    assert got(table(spark, rows).repartition(5), **settings) == brute(rows)


def test_negative_and_missing_donors(spark):
    rows = conversations(50, 1, -45) + [(1 << 40, 0, "user", "far"), (25 + (1 << 40), 1, "user", "a b")]
    assert got(table(spark, rows), shard_conversations=4) == brute(rows)


def test_one_hot_conversation_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    out = got(table(spark, rows), shard_conversations=16)
    assert out == brute(rows) and [r[3] for r in out] == [300] * 4


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 >= 1)
    assert got(table(spark, [(c, 0, "user", "gone")])) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_null_ids_long_texts_ties_and_repeats(spark):
    rows = [(None, 0, "user", "x"), (20, 0, "user", "w " * 100_000), (40, 0, "user", "w " * 100_000), (40, 1, None, None), (40, 1, None, None)]
    assert got(table(spark, rows)) == brute(rows)
    tied = [(60, 1, "b", "y"), (60, 1, "a", "x")]
    assert got(table(spark, tied)) == got(table(spark, tied[::-1]))


def test_long_conversation(spark):
    rows = [(20 * k, t, "user", str(t)) for k in range(3) for t in range(1500 + k)]
    out = got(table(spark, rows), shard_conversations=1)
    assert len(out) == 1503 and max(r[6] for r in out) == 2 * 1500 + 1


def test_role_and_text_are_kept_apart(spark):
    assert len(got(table(spark, [(0, 0, "ab", "c"), (20, 0, "a", "bc")]))) == 3


def test_empty_table(spark):
    assert pt.trie(table(spark, [])).count() == 0 and pt.trie(table(spark, [(None, 1, "a", "b")])).count() == 0
