import hashlib
import math
import random

import numpy as np

from pairset.llm import vector_codes as vc

ROWS = "vec_id long, embedding array<float>, label int, code string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in rows], ROWS)


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over Python integers; vectors padded to whole parts."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    cut = [[(v + [0] * (width * parts))[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted((i, v, k) for k, (i, v, _) in enumerate(kept) if i is not None)[:entries]
    books = [[cut[k][p] for _, _, k in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut:
                groups.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    final = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in final]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{e:02x}" for _, e in f), error, sum(e for e, (_, _, m) in zip(errors, kept, strict=True) if m == label), sha)
                  for (i, _, label), f, error in zip(kept, final, errors, strict=True))


def got(df, **settings):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.compress(df, **settings).collect())


def vectors(n, dim, seed=0, scale=0.3):
    rng = random.Random(seed)
    return [[round(rng.gauss(0, scale), 3) for _ in range(dim)] for _ in range(n)]


def test_equals_brute_force(spark):
    rows = [(1000 - i, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors(260, 32))]
    df = table(spark, rows).repartition(7)
    assert got(df) == brute(rows)
    assert got(df, cell=1000) == got(df, cell=3, memo_cells=5) == brute(rows)


def test_left_out_padded_repeated_and_null_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, None, 1), (6, [0.1, None] * 8, 1), (7, [nan] * 16, 1), (8, [inf] * 16, 1), (8, [-inf] * 16, None), (None, [0.5] * 16, None),
            (9, [0.25] * 20, 2), (9, [0.25] * 20, 2), (9, [-0.001] * 16, 2), (3, [], 2), (4, [1e30] * 16, 1), (2, [-0.7] * 17, None)]
    want = brute([r for r in rows if r[0] != 4])
    assert got(table(spark, [r for r in rows if r[0] != 4])) == want
    assert [r[2] for r in want] == [0] * 5 + [want[-1][2]] and len(want) == 6
    assert len(got(table(spark, rows))) == 7


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [0.1 * (i % 2)] * 16, 0) for i in range(100)]
    assert got(table(spark, rows)) == brute(rows)
    assert {r[1] for r in got(table(spark, rows))} == {"00" * 16, "01" * 16}


def test_few_or_no_vectors(spark):
    assert got(table(spark, [(1, [0.5] * 16, None)]))[0][1:4] == ("00" * 16, 0, 0)
    empty = table(spark, [])
    assert vc.compress(empty).count() == 0 and vc.compress(table(spark, [(1, None, 1)])).count() == 0


def test_long_vectors(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(90, 16 * 120))]
    assert got(table(spark, rows)) == brute(rows)


def test_grid_keeps_every_nearest_entry():
    rng = np.random.default_rng(3)
    points, entries = rng.integers(-90, 90, (5000, 4)), rng.integers(-90, 90, (64, 4))
    entries[40] = entries[12]
    grid = vc.Grid(entries, cell=32)
    index, distance = grid.assign(points)
    far = ((points[:, None] - entries) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (distance == far.min(1)).all()
    assert sum(map(len, grid.memo.values())) < 64 * len(grid.memo)


def test_group_sums_of_a_hot_key(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i, 1 << 62 if i < 9 else 1) for i in range(90)], "id int, label int, error long")
    out = {r.id: r.label_error for r in vc.with_group_sum(rows, "label", "error", "label_error").collect()}
    assert len(out) == 90 and out[0] == 1 << 62 and out[9] == 1 and out[1] is None
