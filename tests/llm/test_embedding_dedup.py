import numpy as np
import pytest

from pairset.llm import embedding_dedup as ed
from pairset.llm.ngram_join import _forest

SCHEMA = "vec_id long, embedding array<float>, label int, score string, node int"


def brute(rows, threshold=0.98):
    usable = [(i, np.array(v, np.float64), y) for i, v, y in rows if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, ids = dict.fromkeys((r[0] for r in rows), 0), sorted(r[0] for r in rows)
    a, b = [], []
    for k, (i, v, y) in enumerate(usable):
        for j, w, z in usable[k + 1:]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i] += 1
                links[j] += 1
                a.append(ids.index(i))
                b.append(ids.index(j))
    least = _forest(np.array(ids), np.array(a, int), np.array(b, int)) if a else np.array(ids)
    return {i: (links[i], int(least[k])) for k, i in enumerate(ids)}


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for size, label in [(1, 0)] * 120 + [(6, 1)] * 8 + [(90, 2), (40, 0)]:
        base = rng.normal(size=24)
        for _ in range(size):
            v = (base + rng.normal(size=24) * 0.06).astype(np.float32)
            rows.append((i, [float(x) for x in v], label))
            i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 1), (i + 2, rows[0][1], None), (i + 3, None, 0), (i + 4, [0.0] * 24, 0)]
    rows += [(i + 5, [float("nan")] + [1.0] * 23, 0), (i + 6, [None] + [1.0] * 23, 0), (i + 7, [], 0), (i + 8, rows[0][1][:12], 0), (i + 9, [2 * x for x in rows[0][1]], 0)]
    return rows


@pytest.mark.parametrize("shard", [2_000, 40])
def test_equals_brute_force(spark, shard):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = ed.near_duplicates(df, ed.Settings(shard=shard)).collect()
    want = brute(rows)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    found = sum(r.n_links for r in got) / sum(n for n, _ in want.values())
    assert found == 1 if shard == 2_000 else found >= 0.95
    assert np.mean([r.component_id == want[r.vec_id][1] for r in got]) >= (1 if shard == 2_000 else 0.95)


def test_links_are_whole_where_the_builds_are_not(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    build = ed._links
    monkeypatch.setattr(ed, "BUILDS", 1)
    monkeypatch.setattr(ed, "_links", lambda *a: build(*a).where("node % 3 = 0"))
    got = ed.near_duplicates(df, ed.Settings(shard=40)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_the_audit_sees_sparse_links(spark):
    rng = np.random.default_rng(7)
    hot = rng.normal(size=24)
    rows = [(i, (hot + rng.normal(size=24) * 0.01).tolist(), 0) for i in range(60)]
    for i in range(60, 400, 2):
        v = rng.normal(size=24)
        rows += [(i, v.tolist(), 0), (i + 1, (v + 0.001).tolist(), 0)]
    classes = ed.classes_of(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).selectExpr("vec_id", "embedding", "cast(label as long) label"))
    links = ed.exact_links(classes, ed.Settings(shard=100))
    assert ed.audit(classes, links, 0.98, 1_000) == 1
    assert ed.audit(classes, links.where("node < 60"), 0.98, 1_000) < 0.3 and ed.audit(classes, links.limit(0), 0.98, 1) == 0


def test_a_class_goes_to_every_medoid_within_the_slack():
    import pyarrow as pa

    units = [np.array(v, np.float64) / np.linalg.norm(v) for v in ([1, 0.1, 0], [1, 0, 0.1], [1, -0.1, 0], [0, 1, 0])]
    batch = pa.RecordBatch.from_pydict({"shard": [1], "node": [1], "unit": [np.array([1.0, 0, 0]).tobytes()], "copies": [1], "medoids": [[u.tobytes() for u in units]]})
    assert next(iter(ed._nearest(3.0)(iter([batch]))))["to"].to_pylist() == [[0, 1, 2]]


def test_robust_pruning_keeps_directions_apart():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1], [-1, 0.05]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = ed.robust_prune(x, 0, np.arange(5), 4, 1.2)
    assert kept[0] == 1 and 2 not in kept and len(kept) < 4


def test_every_class_is_reachable():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(80, 16)), rng.normal(size=16) + 0.01 * rng.normal(size=(120, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = [np.fromiter(a, int, len(a)) for a in ed.flat_graph(x, np.arange(200), ed.Settings())]
    for i in (0, 100, 199):
        found, similar = ed.range_search(x, x[i], graph, int((x @ x.mean(0)).argmax()), 0.9, 24)
        assert set(found) == set(np.flatnonzero(x @ x[i] >= 0.9)) and np.allclose(similar, x[found] @ x[i])


def test_empty_table(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
