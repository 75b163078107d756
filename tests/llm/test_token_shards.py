import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairset.llm import token_shards as ts
from pairset.llm.common import stored

SMALL = ts.Layout(length=16, per_shard=4)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096, 5000])
def test_the_permutation_has_every_slot_once(n):
    got = ts.permuted(np.arange(n), n, 7, 6)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != ts.permuted(np.arange(n), n, 8, 6)).mean() > 0.9 and abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.2


def sequences(texts, layout):
    flat = b"".join((t or "").encode() + bytes([layout.end]) for t in texts)
    parts = [flat[k: k + layout.length] for k in range(0, len(flat), layout.length)]
    return [p + bytes([layout.pad]) * (layout.length - len(p)) for p in parts]


def test_round_trip_and_seek(spark, docs, tmp_path):
    texts = ["alpha\n\nbeta", "", None, "é" * 40, "x", "x", "long " * 100]
    rows = stored(docs(*enumerate(texts)).coalesce(1).select("doc_id", ts.byte_tokens(F.col("text")).alias("tokens")), "tokens")
    shards = ts.write(rows, str(tmp_path / "shards"), SMALL)
    want = sequences(texts, SMALL)
    assert shards.sequences == len(want)
    got = {r.slot: bytes(r.record) for r in ts.read(spark, shards).collect()}
    slots = ts.permuted(np.arange(len(want)), len(want), SMALL.key, SMALL.rounds)
    assert got == {int(s): w for s, w in zip(slots, want, strict=True)}
    # one seek finds any slot
    files = sorted(glob.glob(str(tmp_path / "shards" / "part-*")))
    assert len(files) == -(-len(want) // SMALL.per_shard)
    for slot, record in got.items():
        with open(files[slot // SMALL.per_shard], "rb") as f:
            f.seek(slot % SMALL.per_shard * SMALL.stride)
            assert f.read(SMALL.length) == record
    # segments lead back to the rows
    text = {i: (t or "").encode() + bytes([SMALL.end]) for i, t in enumerate(texts)}
    for r in ts.described(spark, shards).collect():
        assert b"".join(text[s.doc_id][s.start: s.start + s.size] for s in r.segments) == got[r.slot][: r.n_tokens]


def test_wide_ids_over_several_partitions(spark, tmp_path):
    layout = ts.Layout(width=2, length=8, per_shard=3, end=50_256, pad=50_257)
    ids = {i: list(range(i, i + i % 23)) for i in range(60)}
    raw = [(i, bytearray(np.array(v, "<u2").tobytes())) for i, v in ids.items()]
    rows = stored(spark.createDataFrame(raw, "doc_id long, tokens binary").repartition(5), "tokens")
    shards = ts.write(rows, str(tmp_path / "s"), layout)
    held = np.concatenate([np.frombuffer(bytes(r.record), "<u2") for r in ts.read(spark, shards).collect()])
    want = sorted([x for v in ids.values() for x in v] + [50_256] * 60)
    assert sorted(held[held != 50_257].tolist()) == want and ts.read(spark, shards).count() == shards.sequences


def test_empty_table(spark, docs, tmp_path):
    rows = docs().limit(0).select("doc_id", ts.byte_tokens(F.col("text")).alias("tokens"))
    assert ts.write(rows, str(tmp_path / "none")).sequences == 0


def test_a_changed_table_fails(spark):
    run = ts._pieces(SMALL, {0: (0, 5)}, 1, False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([1, 2]), pa.array([3, 3])], ["part", "doc_id", "n"])
    with pytest.raises(RuntimeError):
        list(run(iter([batch])))
