"""Newest-wins merging and tombstones over three runs (level 0, level 1, level 0, written in this order)."""

import pytest

from moraine.operators import compaction, snapshot

ROWS = "key string, value string, is_deleted boolean, level int, file_seq bigint"


def merged(spark, versions, outside=()):
    rows = [(k, v, v is None, lv, n) for k, v, lv, n in versions] + [(f"filler{n}-{i}", "x", False, lv, n) for n, lv in ((1, 0), (2, 1), (3, 0)) for i in range(5)]
    rows += [(k, "old", False, 2, 9) for k in outside]
    df = spark.createDataFrame(rows, ROWS)
    out = compaction.merge_chosen(df, spark.createDataFrame([(1,), (2,), (3,)], "file_seq bigint"))
    return {(r.key, r.value, r.is_deleted) for r in out.collect() if not r.key.startswith("filler")}


@pytest.mark.parametrize(
    "versions, outside, want",
    [
        ([("key", "value1", 0, 1), ("key", "value2", 1, 2), ("key", "value3", 0, 3)], (), {("key", "value3", False)}),
        ([("key", None, 0, 1)], (), set()),
        ([("key", None, 0, 1)], ("key",), {("key", None, True)}),
        ([("key", None, 0, 1), ("key", "value2", 1, 2), ("key", "value3", 0, 3)], (), {("key", "value3", False)}),
        ([("key", None, 0, 1), ("key", "value2", 1, 2), ("key", "value3", 0, 3)], ("key",), {("key", "value3", False)}),
        ([("key", "value1", 0, 1), ("key", "value2", 1, 2), ("key", None, 0, 3)], (), set()),
        ([("k1", None, 0, 1), ("k2", None, 1, 2), ("k3", None, 0, 3)], (), set()),
        ([("key", None, 0, 1), ("key", "value2", 1, 2)], (), set()),
    ],
)
def test_three_runs(spark, versions, outside, want):
    assert merged(spark, versions, outside) == want


def test_memtable_bytes_over_stretches(spark):
    """The same sums whatever the stretches are."""
    rows = [(i, f"k{i % 7}", 5 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, key string, size int")
    live, total, want = {}, 0, []
    for s, k, z in rows:
        total += z - live.get(k, 0)
        live[k] = z
        want.append((s, total))
    got = snapshot.memtable_bytes(df).select("seq", "mem_bytes")
    assert sorted(map(tuple, got.collect())) == want
    deltas = spark.createDataFrame([(i, i % 5) for i in range(100)], "seq bigint, d int")
    a = snapshot.running_sum(deltas, "seq", deltas["d"], "s", width=7).orderBy("seq").collect()
    assert [r.s for r in a] == [sum(j % 5 for j in range(i + 1)) for i in range(100)]


def test_duplicate_seqs(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "seq bigint")
    assert [tuple(r) for r in snapshot.duplicate_seqs(df).collect()] == [(2, 2)]
