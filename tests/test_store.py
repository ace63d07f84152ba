"""The store end to end, against a dictionary."""

import random

import pytest

from moraine.options import StoreOptions
from moraine.sources import paths
from moraine.sources.manifest import ConflictError, Manifest, ManifestLog
from moraine.store import Store, StoreClosedError, StoreLockedError
from moraine.streaming.ingest import ingest

ROWS = "seq bigint, op string, key binary, value binary"


def rows(spark, ops):
    """ops: (key, value or None) in order."""
    return spark.createDataFrame([(i, "D" if v is None else "W", bytearray(k), None if v is None else bytearray(v)) for i, (k, v) in enumerate(ops)], ROWS)


def contents(store):
    return {bytes(r.key): bytes(r.value) for r in store.snapshot().collect()}


@pytest.fixture
def store(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "db")) as s:
        yield s


def test_put_get_delete(store):
    store.put(b"key0", b"value0")
    store.put(b"key0", b"value1")
    store.delete(b"absent")
    assert store.get(b"key0") == b"value1" and store.get(b"absent") is None and store.get(b"never") is None
    store.delete(b"key0")
    assert store.get(b"key0") is None
    store.put(b"", b"")
    assert store.get(b"") == b""
    # a tombstone that is found counts as a hit
    assert (store.search_stats().ok, store.search_stats().miss) == (4, 1)
    for bad in (lambda: store.put(None, b"x"), lambda: store.put(b"x", None), lambda: store.get(None)):
        with pytest.raises(ValueError):
            bad()


def test_random_operations(spark, tmp_path):
    r, model, path = random.Random(7), {}, str(tmp_path / "db")
    store = Store.open(spark, path)
    for step in range(6):
        ops = []
        for _ in range(120):
            k = bytes(r.randrange(256) for _ in range(r.randrange(3)))
            v = None if r.random() < 0.3 else bytes(r.randrange(256) for _ in range(r.randrange(4)))
            ops.append((k, v))
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        store.apply(rows(spark, ops))
        if step % 2 == 0:
            store.flush()
        if step == 3:
            store.compact(0)
            store.close()
            store = Store.open(spark, path)
        assert contents(store) == model
    found = store.multi_get(spark.createDataFrame([(bytearray([i]),) for i in range(256)], "key binary"), record=True)
    assert {bytes(x.key): x.value and bytes(x.value) for x in found.collect()} == {bytes([i]): model.get(bytes([i])) or (None if bytes([i]) not in model else bytearray()) for i in range(256)}
    assert store.stats.total == 256
    store.flush()
    assert store.compact_all() and sum(x.n_deleted for x in store.manifest.runs) == 0
    assert contents(store) == model and store.vacuum() >= 0 and contents(store) == model
    signed = lambda k: [x - 256 if x > 127 else x for x in k]
    got = {bytes(x.key) for x in store.scan(b"\x90", b"\x10").collect()}
    assert got == {k for k in model if signed(b"\x90") <= signed(k) <= signed(b"\x10")}
    store.close()
    store.destroy()
    assert not paths.exists(spark, store.path)


def test_delete_across_runs(spark, store):
    store.put_all(spark.createDataFrame([(bytearray(b"key1"), bytearray(b"old")), (bytearray(b"other"), bytearray(b"x"))], "key binary, value binary"))
    store.flush()
    store.delete_all(spark.createDataFrame([(bytearray(b"key1"),)], "key binary"))
    store.flush()
    assert contents(store) == {b"other": b"x"} and len(store.manifest.runs) == 2
    row = store.multi_get(spark.createDataFrame([(bytearray(b"key1"),)], "key binary")).first()
    assert row.found and row.is_deleted and row.value is None and row.seeks == 1
    assert store.compact(0) and [(x.level, x.n_entries) for x in store.manifest.runs] == [(1, 1)]
    assert contents(store) == {b"other": b"x"}


def test_cached_snapshot(store):
    store.put(b"k", b"1")
    first = store.cached_snapshot()
    assert first.is_cached and store.cached_snapshot() is first
    store.put(b"k", b"2")
    assert [bytes(r.value) for r in store.cached_snapshot().collect()] == [b"2"] and not first.is_cached


def test_writes_flush_and_compact(spark, tmp_path):
    """A user who only writes: the tail is flushed once it is full, levels are compacted, and what is read stays right."""
    options = StoreOptions(flush_bytes=1 << 20, target_file_bytes=1 << 20)
    r, model = random.Random(2), {}
    with Store.open(spark, str(tmp_path / "db"), options) as store:
        for n in range(8):
            ops = [(b"k%05d" % r.randrange(2000), r.randbytes(600)) for _ in range(900)]
            store.apply(rows(spark, ops))
            model |= dict(ops)
            assert store.tail_bytes() < options.flush_bytes
        assert store.manifest.runs and any(x.level > 0 for x in store.manifest.runs)
        assert contents(store) == model
    with Store.open(spark, str(tmp_path / "db"), StoreOptions(flush_bytes=1 << 20, target_file_bytes=1 << 20, auto_flush=False)) as store:
        before = store.manifest.runs
        store.apply(rows(spark, [(b"big", bytes(2 << 20))]))
        assert store.manifest.runs == before and store.tail_bytes() > 1 << 20 and store.maybe_flush() and store.tail_bytes() == 0


def test_threads_share_a_store(spark, tmp_path):
    """Writers, readers and upkeep side by side: every read sees whole batches, and in the end all is there."""
    from concurrent.futures import ThreadPoolExecutor

    batches = {t: [[(b"t%d-%d-%d" % (t, n, i), b"v%d" % n) for i in range(20)] for n in range(4)] for t in range(4)}
    with Store.open(spark, str(tmp_path / "db"), StoreOptions(flush_bytes=1 << 20, target_file_bytes=1 << 20)) as store:

        def write(t):
            for ops in batches[t]:
                store.apply(rows(spark, ops))

        def read(_):
            for _ in range(4):
                seen = {}
                for k in contents(store):
                    seen.setdefault(k.rsplit(b"-", 1)[0], []).append(k)
                assert all(len(v) == 20 for v in seen.values())
                store.get(b"t0-0-0")

        def keep(_):
            for _ in range(3):
                store.flush()
                store.maybe_compact()

        with ThreadPoolExecutor(9) as pool:
            work = [pool.submit(write, t) for t in batches] + [pool.submit(read, i) for i in range(3)] + [pool.submit(keep, i) for i in range(2)]
            for w in work:
                w.result()
        assert contents(store) == {k: v for b in batches.values() for ops in b for k, v in ops}
        assert store.stats.total == 12


def test_many_batches_are_one_scan(spark, store):
    for n in range(40):
        store.put(b"k%d" % (n % 25), b"v%d" % n)
    plan = store.snapshot()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and len(store.manifest.tail) == 40
    assert contents(store) == {b"k%d" % (n % 25): b"v%d" % n for n in range(40)}


def test_lookups_from_the_cached_snapshot(store):
    store.put(b"a", b"1")
    store.put(b"b", b"2")
    store.delete(b"b")
    store.cached_snapshot()
    assert store.get(b"a") == b"1" and store.get(b"b") is None and store.get(b"c") is None
    assert (store.stats.ok, store.stats.miss) == (2, 1)
    store.put(b"a", b"3")
    assert store.get(b"a") == b"3"


def test_replaced_files_stay_for_readers(spark, store):
    store.put(b"a", b"1")
    early = store.snapshot()
    store.flush()
    store.put(b"a", b"2")
    store.flush()
    store.compact_all()
    assert [bytes(r.value) for r in early.collect()] == [b"1"] and contents(store) == {b"a": b"2"}


def test_a_swap_is_checked(spark, store):
    from dataclasses import replace

    store.put(b"a", b"1")
    store.flush()
    (run,) = store.manifest.runs
    bad = [(replace(run, file_seq=9), 1, ValueError, "level"), (run, 0, ValueError, "twice"), (replace(run, file_seq=9, file=run.file + "x"), 0, FileNotFoundError, "there")]
    for added, level, error, what in bad:
        with pytest.raises(error, match=what):
            store._check_swap(store.manifest, (), [added], level)
    with pytest.raises(ValueError, match="overlap"):
        store._check_swap(store.manifest, (), [replace(run, file_seq=8), replace(run, file_seq=9)], 0)


def test_small_tail_of_a_run_is_spread():
    from moraine.sources.runfiles import files_of

    assert [files_of(n, 100) for n in (0, 1, 99, 100, 120, 125, 199, 224, 250)] == [1, 1, 1, 1, 1, 2, 2, 2, 3]


def test_closed_and_locked(spark, tmp_path):
    path = str(tmp_path / "db")
    store = Store.open(spark, path)
    with pytest.raises(RuntimeError, match="open in this process"):
        Store.open(spark, path)
    with pytest.raises(RuntimeError, match="close"):
        store.destroy()
    store.close()
    store.close()
    for op in (lambda: store.get(b"x"), lambda: store.put(b"x", b"y"), store.snapshot, store.flush, lambda: store.compact(0), store.search_stats):
        with pytest.raises(StoreClosedError):
            op()
    assert paths.create_new(spark, f"{store.path}/LOCK", "another process")
    with pytest.raises(StoreLockedError):
        Store.open(spark, path)
    Store.break_lock(spark, path)
    Store.open(spark, path).close()


def test_same_key_twice_needs_order(spark, store):
    twice = spark.createDataFrame([("W", bytearray(b"k"), bytearray(b"1")), ("W", bytearray(b"k"), bytearray(b"2"))], "op string, key binary, value binary")
    with pytest.raises(ValueError, match="distinct seq"):
        store.apply(twice)
    assert contents(store) == {}
    store.apply(rows(spark, [(b"k", b"1"), (b"k", b"2")]))
    assert contents(store) == {b"k": b"2"}


def test_lost_commits_leave_nothing(spark, store):
    """A batch whose commit never happened isn't read, and vacuum deletes it."""
    store.put(b"k", b"v")
    rows(spark, [(b"k", b"lost")]).write.parquet(f"{store.path}/log/lost")
    assert contents(store) == {b"k": b"v"} and store.vacuum() == 1 and contents(store) == {b"k": b"v"}


def test_writers_conflict(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path))
    first = log.commit(Manifest())
    with pytest.raises(ConflictError):
        log.commit(Manifest())
    assert log.load() == first
    for _ in range(15):
        first = log.commit(first)
    assert log.load().version == 16 and len(log.versions()) == 10


def test_levels_fill_and_cascade(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "db")) as store:
        model = {}
        for n in range(5):
            ops = [(f"key{i:03d}".encode(), f"v{n}".encode()) for i in range(n, 40 + n)]
            store.apply(rows(spark, ops))
            store.flush()
            model |= dict(ops)
            store.maybe_compact()
        assert contents(store) == model and len([r for r in store.manifest.runs if r.level == 0]) <= 3
        assert any(r.level == 1 for r in store.manifest.runs)


@pytest.mark.parametrize("codec", ["none", "snappy", "lz4", "zstd"])
def test_codecs(spark, tmp_path, codec):
    with Store.open(spark, str(tmp_path / "db"), StoreOptions(compression=codec, key_order="unsigned")) as store:
        store.put(b"\x80", b"high")
        store.put(b"\x01", b"low")
        store.flush()
        assert contents(store) == {b"\x80": b"high", b"\x01": b"low"}
        assert [bytes(r.key) for r in store.scan(b"\x02").collect()] == [b"\x80"]


@pytest.mark.parametrize("bad", [dict(cluster_size=1), dict(cluster_size=21), dict(target_file_bytes=10), dict(flush_bytes=1 << 20), dict(compression="zip"), dict(key_order="odd")])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        StoreOptions(**bad)


def test_stream_ingest_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    ops = [[(b"a", b"1"), (b"b", b"2")], [(b"a", None), (b"c", b"3")]]
    for o in ops:
        rows(spark, o).coalesce(1).write.mode("append").parquet(source)
    with Store.open(spark, str(tmp_path / "db")) as store:
        for _ in range(2):  # the second run finds nothing new
            ingest(store, spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "cp"), available_now=True).awaitTermination()
        assert {b"b", b"c"} <= set(contents(store))
        before = store.manifest.version
        store.apply(rows(spark, ops[0]), stream=("mutations", 0))
        assert store.manifest.version == before
