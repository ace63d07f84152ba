"""A log-structured key-value store of binary keys and values, used in sets.

Writes append to a log; ``flush`` turns the log's tail into sorted runs at level 0; ``compact`` merges runs into the next level; reads merge
the tail and the runs, newest first.  ``snapshot`` is a DataFrame, so all of Spark SQL may be used on it.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from moraine.functions import keys as K
from moraine.operators import compaction
from moraine.operators.snapshot import newest
from moraine.options import StoreOptions
from moraine.plans.picking import pick_alternating
from moraine.schemas import ENTRIES, MUTATIONS
from moraine.sources import paths, runfiles
from moraine.sources.manifest import Batch, ConflictError, Manifest, ManifestLog, as_table

_OPEN: set[str] = set()
_GUARD = threading.Lock()


class StoreClosedError(RuntimeError):
    """An operation on a closed store."""


class StoreLockedError(OSError):
    """Another process holds the store."""


@dataclass
class SearchStats:
    """histogram: lookups by the number of runs whose range held the key up to the hit; ok counts tombstones as hits."""

    histogram: Counter = field(default_factory=Counter)
    ok: int = 0
    miss: int = 0

    @property
    def total(self) -> int:
        return self.ok + self.miss

    @property
    def from_memory(self) -> int:
        """Hits that opened no run: found in the log's tail."""
        return self.ok - sum(self.histogram.values())


#: versions for which files that a flush or compaction replaced are kept, so that readers of the manifest before can finish
KEPT_VERSIONS = 10


class Store:
    """Open with ``Store.open``; close, or use as a context manager.

    Threads may share a store.  Appends run side by side and commit one after another; flushes and compactions take turns.  A reader works on the
    manifest that it began with; files that were replaced since stay for ``KEPT_VERSIONS`` versions.
    """

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions):
        self.spark, self.path, self.options, self.closed = spark, f"{path.rstrip('/')}/MORAINE", options, False
        self.stats = SearchStats()
        self._cached: tuple[int, DataFrame] | None = None
        self._commits, self._upkeep, self._retired = threading.RLock(), threading.RLock(), []
        paths.make_dir(spark, self.path)
        self._lock()
        self.log = ManifestLog(spark, self.path)
        self.manifest: Manifest = self.log.load()

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: StoreOptions | None = None) -> Store:
        """Opens or creates.  Unflushed log batches are part of the manifest, so there is nothing to replay: all of them are read."""
        return cls(spark, path, options or StoreOptions())

    def _lock(self) -> None:
        with _GUARD:
            if self.path in _OPEN:
                raise RuntimeError(f"{self.path} is open in this process already")
            if not paths.create_new(self.spark, f"{self.path}/LOCK", uuid.uuid4().hex):
                raise StoreLockedError(f"{self.path} is locked; after a crash, Store.break_lock frees it")
            _OPEN.add(self.path)

    @staticmethod
    def break_lock(spark: SparkSession, path: str) -> None:
        """Frees the lock that a crashed process left."""
        paths.delete_path(spark, f"{path.rstrip('/')}/MORAINE/LOCK")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """The log is durable, so nothing is flushed.  A second close does nothing."""
        if not self.closed:
            self.closed = True
            self._drop_cache()
            self._retire((), 0)
            paths.delete_path(self.spark, f"{self.path}/LOCK")
            with _GUARD:
                _OPEN.discard(self.path)

    def destroy(self) -> None:
        """Deletes all files of a closed store."""
        if not self.closed:
            raise RuntimeError("close the store before it is destroyed")
        paths.delete_path(self.spark, self.path)

    def _check(self) -> None:
        if self.closed:
            raise StoreClosedError("the store is closed")

    def _commit(self, change, tries: int = 5) -> None:
        """Publishes ``change(manifest)``; after a conflict, on the manifest that the other writer left."""
        with self._commits:
            for left in range(tries - 1, -1, -1):
                try:
                    self.manifest = self.log.commit(change(self.manifest))
                    return
                except ConflictError:
                    if not left:
                        raise
                    time.sleep(0.05)
                    self.manifest = self.log.load()

    def _retire(self, files, keep: int = KEPT_VERSIONS) -> None:
        """Deletes what was replaced ``keep`` versions ago or more; ``files`` are replaced by the current version."""
        with self._commits:
            self._retired += [(self.manifest.version, f) for f in files]
            old = [f for v, f in self._retired if v <= self.manifest.version - keep]
            self._retired = [(v, f) for v, f in self._retired if v > self.manifest.version - keep]
        for f in old:
            paths.delete_path(self.spark, f)

    # writes

    def apply(self, mutations: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Appends rows of (op, key, value) and optionally ``seq``, the order within the batch; without it keys must be unique.  Flushes and compacts
        what is due then, if the options say so.

        ``stream``: (name, batch number) of a stream; a batch that was taken in before is left out.
        """
        self._check()
        if stream and self.manifest.streams.get(stream[0], -1) >= stream[1]:
            return
        ordered = "seq" in mutations.columns
        key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
        gone = K.is_delete(F.col("op"))
        must = lambda bad, what: F.when(bad, F.raise_error(F.lit(what)))
        key = F.coalesce(must(key.isNull(), "a key is null").cast("binary"), key)
        value = F.when(~gone, F.coalesce(must(value.isNull(), "a put value is null").cast("binary"), value))
        rows = mutations.select((F.col("seq") if ordered else F.lit(0)).cast("bigint").alias("seq"), F.col("op"), key.alias("key"), value.alias("value"))
        path = f"{self.path}/log/{uuid.uuid4().hex}"
        # what the manifest tells of a batch is counted while it is written
        tap = Observation(uuid.uuid4().hex)
        size = K.unit_size(F.col("key"), F.col("value"), F.col("op") == "D")
        rows.observe(tap, F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum(size).alias("bytes")).write.option("compression", "zstd").parquet(path)
        told = tap.get
        if told["n"] and self._has_twins(path, ["key", "seq"] if ordered else ["key"], told["n"]):
            paths.delete_path(self.spark, path)
            raise ValueError("mutations of one key need distinct seq values to tell which is newer")
        if not told["n"]:
            paths.delete_path(self.spark, path)

        def change(m: Manifest) -> Manifest:
            streams = m.streams | ({stream[0]: stream[1]} if stream else {})
            if not told["n"]:
                return replace(m, streams=streams)
            # the batch keeps its own order; where it stands in the log is told by the manifest
            return replace(m, streams=streams, tail=(*m.tail, Batch(path, m.next_seq - told["a"], m.next_seq + told["b"] - told["a"], told["bytes"])), next_seq=m.next_seq + told["b"] - told["a"] + 1)

        self._commit(change)
        if self.options.auto_flush:
            self.maybe_flush()

    def _has_twins(self, path: str, by: list[str], n: int) -> bool:
        """Whether rows of a batch agree in ``by``.  As many hashes as rows say no; fewer need the keys themselves."""
        back = self.spark.read.schema(MUTATIONS).parquet(path)
        if n == 1 or back.agg(F.count_distinct(F.xxhash64(*by))).first()[0] == n:
            return False
        return not back.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def put_all(self, rows: DataFrame) -> None:
        """Upserts rows of (key, value)."""
        self.apply(rows.select("key", "value", F.lit("W").alias("op")))

    def delete_all(self, keys: DataFrame) -> None:
        """Writes a tombstone for each key; keys that aren't there are fine."""
        self.apply(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit("D").alias("op")))

    def put(self, key: bytes, value: bytes) -> None:
        """One upsert.  Each call is a commit: for more than a few, ``put_all``."""
        self._single("W", key, value)

    def delete(self, key: bytes) -> None:
        self._single("D", key, None)

    def _single(self, op: str, key: bytes, value: bytes | None) -> None:
        self._check()
        if key is None or (op == "W" and value is None):
            raise ValueError("keys and values aren't null")
        self.apply(self.spark.createDataFrame([(op, bytearray(key), None if value is None else bytearray(value))], "op string, key binary, value binary"))

    # reads

    def _tail(self, m: Manifest) -> DataFrame:
        """The unflushed batches: one scan of all of them, however many, and the sequence at which each begins by its folder's name."""
        if not m.tail:
            out = self.spark.createDataFrame([], "seq bigint, key binary, value binary, is_deleted boolean")
        else:
            starts = self.spark.createDataFrame([(b.path.rsplit("/", 1)[1], b.first) for b in m.tail], "batch string, first bigint")
            starts = F.broadcast(starts) if len(m.tail) <= self.options.broadcast_rows else starts
            batch = F.regexp_extract(F.col("_metadata.file_path"), r"/log/([0-9a-f]+)/[^/]*$", 1).alias("batch")
            rows = self.spark.read.schema(MUTATIONS).parquet(*[b.path for b in m.tail]).select("*", batch)
            out = rows.join(starts, "batch").select((F.col("seq") + F.col("first")).alias("seq"), "key", "value", (F.col("op") == "D").alias("is_deleted"))
        return out.withColumn("okey", K.order_key(F.col("key"), self.options.key_order)).select(*ENTRIES.names)

    def entries(self, runs=None) -> DataFrame:
        """All versions in the tail and the runs (those given, or all), with what ranks them: level (-1 for the tail), file_seq, seq."""
        return self._entries(self.manifest, runs)

    def _entries(self, m: Manifest, runs=None) -> DataFrame:
        self._check()
        tail = self._tail(m).withColumn("level", F.lit(-1)).withColumn("file_seq", F.lit(None).cast("bigint"))
        return tail.unionByName(runfiles.read(self.spark, m.runs if runs is None else runs))

    @staticmethod
    def _newest(entries: DataFrame) -> DataFrame:
        return newest(entries, ["key"], [F.col("level").asc(), F.col("file_seq").desc_nulls_last(), F.col("seq").desc()])

    def snapshot(self) -> DataFrame:
        """(key, value) of every live key.  A filter on key passes below the ranking; one on value stays above it."""
        return self._newest(self.entries()).where("NOT is_deleted").select("key", "value")

    def cached_snapshot(self) -> DataFrame:
        """The snapshot, persisted until the store changes or closes; single lookups are answered from it while it is there."""
        with self._commits:
            if self._cached is None or self._cached[0] != self.manifest.version:
                self._drop_cache()
                self._cached = self.manifest.version, self.snapshot().persist()
            return self._cached[1]

    def _drop_cache(self) -> None:
        with self._commits:
            if self._cached is not None:
                self._cached[1].unpersist()
                self._cached = None

    def scan(self, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        """Live rows with lo <= key <= hi in the store's order: runs outside the range aren't opened, and within files statistics prune."""
        self._check()
        bound = {n: self._okey_of(b) for n, b in (("lo", lo), ("hi", hi)) if b is not None}
        m = self.manifest
        rows = self._entries(m, [r for r in m.runs if ("hi" not in bound or r.lo <= bound["hi"]) and ("lo" not in bound or r.hi >= bound["lo"])])
        for n, b in bound.items():
            rows = rows.where(F.col("okey") >= b if n == "lo" else F.col("okey") <= b)
        return self._newest(rows).where("NOT is_deleted").select("key", "value")

    def _okey_of(self, key: bytes) -> str:
        flip = {"signed": 0x80, "unsigned": 0}.get(self.options.key_order if isinstance(self.options.key_order, str) else "")
        if flip is None:
            return self.spark.createDataFrame([(bytearray(key),)], "key binary").select(self.options.key_order(F.col("key"))).first()[0]
        return "".join(chr(0x100 + (b ^ flip)) for b in key)

    def multi_get(self, keys: DataFrame, record: bool = False) -> DataFrame:
        """(key, found, is_deleted, value, source, seeks) for each distinct key of ``keys``.

        Runs whose range misses all keys aren't opened.  The key side is broadcast if it has ``broadcast_rows`` rows and ``broadcast_bytes`` at
        most, which is counted; else the join shuffles.  ``record`` adds the outcome to ``stats``, at the price of an action.
        """
        self._check()
        asked = keys.select(F.col("key").cast("binary").alias("key")).where("key IS NOT NULL").distinct().withColumn("okey", K.order_key(F.col("key"), self.options.key_order))
        told = asked.agg(F.min("okey").alias("lo"), F.max("okey").alias("hi"), F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes")).first()
        m, small = self.manifest, told["n"] <= self.options.broadcast_rows and told["bytes"] <= self.options.broadcast_bytes
        runs = [r for r in m.runs if told["n"] and r.lo <= told["hi"] and r.hi >= told["lo"]]
        side = asked.select("key")
        wanted = self._entries(m, runs).join(F.broadcast(side) if small else side, "key", "left_semi")
        hit = self._newest(wanted).select("key", "is_deleted", F.when(~F.col("is_deleted"), F.col("value")).alias("value"), "level", F.col("file_seq").alias("_seq"))
        ranges = as_table(self.spark, replace(m, runs=tuple(runs))).select(F.col("level").alias("_l"), F.col("file_seq").alias("_r"), "lo", "hi")
        newer = (F.col("_l") < F.col("level")) | ((F.col("_l") == F.col("level")) & (F.col("_r") >= F.col("_seq")))
        in_runs = hit.where("level >= 0").join(asked, "key").join(F.broadcast(ranges) if len(runs) <= self.options.broadcast_rows else ranges, (F.col("okey") >= F.col("lo")) & (F.col("okey") <= F.col("hi")) & newer)
        opened = in_runs.groupBy("key").agg(F.count("*").cast("int").alias("seeks"))
        out = asked.select("key").join(hit, "key", "left").join(opened, "key", "left")
        source = F.when(F.col("level") < 0, "log").when(F.col("level") >= 0, F.format_string("L%d", "level"))
        out = out.select("key", F.col("is_deleted").isNotNull().alias("found"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), "value", source.alias("source"), F.coalesce("seeks", F.lit(0)).alias("seeks"))
        if record:
            self.record(out)
        return out

    def record(self, found: DataFrame) -> None:
        """Adds lookups' outcomes to the statistics."""
        told = found.groupBy("found", "seeks").agg(F.count("*").alias("n")).collect()
        with self._commits:
            for r in told:
                if r["found"]:
                    self.stats.ok += r["n"]
                    if r["seeks"]:
                        self.stats.histogram[r["seeks"]] += r["n"]
                else:
                    self.stats.miss += r["n"]

    def get(self, key: bytes) -> bytes | None:
        """The value of one key; None if absent or deleted.  A Spark job each: for more than a few keys, ``multi_get``."""
        self._check()
        if key is None:
            raise ValueError("the key is null")
        with self._commits:
            cached = self._cached[1] if self._cached is not None and self._cached[0] == self.manifest.version else None
        if cached is not None:
            # a value that is there is in the cache and opens no run; what isn't may be a tombstone, which the store tells
            held = cached.where(F.col("key") == F.lit(bytearray(key))).select("value").head()
            if held is not None:
                with self._commits:
                    self.stats.ok += 1
                return bytes(held["value"])
        row = self.multi_get(self.spark.createDataFrame([(bytearray(key),)], "key binary")).first()
        with self._commits:
            if row["found"]:
                self.stats.ok += 1
                if row["seeks"]:
                    self.stats.histogram[row["seeks"]] += 1
            else:
                self.stats.miss += 1
        return None if row["value"] is None else bytes(row["value"])

    def search_stats(self) -> SearchStats:
        self._check()
        return self.stats

    # upkeep

    def tail_bytes(self) -> int:
        return sum(b.bytes for b in self.manifest.tail)

    def is_full(self) -> bool:
        """Whether the tail has reached ``flush_bytes``."""
        return self.tail_bytes() >= self.options.flush_bytes

    def maybe_flush(self) -> bool:
        """Flushes if the tail has reached ``flush_bytes``, then compacts what is due.  A writer waits for both: the log can't outgrow them."""
        if not self.is_full():
            return False
        with self._upkeep:
            if not self.is_full():  # another thread has done it
                return False
            self.flush()
            self.maybe_compact()
        return True

    def flush(self) -> int:
        """Writes the tail, newest version of each key, tombstones kept, as runs of level 0; returns how many."""
        with self._upkeep:
            return self._flush()

    def _flush(self) -> int:
        self._check()
        m = self.manifest
        if not m.tail:
            return 0
        rows = newest(self._tail(m), ["key"], [F.col("seq").desc()])
        made = runfiles.write(rows, self.path, 0, m.next_file_seq, sum(b.bytes for b in m.tail), self.options)
        gone = {b.path for b in m.tail}

        def change(now: Manifest) -> Manifest:
            if now.next_file_seq != m.next_file_seq or now.runs != m.runs:
                raise RuntimeError("the runs have changed while the tail was flushed")
            self._check_swap(now, (), made, 0)
            return replace(now, runs=(*now.runs, *made), tail=tuple(b for b in now.tail if b.path not in gone), next_file_seq=max([now.next_file_seq, *(r.file_seq + 1 for r in made)]))

        self._commit(change)
        self._retire(gone)
        return len(made)

    def _check_swap(self, now: Manifest, removed, added, level: int) -> None:
        """What a manifest must never take in: runs of several levels at once, files that aren't there, numbers that are taken, ranges that overlap."""
        if {r.level for r in added} - {level}:
            raise ValueError(f"the new runs aren't all of level {level}")
        taken = {r.file_seq for r in now.runs} - {r.file_seq for r in removed}
        if taken & {r.file_seq for r in added} or len({r.file_seq for r in added}) < len(added):
            raise ValueError("a run number stands twice")
        ordered = sorted(added, key=lambda r: r.lo)
        if any(a.hi >= b.lo for a, b in zip(ordered, ordered[1:])):
            raise ValueError("the new runs overlap")
        have = {f: set(paths.names(self.spark, f)) for f in {r.file.rsplit("/", 1)[0] for r in added}}
        lost = [r.file for r in added if r.file.rsplit("/", 1)[1] not in have[r.file.rsplit("/", 1)[0]]]
        if lost:
            raise FileNotFoundError(f"{lost[0]} isn't there")

    def due_levels(self) -> list[int]:
        held = Counter(r.level for r in self.manifest.runs)
        return [level for level in sorted(held) if held[level] > compaction.level_capacity(level)]

    def maybe_compact(self) -> int:
        """Compacts every level above its capacity, from the lowest, as long as that brings anything; returns how many compactions."""
        done = 0
        while True:
            if not any(self.compact(level) for level in self.due_levels()):
                return done
            done += 1

    def compact(self, level: int) -> bool:
        """One compaction of a level: chosen runs are merged into the next one; False if no choice is worth it."""
        with self._upkeep:
            return self._compact(level)

    def _compact(self, level: int) -> bool:
        self._check()
        m = self.manifest
        chosen, major_next = pick_alternating([r.as_run() for r in m.runs], level, m.major_next.get(level, True))
        if not chosen:
            return False
        seqs = {r.file_seq for r in chosen}
        return self._merge([r for r in m.runs if r.file_seq in seqs], level + 1, {level: major_next})

    def compact_all(self) -> bool:
        """All runs into one level below the lowest: no tombstone survives."""
        with self._upkeep:
            self._check()
            if not self.manifest.runs:
                return False
            return self._merge(list(self.manifest.runs), max(1, *(r.level for r in self.manifest.runs)), {})

    def _merge(self, inputs, target: int, flags: dict) -> bool:
        m, seqs = self.manifest, {r.file_seq for r in inputs}
        lowest, lo, hi = min(r.level for r in inputs), min(r.lo for r in inputs), max(r.hi for r in inputs)
        # a tombstone must stay while an older version may be left; runs that miss the range hold none
        others = [r for r in m.runs if r.file_seq not in seqs and r.level >= lowest and r.lo <= hi and r.hi >= lo]
        ids = self.spark.createDataFrame([(s,) for s in seqs], "file_seq bigint")
        merged = compaction.merge_chosen(runfiles.read(self.spark, inputs), ids, rest=runfiles.read(self.spark, others))
        made = runfiles.write(merged, self.path, target, m.next_file_seq, sum(r.bytes for r in inputs), self.options)

        def change(now: Manifest) -> Manifest:
            if not seqs <= {r.file_seq for r in now.runs} or now.next_file_seq != m.next_file_seq:
                raise RuntimeError("the runs have changed while they were merged")
            self._check_swap(now, inputs, made, target)
            kept = tuple(r for r in now.runs if r.file_seq not in seqs)
            return replace(now, runs=(*kept, *made), next_file_seq=max([now.next_file_seq, *(r.file_seq + 1 for r in made)]), major_next=now.major_next | flags)

        self._commit(change)
        self._retire([r.file for r in inputs])
        return True

    def vacuum(self) -> int:
        """Deletes files that no manifest names: what crashes and lost commits left.  Not while another process writes."""
        self._check()
        live = {b.path.rsplit("/", 1)[1] for b in self.manifest.tail}
        gone = [f"{self.path}/log/{n}" for n in paths.names(self.spark, f"{self.path}/log") if n not in live]
        folders = {r.file.split("/runs/")[1].split("/")[0] for r in self.manifest.runs}
        gone += [f"{self.path}/runs/{n}" for n in paths.names(self.spark, f"{self.path}/runs") if n not in folders]
        for path in gone:
            paths.delete_path(self.spark, path)
        return len(gone)

    def run_table(self) -> DataFrame:
        self._check()
        return as_table(self.spark, self.manifest)
