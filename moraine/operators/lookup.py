"""Batched point lookups: pruning, locating, probing and counting what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST = 200_000  # rows of a manifest, each some 200 bytes

def multi_get(keys: DataFrame, newest: DataFrame, key: str = "key", deleted: str = "is_deleted", value: str = "value") -> DataFrame:
    """(key, found, value) for each key: found also if what is found is a tombstone, whose value is null."""
    store = newest.select(F.col(key).alias("_k"), F.col(deleted).alias("_d"), F.col(value).alias("_v"))
    met = keys.join(store, F.col(key) == F.col("_k"), "left")
    return met.select(*keys.columns, F.col("_k").isNotNull().alias("found"), F.when(~F.col("_d"), F.col("_v")).alias(value))


def hit_counts(found: DataFrame, flag: str = "found") -> DataFrame:
    """(ok, miss): lookups that found an entry, a tombstone counting as one, and the others."""
    return found.agg(F.count_if(flag).alias("ok"), F.count_if(~F.col(flag)).alias("miss"))


def candidate_runs(keys: DataFrame, manifest: DataFrame, key: str = "okey", upper: bool = True) -> DataFrame:
    """Each key with the runs whose range holds it (or, without ``upper``, begins at or below it).

    The manifest is metadata, one row a run: it is counted, and up to ``BROADCAST`` rows it is broadcast for the range join, as a nested loop.
    A larger one is met by sorting: see ``_sorted_candidates``.
    """
    at = F.col(key)
    near = (at >= F.col("lo")) & (at <= F.col("hi")) if upper else at >= F.col("lo")
    if manifest.limit(BROADCAST + 1).count() <= BROADCAST:
        return keys.join(F.broadcast(manifest), near)
    return _sorted_candidates(keys, manifest, key, near)


def _sorted_candidates(keys: DataFrame, manifest: DataFrame, key: str, near, stretches: int = 256) -> DataFrame:
    """The range join without a broadcast of the manifest: keys and runs are dealt to stretches of the key order, cut where the runs' first keys are cut into
    ``stretches`` ranges, a run to each stretch that it meets, and joined by stretch."""
    ranges = manifest.select("lo").repartitionByRange(stretches, "lo").groupBy(F.spark_partition_id().alias("n")).agg(F.min("lo").alias("lo"))
    bounds = sorted(r["lo"] for r in ranges.collect())  # one for each stretch
    cuts = F.array(*map(F.lit, bounds))
    # how many cuts stand at or below a value
    stretch = lambda c: F.size(F.filter(cuts, lambda x: x <= c))
    upto = stretch(F.col("hi")) if "hi" in manifest.columns else F.lit(len(bounds))
    dealt = manifest.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("lo")), upto)))
    return keys.withColumn("_stretch", stretch(F.col(key))).join(dealt, "_stretch").where(near).drop("_stretch")


def locate_cluster(keys: DataFrame, index: DataFrame, manifest: DataFrame, key: str = "okey", run: str = "file_seq") -> DataFrame:
    """(key, run, cluster_id): the last cluster of each run whose first key isn't above the key; runs that begin above it have none.

    An as-of join by sorting: index entries and keys of a run in one order, the last entry seen goes with a key.
    """
    asks = candidate_runs(keys.select(key).distinct(), manifest.select(run, "lo"), key, upper=False).select(run, F.col(key).alias("at"), F.lit(None).cast("bigint").alias("cluster_id"))
    marks = index.select(run, F.col("first_key").alias("at"), "cluster_id")
    order = Window.partitionBy(run).orderBy("at", F.col("cluster_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.withColumn("ask", F.lit(False)).unionByName(asks.withColumn("ask", F.lit(True)))
    return both.withColumn("cluster_id", F.last("cluster_id", ignorenulls=True).over(order)).where("ask").select(F.col("at").alias(key), run, "cluster_id")


def seeks(keys: DataFrame, entries: DataFrame, manifest: DataFrame, key: str = "okey", level: str = "level", run: str = "file_seq") -> DataFrame:
    """(key, seeks) of keys that are found: how many runs, newest first, have the key in their range up to the one that holds it."""
    order = Window.partitionBy(key).orderBy(F.col(level).asc(), F.col(run).desc())
    ranked = candidate_runs(keys.select(key).distinct(), manifest.select(level, run, "lo", "hi"), key).select(key, run, F.row_number().over(order).cast("bigint").alias("seeks"))
    holds = entries.select(F.col(key).alias("_k"), F.col(run).alias("_r")).distinct()
    return ranked.join(holds, (F.col(key) == F.col("_k")) & (F.col(run) == F.col("_r"))).groupBy(key).agg(F.min("seeks").alias("seeks"))


def seek_histogram(seek_rows: DataFrame) -> DataFrame:
    return seek_rows.groupBy("seeks").agg(F.count("*").alias("n"))


def runs_with_key(keys: DataFrame, entries: DataFrame, key: str = "key", level: str = "level", run: str = "file_seq", lowest: int = 0) -> DataFrame:
    """(key, run) of every run at ``lowest`` level or above that holds the key."""
    return keys.select(key).distinct().join(entries.where(F.col(level) >= lowest).select(key, run), key)


def derived_stats(stats: DataFrame) -> DataFrame:
    """(total, from_cache) of rows of (hist map, ok, miss): all lookups, and hits that opened no run."""
    opened = F.aggregate(F.map_values("hist"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return stats.select((F.col("ok") + F.col("miss")).alias("total"), (F.col("ok") - opened).alias("from_cache"))
