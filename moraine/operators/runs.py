"""Sorted runs: cutting, checking, indexing and describing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.keys import common_prefix
from moraine.operators.snapshot import newest

RANGES = 64  # that an order is cut into to be ranked

def flush(mutations: DataFrame, key: str = "key", seq: str = "seq", run: str = "file_seq") -> DataFrame:
    """What each run holds after its flush: the newest mutation of every key, tombstones kept."""
    return newest(mutations, [run, key], [F.col(seq).desc()])


def order_violations(entries: DataFrame, order: str = "okey", run: str = "file_seq") -> DataFrame:
    """(violations): entries of a run whose key isn't above the one before it."""
    before = F.lag(order).over(Window.partitionBy(run).orderBy(order))
    return entries.select((before >= F.col(order)).alias("bad")).agg(F.count_if("bad").alias("violations"))


def describe(entries: DataFrame, order: str = "okey", deleted: str = "is_deleted", size: str = "size", by: tuple[str, ...] = ("level", "file_seq")) -> DataFrame:
    """A manifest row for each run: entries, tombstones, key range, bytes."""
    return entries.groupBy(*by).agg(F.count("*").alias("n_entries"), F.count_if(deleted).alias("n_del"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.sum(size).cast("bigint").alias("bytes"))


def clusters(entries: DataFrame, cluster_size: int = 10, order: str = "okey", run: str = "file_seq") -> DataFrame:
    """Entries with the number, from 0, of their cluster: ``cluster_size`` neighbours in key order.  A task holds one run."""
    at = F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1
    return entries.withColumn("cluster_id", F.floor(at / cluster_size).cast("bigint"))


def rank_all(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their rank from 1 in ``order``, whose values are distinct and not null.

    The order is cut into ranges at sampled values; rows are ranked within their range, and the ranges' sizes, one number each, are summed up
    before.  The cuts are collected and made part of the plan, so that a range means the same wherever it is computed.
    """
    ranges = rows.select(order).repartitionByRange(RANGES, order).groupBy(F.spark_partition_id().alias("n")).agg(F.min(order).alias("low"))
    cuts = sorted(r["low"] for r in ranges.collect())
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("_range", part)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    return inside.join(before, "_range").withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_range", "_size", "_before", "_inside")


def sparse_index(entries: DataFrame, cluster_size: int = 10, order: str = "okey", run: str = "file_seq") -> DataFrame:
    """(run, cluster_id, first_key, last_key, n): one row for each cluster."""
    return clusters(entries, cluster_size, order, run).groupBy(run, "cluster_id").agg(F.min(order).alias("first_key"), F.max(order).alias("last_key"), F.count("*").alias("n"))


def cluster_prefix(index: DataFrame, first: str = "first_key", last: str = "last_key") -> DataFrame:
    """The index with the length of the prefix that all keys of a cluster share: in sorted keys, that of the first and last."""
    return index.withColumn("lcp", common_prefix(F.col(first), F.col(last)))


def combined_range(manifest: DataFrame, by: str = "level") -> DataFrame:
    return manifest.groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def average_entries(manifest: DataFrame, by: str = "level") -> DataFrame:
    return manifest.groupBy(by).agg(F.floor(F.avg("n_entries")).cast("bigint").alias("avg_entries"))


def next_file_seq(manifest: DataFrame) -> DataFrame:
    """One above the highest sequence over all levels; 1 for an empty manifest."""
    return manifest.agg((F.coalesce(F.max("file_seq"), F.lit(0)) + 1).cast("bigint").alias("next_seq"))
