"""Newest-wins reduction of a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each ``by`` in ``order``.  Ranks are limited before the shuffle, so a hot key sends one row a task."""
    rank = "_rank"
    while rank in rows.columns:
        rank = f"_{rank}"
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def latest(mutations: DataFrame, key: str = "key", seq: str = "seq", deleted: str = "is_deleted") -> DataFrame:
    """Live rows: the newest of each key unless it is a tombstone.  Tombstones go after the ranking: one that were dropped before
    would let an older value surface."""
    return newest(mutations, [key], [F.col(seq).desc()]).where(~F.col(deleted))


def merge_runs(entries: DataFrame, key: str = "key", level: str = "level", file_seq: str = "file_seq") -> DataFrame:
    """The newest entry of each key over sorted runs, tombstones included: lower levels are newer, in a level higher file sequences."""
    return newest(entries, [key], [F.col(level).asc(), F.col(file_seq).desc()])


def duplicate_seqs(mutations: DataFrame, seq: str = "seq") -> DataFrame:
    """Sequence numbers that stand more than once: none, in a log that can be ranked."""
    return mutations.groupBy(seq).agg(F.count("*").alias("n")).where("n > 1")


def running_sum(rows: DataFrame, order: str, value, name: str, width: int = 1 << 20) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to it in integer ``order``.

    Two levels, so that no task sorts everything: within stretches of ``width`` orders, and over the stretches' sums.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / width)).withColumn("_value", value)
    sums = cut.groupBy("_stretch").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_inside", F.sum("_value").over(inside)).join(sums, "_stretch").withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_stretch", "_value", "_inside", "_before")


def memtable_bytes(mutations: DataFrame, key: str = "key", seq: str = "seq", size: str = "size", name: str = "mem_bytes") -> DataFrame:
    """Bytes in the write buffer after each mutation: a unit's size less that of the one it replaces, summed up."""
    replaced = F.coalesce(F.lag(size).over(Window.partitionBy(key).orderBy(seq)), F.lit(0))
    return running_sum(mutations.withColumn("_delta", F.col(size) - replaced), seq, F.col("_delta"), name).drop("_delta")
