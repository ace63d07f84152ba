"""Compaction as relations: ranges, triggers, the choice of runs, the merge and the collection of tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.lookup import candidate_runs
from moraine.operators.snapshot import merge_runs

LEVEL_BASE_MIB, LEVEL_STEP_MIB = 10, 3


def level_capacity(level):
    """Runs that a level may hold: 10^(level + 1) MiB over 3 * (level + 1) MiB a run.  A Column of a Column, an int of an int."""
    if isinstance(level, int):
        return LEVEL_BASE_MIB ** (level + 1) // (LEVEL_STEP_MIB * (level + 1))
    return F.floor(F.pow(F.lit(float(LEVEL_BASE_MIB)), level + 1) / (LEVEL_STEP_MIB * (level + 1))).cast("bigint")


def triggers(manifest: DataFrame) -> DataFrame:
    """(level, n_runs, capacity, due) of each level that has runs."""
    counted = manifest.groupBy("level").agg(F.count("*").alias("n_runs")).withColumn("capacity", level_capacity(F.col("level")))
    return counted.withColumn("due", F.col("n_runs") > F.col("capacity"))


def overlaps(a_lo, a_hi, b_lo, b_hi):
    return (a_lo <= b_hi) & (a_hi >= b_lo)


def contains(a_lo, a_hi, b_lo, b_hi):
    return (a_lo <= b_lo) & (a_hi >= b_hi)


def overlap_pairs(manifest: DataFrame) -> DataFrame:
    """(a, b, a_contains_b): pairs of runs, a before b, whose ranges meet.  Found as the runs whose range holds another's first key, which of two
    ranges that meet is true of one at least."""
    x = manifest.select(F.col("file_seq").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    y = manifest.select(F.col("file_seq").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    sides = F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")
    begins = candidate_runs(y.select(F.col("b").alias("other"), F.col("b_lo").alias("at")), manifest.select("file_seq", "lo", "hi"), "at").where("other <> file_seq")
    pairs = begins.select(F.least("other", "file_seq").alias("a"), F.greatest("other", "file_seq").alias("b")).distinct()
    return pairs.join(x, "a").join(y, "b").where(overlaps(*sides)).select("a", "b", contains(*sides).alias("a_contains_b"))


def merge_chosen(entries: DataFrame, chosen: DataFrame, key: str = "key", run: str = "file_seq", deleted: str = "is_deleted", rest: DataFrame | None = None) -> DataFrame:
    """The chosen runs merged, newest wins; a tombstone goes if no run left out holds its key.

    ``rest``: entries of the runs left out; of ``entries``, those of runs not chosen, unless told.  Runs below the lowest chosen level hold newer
    versions only and may be left out of ``rest``, as may the log's tail.
    """
    ids = chosen.select(run).distinct()
    merged = merge_runs(entries.join(ids, run, "left_semi"), key)
    others = (rest if rest is not None else entries.join(ids, run, "left_anti")).select(F.col(key).alias("_k")).distinct()
    kept = merged.where(F.col(deleted)).join(others, F.col(key) == F.col("_k"), "left_semi")
    return merged.where(~F.col(deleted)).unionByName(kept)


def mixed_levels(manifest: DataFrame, inputs: DataFrame) -> DataFrame:
    """(levels, known): how many levels the runs ``inputs`` (file_seq) stand on, and how many of them the manifest has: what replaces them must be of one."""
    return manifest.join(inputs.select("file_seq").distinct(), "file_seq", "left_semi").agg(F.count_distinct("level").alias("levels"), F.count("*").alias("known"))


def split_files(entries: DataFrame, file_bytes: int, order: str = "okey", size: str = "size", run: str = "file_seq") -> DataFrame:
    """Entries with the number, from 0, of the file that a size-bounded writer puts them in: a file is closed by the entry that brings it to ``file_bytes``.

    Files follow from a running sum of sizes within each run in key order: the entry's file is the number of whole ``file_bytes`` before it.
    """
    before = F.coalesce(F.sum(size).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("file", F.floor(before / file_bytes).cast("bigint"))


def swap(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The manifest without some runs and with others."""
    return manifest.join(removed.select("file_seq"), "file_seq", "left_anti").select(*manifest.columns).unionByName(added)
