"""Sorted runs as Parquet: one file a run, sorted by order key, with column statistics, an optional Bloom filter on the key, any codec."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.keys import unit_size
from moraine.options import CODECS, StoreOptions
from moraine.schemas import ENTRIES
from moraine.sources import paths
from moraine.sources.manifest import RunFile

#: .../L<level>-S<first sequence>-<tag>/part-<number>-...: the run's sequence is the first one plus the part's number
_NAME = r"/L([0-9]+)-S([0-9]+)-[0-9a-f]+/part-([0-9]+)-[^/]*$"

TAIL = 0.25  # of a file


def _number(path, i: int):
    return F.regexp_extract(path, _NAME, i).cast("bigint")


def read(spark: SparkSession, runs) -> DataFrame:
    """Entries of the given runs with level and file_seq.  Only the listed files are opened."""
    if not runs:
        return spark.createDataFrame([], ENTRIES).withColumn("level", F.lit(0)).withColumn("file_seq", F.lit(0).cast("bigint"))
    path = F.col("_metadata.file_path")
    entries = spark.read.schema(ENTRIES).parquet(*[r.file for r in runs])
    return entries.select("*", _number(path, 1).cast("int").alias("level"), (_number(path, 2) + _number(path, 3)).alias("file_seq"))


def files_of(total_bytes: int, file_bytes: int) -> int:
    whole, rest = divmod(total_bytes, file_bytes)
    return max(1, whole + (rest >= TAIL * file_bytes))


def write(entries: DataFrame, root: str, level: int, first_seq: int, total_bytes: int, options: StoreOptions) -> list[RunFile]:
    """Writes entries (unique keys) as runs of about the level's file size with disjoint key ranges, and describes them.

    One range-partitioned sort; the number of ranges follows from the bytes.  Ranges are even in rows, so no small file is left over at the end; less than
    ``TAIL`` of a file beyond the last whole one is spread over the others instead of becoming one.  Nothing is published: the caller commits.
    """
    spark, target = entries.sparkSession, f"{root}/runs/L{level}-S{first_seq}-{uuid.uuid4().hex}"
    n = files_of(total_bytes, options.level_file_bytes(level))
    writer = entries.select(*ENTRIES.names).repartitionByRange(n, "okey").sortWithinPartitions("okey").write.option("compression", CODECS[options.compression])
    if options.bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(target)
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(ENTRIES).parquet(target).select("*", path.alias("path"), (_number(path, 2) + _number(path, 3)).alias("file_seq"), unit_size(F.col("key"), F.col("value"), F.col("is_deleted")).alias("size"))
    told = rows.groupBy("path", "file_seq").agg(F.count("*").alias("n"), F.count_if("is_deleted").alias("d"), F.min("okey").alias("lo"), F.max("okey").alias("hi"), F.sum("size").alias("b")).orderBy("file_seq").collect()
    if not told:
        paths.delete_path(spark, target)
    return [RunFile(r["path"], level, r["file_seq"], r["n"], r["d"], r["lo"], r["hi"], r["b"]) for r in told]
