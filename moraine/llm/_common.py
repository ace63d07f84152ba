"""Shared pieces of the training-data operators: durable intermediates and connected components.

Intermediates are Parquet tables in the folder that the cluster names in ``spark.checkpoint.dir``: a lost
executor costs the recomputation of its running tasks only, never of an earlier step.  No localCheckpoint,
no machine-local folder on a cluster.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes A-Z to a-z, all other bytes (hence all of UTF-8 beyond ASCII) unchanged
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """A-Z to a-z and nothing else, unlike ``lower``, which follows Unicode."""
    return F.translate(col, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests, one machine) a temporary folder is made and registered in its place.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="moraine-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands its rows to Python workers in batches of ``BATCH_BYTES``: ten thousand long texts, Spark's own bound,
    would fill a worker, and the JVM's memory for the transfer as well.  A bound that the session was started with stays."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    return df


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator call.  ``keep`` writes and rereads; ``drop`` deletes one that is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/moraine-{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._at_exit)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        # the schema is known: no job to infer it
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def only(self, *kept: DataFrame) -> None:
        """Deletes all tables of this call but those given: what was made from the others is written by then."""
        have = {getattr(df, "_scratch_path", None) for df in kept}
        for i in range(1, self.n + 1):
            if f"{self.root}/{i}" not in have:
                delete_path(self.spark, f"{self.root}/{i}")

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete_path(self.spark, path)

    def _at_exit(self) -> None:
        sc = self.spark.sparkContext
        if getattr(sc, "_jsc", None) is not None:
            try:
                delete_path(self.spark, self.root)
            except Exception:  # the JVM may be gone already; the folder then waits for the cluster's own cleaning
                pass


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges``; root is the smallest node that it reaches.

    Alternates large-star and small-star steps, which need O(log^2 n) rounds on any shape, chains included, and
    keep the edge count at or below the input's.  Every step is a grouped minimum (combined before the shuffle)
    and an equi-join whose hot side adaptive execution can split; nothing is collected but two numbers a round.
    Null ends and loops are ignored.
    """
    spark = scratch.spark
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    links = scratch.keep(links)
    state = _state(links)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u hangs on the smallest of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its other smaller neighbours hang on the smallest
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(links)
        links, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    got = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return got["n"], got["x"], got["y"]
