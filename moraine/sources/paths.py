"""Paths, through Spark's own file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def make_dir(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.mkdirs(p)


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file if nothing is there yet; False if something is.  The content appears whole: it is written under another
    name and renamed, and a rename onto an existing file fails."""
    p, fs = _at(spark, path)
    if fs.exists(p):
        return False
    part, _ = _at(spark, f"{path}.{id(text):x}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        # FileContext's rename, unlike FileSystem's, refuses to overwrite in one step
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(part, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        fs.delete(part, True)
        if "already exist" in str(e):
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, ``spark.checkpoint.dir``; a temporary one only where none is set."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="moraine-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
