"""The corpus pipeline: raw documents to a weighted training mix.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame; it is
written and reread as the next one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import decontaminate, mixing, nearcopies, suffixes, toxicity
from moraine.llm._common import Scratch
from moraine.llm.catalog import held_out, table

#: near-duplicates: words of a shingle; texts of a Jaccard similarity of 0.8 or more are near copies
SHINGLE = 5
#: words of a repeated passage, whatever its bytes
PASSAGE = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5.  It learns from the labelled rows that op10 learns from.  Null and empty texts get the
    base score, which clean texts have as well; repeated rows are judged alike."""
    model = toxicity.train(docs.where(~held_out("doc_id")), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id (null first), of equal ids the one of smallest hash.

    Documents without words all have no shingles; they are one group.
    """
    text = F.coalesce("text", F.lit(""))
    # two hashes name a row's document, its id and text; the row itself travels as one column, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text.alias("text"), F.xxhash64("doc_id", text).alias("_one"), F.xxhash64(text, F.lit("two"), "doc_id").alias("_two"))
    groups = nearcopies.near_copy_classes(rows, "id", "text", SHINGLE)
    first = groups.groupBy("root").agg(F.min(F.struct("id", "_one", "_two")).alias("id")).select("id._one", "id._two")
    # rows repeated whole are one document as well
    return rows.join(first, ["_one", "_two"], "left_semi").dropDuplicates(["_one", "_two"]).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 400 bytes or of over 50 words that also stand elsewhere; n_chars follows the text.  Null and empty texts stay as
    they are; a text that stands twice, in repeated rows as well, is cut in all of them."""
    return suffixes.remove_repeats(docs, size_col="n_chars", words=PASSAGE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.  Null and empty texts hold none; repeated rows stay or go together."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: what the mix takes of it.  Null and empty texts have size 0; a null source is the last one; repeated rows are mixed each."""
    return mixing.mix_to_weights(docs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: learned, iterative and random stages: not expressible in SQL; tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
