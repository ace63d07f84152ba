"""A bounded, deterministic training sample: the texts of smallest hash of each class, up to a number of rows and characters.

Hashes and lengths are gathered first, without texts.  Of a class of n texts those are ranked whose hash is below a bound that some 2 ``per_class`` of n
hashes stay under, as hashes are even, so that no task ranks a class; should too few stay under it, the class is ranked whole.  The texts chosen are then found again by their hash, with a broadcast
of that bounded list.  So no text is shuffled, and equal texts count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm._common import Scratch


def text_hash(text):
    return F.xxhash64(text)


def choose(rows: DataFrame, per_class: int, chars: int) -> list[tuple]:
    """From rows (h, label, size): at most ``per_class`` hashes of each class, and of each class a share of ``chars`` characters.  Texts that don't
    fit into what is left of the share are passed over; a class none of whose texts fits gives its shortest one."""
    scratch = Scratch(rows.sparkSession, "sampling")
    each = scratch.keep(rows.where("label IS NOT NULL AND h IS NOT NULL").groupBy("label", "h").agg(F.max("size").alias("size")))

    def smallest(of: DataFrame) -> list:
        size = {r["label"]: r["n"] for r in of.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a class
        bound = {c: -(1 << 63) + (1 << 64) * 2 * (per_class + 32) // n for c, n in size.items() if n > 4 * (per_class + 32)}
        low = reduce(lambda c, x: c.when(F.col("label") == x[0], F.col("h") < x[1]), bound.items(), F.when(F.lit(False), True)).otherwise(True)
        got = ranked(of.where(low))
        short = {c for c in bound if sum(r["label"] == c for r in got) < per_class}
        if short:
            got = sorted([*(r for r in got if r["label"] not in short), *ranked(of.where(F.col("label").isin(sorted(short))))], key=lambda r: (r["label"], r["h"]))
        return got

    def ranked(of: DataFrame) -> list:
        first = of.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("k") <= per_class)
        return first.select("label", "h", "size").orderBy("label", "h").collect()  # at most per_class rows of each class

    got = smallest(each)
    share = chars // max(1, len({r["label"] for r in got}))
    # texts beyond the share don't stand in the way of later ones
    over = sorted({r["label"] for r in got if (r["size"] or 0) > share})
    if over:
        fits = smallest(each.where(F.col("label").isin(over) & (F.coalesce("size", F.lit(0)) <= share)))
        none = set(over) - {r["label"] for r in fits}
        short = each.where(F.col("label").isin(sorted(none))).groupBy("label").agg(F.min(F.struct("size", "h")).alias("s")).select("label", "s.h", F.lit(0).alias("size")).collect() if none else []
        got = sorted([*(r for r in got if r["label"] not in over), *fits, *short], key=lambda r: (r["label"], r["h"]))
    scratch.only()
    used, out = {}, []
    for r in got:
        size = r["size"] or 0
        if used.get(r["label"], 0) + size <= share:
            used[r["label"]] = used.get(r["label"], 0) + size
            out.append((r["h"], r["label"]))
    return out


def texts_of(docs: DataFrame, text_col: str, chosen: list[tuple], label_type: str) -> DataFrame:
    """(h, label, text) rows of ``docs`` whose text was chosen, repeated where the text is."""
    small = docs.sparkSession.createDataFrame(chosen, f"h bigint, label {label_type}")
    source = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    return source.withColumn("h", text_hash(F.col("text"))).join(F.broadcast(small), "h").select("h", "label", "text")
