"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words; a target stops at
``limit`` times its source's words and the excess is shared again by weight until no target is above.  Each document
of a source then has the same expected number of copies, target / words of the source.  Its whole part is
certain; the fractions are rounded by pivots: two documents meet, mass moves at random from one to the other until
one is integral, the other goes on.  Fractions keep their expectation and their sum, up to one last residual
for each source.

Tree: leaves are (source, size class, hash bucket); within a leaf rows are walked in size order, so that mass moves
between documents of like sizes and the words taken stay near the target.  Each leaf leaves one residual row at
most.  A round merges ``FAN`` buckets, the last rounds merge size classes.  Rows stream through the walk, so a leaf needs
no memory of its own, and a hot source has as many leaves as its rows ask for.  All random numbers are hashes of the
rows that meet, so reruns and retries agree whatever the partitions.

Defined results: null text has size 0; sources of no words have target 0 and take nothing; a null source is a source of
its own; repeated rows are separate documents; null ids stay; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm._common import Scratch, small_batches

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
LEAF = 4096  # rows of a leaf, about, if one source and size class held all
FAN = 64  # buckets merged in a round
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """(source, source_idx, source_size, target) from rows of (source, size).

    min(limit * size, level * weight) with the one level at which the targets sum to all words: the fixed point of sharing
    again by weight.  The windows run over one row for each source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = per.withColumn("source_idx", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_idx") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(limit))
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_idx").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w") * (1 + 1e-12), F.col("level"))
    # the first source, in order of cap by weight, that its level does not fill tells the level of all
    ranked = ranked.withColumn("level", F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.col("cap") / F.col("w"), "source_idx"))).over(every))
    return ranked.select("source", "source_idx", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _draw(seed: int, *parts: int) -> float:
    """A number in [0, 1) from the hashes of two rows that meet."""
    return (xxhash.xxh64_intdigest(struct.pack(f"<{len(parts)}q", *parts), seed) >> 11) / float(1 << 53)


def _pivot(seed: int):
    """Kernel over rows sorted by leaf: (leaf key, h, p, ...) in, the same with p moved and ``open`` set for a leaf's residual."""

    def kernel(batches):
        held = None  # [leaf, h, p, batch number, row] of the row that still has a fraction
        waiting: list = []  # batches with a row still undecided: the last one, and the one of the held row

        def flush(all_: bool):
            nonlocal waiting
            keep = []
            for i, (batch, p, open_) in waiting:
                if not all_ and held is not None and held[3] == i:
                    keep.append((i, (batch, p, open_)))
                else:
                    at = batch.schema.get_field_index("p")
                    yield batch.set_column(at, "p", pa.array(p)).set_column(batch.schema.get_field_index("open"), "open", pa.array(open_))
            waiting = keep

        for i, batch in enumerate(batches):
            p, open_ = batch.column("p").to_numpy(zero_copy_only=False).copy(), np.zeros(batch.num_rows, bool)
            waiting.append((i, (batch, p, open_)))
            by = dict(waiting)
            leaf, hs = list(zip(*(batch.column(c).to_pylist() for c in ("source_idx", "cls", "bucket")))), batch.column("h").to_pylist()
            for r, q in enumerate(p.tolist()):
                if not EPS < q < 1 - EPS:
                    p[r] = round(q)
                    continue
                if held is None or held[0] != leaf[r]:
                    if held is not None:
                        by[held[3]][2][held[4]] = True
                    held = [leaf[r], hs[r], q, i, r]
                    continue
                a, b, u = held[2], q, _draw(seed, held[1], hs[r])
                old = by[held[3]][1]
                if a + b <= 1 + EPS:
                    out, carried, wins = 0.0, min(a + b, 1.0), u < a / (a + b)
                else:
                    out, carried, wins = 1.0, a + b - 1, u < (1 - a) / (2 - a - b)
                # ``wins``: the held row goes on with the mass, the new one is settled
                if wins:
                    p[r], old[held[4]], held[2] = out, carried, carried
                else:
                    old[held[4]], p[r], held = out, carried, [leaf[r], hs[r], carried, i, r]
                if not EPS < carried < 1 - EPS:
                    by[held[3]][1][held[4]], held = round(carried), None
            yield from flush(False)
        if held is not None:
            dict(waiting)[held[3]][2][held[4]] = True
        yield from flush(True)

    return kernel


def mix_to_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = 3, seed: int = 7) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken (copies * size)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORDS)).cast("bigint")
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h")))
    targets = scratch.keep(source_targets(rows.select("source", "size"), weights, limit))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0)
    whole = F.floor(ratio + EPS)
    buckets = max(1, -(-rows.count() // LEAF))
    cls = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")) * 4)).otherwise(-1)
    joined = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    live = joined.select("*", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("p"), F.lit(False).alias("open"), cls.cast("bigint").alias("cls"), F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"))
    done, first = [], True
    while True:
        leaves = live.repartition("source_idx", "cls", "bucket") if first else live.repartition(max(1, buckets), "source_idx", "cls", "bucket")
        moved = scratch.keep(leaves.sortWithinPartitions("source_idx", "cls", "bucket", "size", "h", "id").transform(small_batches).mapInArrow(_pivot(seed), live.schema))
        done.append(moved.where("NOT open"))
        live, first = moved.where("open"), False
        if buckets > 1:
            buckets = -(-buckets // FAN)
            live = live.withColumn("bucket", F.floor(F.col("bucket") / FAN))
        elif not live.where("cls <> -9").isEmpty():
            # the classes of a source, about 80 at most, meet in one leaf
            live = live.withColumn("cls", F.lit(-9).cast("bigint"))
        else:
            break
    last = live.withColumn("p", F.when(F.lit(2.0**-53) * F.shiftrightunsigned(F.xxhash64("h", F.lit(seed)), 11) < F.col("p"), 1.0).otherwise(0.0))
    for part in done:
        last = last.unionByName(part)
    copies = (F.col("whole") + F.round("p")).cast("bigint")
    return last.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
