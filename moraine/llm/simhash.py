"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verify the Hamming distance.

Fingerprint
    64 bits over word shingles, each hashed by XXH64 (UTF-8, seed 42); a bit is set if it is set in over half of
    the shingles, repeats counted.  Fewer words than the shingle length: the whole sequence is the only shingle.
    No words: zero.
Links
    Two fingerprints that differ in at most ``d`` bits.  The 64 bits are cut into d + k blocks (k is 2 for d up to 2, else 3), so a close
    pair agrees in k of them at least; fingerprints meet on every choice of k blocks (d = 2: six keys of 32 bits, d = 6: 84 of 21).
    Only distinct fingerprints take part, so exact copies cost nothing.
Hot blocks
    A key that more than ``hot`` fingerprints share is not joined with itself, which would emit the square of its size.  Its members
    are searched breadth first instead: those not reached yet are compared with those reached, and only the link by which each is
    reached is emitted, so the block's components come out exactly, from fewer links than members.  In a dense block, as near copies of
    one text make, nearly all are reached at once.  A block of more than ``CHUNK`` members is dealt in chunks, a task for each pair of
    them, so no task holds more than two.

Defined results: null and empty texts have fingerprint zero and link like any other; null ids keep their rows,
and a component's id is the smallest non-null id in it (null if there is none); repeated rows stay repeated;
an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm._common import ASCII_LOWER, Scratch, connected_components, small_batches

SEED = 42
HOT = 8  # fingerprints of a block that is still joined with itself: 28 pairs at most
SPREAD = 8192  # fingerprints whose keys one task makes
CHUNK = 1 << 18  # members of a hot block that are searched together, twice as many at most
PIECE = 1 << 16  # shingles whose bits are counted at a time: bounds memory for texts of any length


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens)))
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(tokens) - words + 1)
    begin, end = starts[:n].tolist(), (ends[min(words, len(tokens)) - 1 :][:n] - 1).tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        h = b"".join([digest(line[s:e], seed) for s, e in zip(begin[at : at + PIECE], end[at : at + PIECE])])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id, fp, fp1, ...): one row per input row; a fingerprint for each seed, as signed 64-bit numbers."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["fp", *(f"fp{i}" for i in range(1, len(seeds)))]

    def kernel(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            values = [pa.array(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)) for seed in seeds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["id", *names])

    return source.transform(small_batches).mapInArrow(kernel, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names))


def block_masks(d: int) -> np.ndarray:
    """The bits that each key keeps of a fingerprint: every choice of k of d + k blocks."""
    k = 2 if d <= 2 else 3
    cuts = [64 * i // (d + k) for i in range(d + k + 1)]
    blocks = [((1 << hi) - (1 << lo)) for lo, hi in itertools.pairwise(cuts)]
    return np.array([sum(c) for c in itertools.combinations(blocks, k)], np.uint64)


def block_keys(fps: DataFrame, d: int) -> DataFrame:
    """(choice, bits, fp): a row for each key of each fingerprint; any two within d bits share one at least."""
    masks = block_masks(d)
    n = len(masks)
    # a few thousand fingerprints a task, as each becomes many rows
    spread = fps.select("fp").repartition(max(1, -(-fps.count() // SPREAD)), "fp")

    def kernel(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 1024):
                part = fp[at : at + 1024]
                bits = (part[:, None] & masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(part))), pa.array(bits), pa.array(np.repeat(part, n).view(np.int64))], names=["choice", "bits", "fp"])

    return spread.transform(small_batches).mapInArrow(kernel, "choice int, bits bigint, fp bigint")


def reach(fps: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among distinct fingerprints (uint64), each member reached by one: breadth first."""
    links, rest = [], np.unique(fps)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:32], front[32:]
            near = np.bitwise_count(rest[:, None] ^ block[None, :]) <= d
            got = near.any(axis=1)
            links += zip(rest[got].tolist(), block[near[got].argmax(axis=1)].tolist())
            front, rest = np.concatenate((front, rest[got])), rest[~got]
    return links


def _hot_links(rows: DataFrame, d: int) -> DataFrame:
    """(a, b) links within hot blocks, rows of (choice, bits, n, fp)."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = rows.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = ["choice", "bits", "x", "y"]
    dealt = dealt.select("choice", "bits", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp")

    def solve(fps):
        got = np.array(reach(np.array(fps, np.int64).view(np.uint64), d), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    def kernel(batches):
        held, fps = None, []
        for batch in batches:
            for *key, fp in zip(*(batch.column(c).to_pylist() for c in [*by, "fp"])):
                if key != held:
                    if len(fps) > 1:
                        yield solve(fps)
                    held, fps = key, []
                fps.append(fp)
        if len(fps) > 1:
            yield solve(fps)

    return dealt.repartition(*by).sortWithinPartitions(*by).transform(small_batches).mapInArrow(kernel, "a bigint, b bigint")


def close_links(fps: DataFrame, scratch: Scratch, max_distance: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b) links between distinct fingerprints of column ``fp``: every close pair of a block that isn't hot, and for
    hot blocks links that connect the same fingerprints."""
    if not 0 <= max_distance <= 8:
        raise ValueError("max_distance is 0 to 8: beyond it the blocks are too narrow to tell texts apart")
    key = ["choice", "bits"]
    blocks = scratch.keep(block_keys(fps, max_distance))
    sizes = scratch.keep(blocks.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    shared = scratch.keep(blocks.join(sizes, key))
    scratch.drop(blocks)
    small = shared.where(F.col("n") <= hot)
    x, y = small.select(*key, F.col("fp").alias("a")), small.select(*key, F.col("fp").alias("b"))
    joined = x.join(y, key).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).select("a", "b")
    return joined.unionByName(_hot_links(shared.where(F.col("n") > hot), max_distance)).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 2, hot: int = HOT, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """One row per input row: id, fp (signed 64-bit fingerprint), component (smallest id reachable over links), class_fp
    (the component's smallest fingerprint, which names it even where ids are null).

    With several ``seeds`` a text has a fingerprint for each, and two texts link if those of any seed are close: each seed gives a pair that
    its noise keeps apart another chance.  fp is then the first seed's, and texts that share it are one class.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(with_fingerprints(docs, id_col, text_col, words, seeds))
    links = scratch.keep(close_links(rows.select("fp").distinct(), scratch, max_distance, hot))
    for i in range(1, len(seeds)):
        own = scratch.keep(rows.select(F.col(f"fp{i}").alias("other"), "fp").distinct())
        # the smallest first fingerprint stands for all texts of one further fingerprint
        least = scratch.keep(own.groupBy("other").agg(F.min("fp").alias("least")))
        same = own.join(least, "other").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
        near = close_links(least.select(F.col("other").alias("fp")), scratch, max_distance, hot)
        end = lambda c: least.select(F.col("other").alias(c), F.col("least").alias(f"{c}_least"))
        near = near.join(end("a"), "a").join(end("b"), "b").where("a_least <> b_least").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))
        links = scratch.keep(links.unionByName(same).unionByName(near).distinct())
        scratch.only(rows, links)
    roots = scratch.keep(connected_components(links, scratch))
    scratch.only(rows, roots)
    # fingerprints without links are their own class
    lone = rows.groupBy("fp").agg(F.min("id").alias("least"))
    classes = lone.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("class_fp"))
    ids = classes.groupBy("class_fp").agg(F.min("least").alias("component"))
    named = classes.select("fp", "class_fp").join(ids, "class_fp")
    return rows.select("id", "fp").join(named, "fp").select("id", "fp", "component", "class_fp")
