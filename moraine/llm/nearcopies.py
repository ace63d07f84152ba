"""SimHash near-dedup with wide fingerprints: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of ``simhash``: blocks of a fingerprint are keys, texts meet on keys, the Hamming distance is verified.  Here the fingerprint is
wider, as 64 bits can't tell a similarity of 0.8, and each link is verified by the texts' shingles as well, so no pair below 0.8 is linked.

Nodes
    Words are cut at white space, A-Z lower-cased.  Texts of one set of shingles (runs of ``words`` words; fewer words: all of them) are one node, so
    copies cost nothing.
Fingerprint
    ``BITS`` bits over the distinct two-word runs of a node, which a changed word touches less often than longer runs; a bit is set if it is in over half.
Keys
    The bits are cut into blocks of 16; each choice of two is a key of 32 bits, more than the logarithm of a corpus of billions, so
    that keys don't fill with unrelated texts as it grows.  Pigeonhole: a pair within ``BLOCKS`` - 2 bits shares a key for certain.  A pair of similarity
    0.8, some 35 bits apart, shares one of the 276 with a probability of about 0.95; the README has the recall measured.
Verification
    Pairs within a quarter of the bits, then those whose sets, gathered once for the nodes that share keys, are similar.
Hot keys
    No key is joined with itself unless few of its members are still apart.  First each node is paired with one leader: of those who lead a key
    of its own, the one that shares the most keys with others, as the text that a group's copies were made of does.  Pairs within ``FAR`` bits make
    families, similar ones links.  The sets of each family that links leave apart are gathered, once each, in chunks of ``CHUNK``, a task for each pair of chunks,
    where only links that connect what isn't connected yet are emitted.  What keys share across families is joined if they have up to ``HOT`` members, else
    gathered in the same way.  So all similar nodes of a key end up connected, and no pairs are multiplied out.

Defined results: null and empty texts have no shingles and are one node; repeated rows stay repeated; ties go to the larger node number; an empty table
gives an empty result; other columns of the input are ignored, whatever their names.  Shingles, runs and nodes are 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm._common import ASCII_LOWER, Scratch, connected_components, small_batches
from moraine.llm.words import Hasher, each_word, mix, word_places

WORDS, FEATURE = 5, 2
LANES = 6  # 64-bit numbers of a fingerprint
BITS = 64 * LANES
BLOCKS = BITS // 16
FAR = BITS // 4  # bits that candidates may differ in
HOT = 8  # members of a key that is joined with itself across families
CHUNK = 1 << 13  # members of a family or hot key that are gathered together, twice as many at most
SPREAD = 4096  # fingerprints whose keys one task makes
PIECE = 1 << 20  # bytes of texts cut into words at a time, a text more at most
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.random.default_rng(20240501).integers(1, 1 << 63, (2, LANES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring words, from the words' hashes."""
    if not k:
        return words
    n = max(0, len(words) - k + 1)
    out = words[:n]
    for i in range(1, k):
        out = out * _STEP + words[i : i + n]
    return mix(out * _STEP + np.uint64(k))


def features(texts: list[str | None], words: int, hasher: Hasher):
    """(distinct shingles, distinct two-word runs) of each text, sorted."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and size < PIECE:
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER))
            size += len(parts[-1]) + 1
            at += 1
        start, end = word_places(buf := np.frombuffer(b"\n".join(parts), np.uint8))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        one = each_word(buf, start, end, 0, hasher)
        long, short = runs_of(one, words), runs_of(one, FEATURE)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield tuple(np.unique(runs_of(one[a:b], b - a) if b - a < k else every[a : b - k + 1]) for k, every in ((words, long), (FEATURE, short)))


def fingerprint(runs: np.ndarray) -> np.ndarray:
    """The LANES numbers of a fingerprint."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(runs), 1 << 14):
        h = mix(runs[a : a + (1 << 14), None] * _LANE[0] + _LANE[1])
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(runs)).view(np.uint64)


def node_of(shingles: np.ndarray) -> int:
    """The number of a set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


_LANES = [f"f{i}" for i in range(LANES)]


def with_nodes(docs: DataFrame, keep: list[str], text_col: str, words: int) -> DataFrame:
    """The columns ``keep``, node, and the lanes of its fingerprint."""
    source = docs.select(*keep, F.col(text_col).alias("text"))

    def kernel(batches):
        hasher = Hasher()
        for batch in batches:
            nodes, prints = [], []
            for shingles, runs in features(batch.column("text").to_pylist(), words, hasher):
                nodes.append(node_of(shingles))
                prints.append(fingerprint(runs))
            prints = np.array(prints, np.uint64).reshape(-1, LANES).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(nodes, pa.int64()), *(pa.array(prints[:, i]) for i in range(LANES))], names=[*keep, "node", *_LANES])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.transform(small_batches).mapInArrow(kernel, f"{fields}, node bigint, " + ", ".join(f"{c} bigint" for c in _LANES))


def block_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of fingerprints (n by LANES, uint64): n rows, a column for each choice of two blocks."""
    blocks = prints.view(np.uint16).reshape(len(prints), BLOCKS).astype(np.int64)
    i, j = np.triu_indices(BLOCKS, 1)
    return np.arange(len(i)) << 32 | blocks[:, i] << 16 | blocks[:, j]


def keys(prints: DataFrame, count: int) -> DataFrame:
    """(key, node): a row for each key of each node."""
    spread = prints.select("node", *_LANES).repartition(max(1, -(-count // SPREAD)), "node")

    def kernel(batches):
        for batch in batches:
            node, lanes = batch.column(0).to_numpy(), np.stack([batch.column(c).to_numpy() for c in _LANES], axis=1).view(np.uint64)
            for a in range(0, len(node), 256):
                got = block_keys(np.ascontiguousarray(lanes[a : a + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(got.ravel()), pa.array(np.repeat(node[a : a + 256], got.shape[1]))], names=["key", "node"])

    return spread.transform(small_batches).mapInArrow(kernel, "key bigint, node bigint")


def _sets(docs: DataFrame, nodes: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, shingles) of those of ``nodes`` (node, _one, _two: a row that has it)."""
    source = docs.join(nodes, ["_one", "_two"]).select("node", F.col(text_col).alias("text"))

    def kernel(batches):
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                got = [shingles.view(np.int64) for shingles, _ in features(part.column(1).to_pylist(), words, hasher)]
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *got])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "shingles"])

    return source.transform(small_batches).mapInArrow(kernel, "node bigint, shingles array<bigint>")


def link_sets(roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets that connect all that is connected; sets of one root are already."""
    root, size = np.unique(np.array(roots, np.int64), return_inverse=True)[1], np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    which = np.unique(np.concatenate(sets), return_inverse=True)[1]
    # the members that hold each shingle
    order = np.argsort(which, kind="stable")
    held, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(which))))
    mine, links = np.concatenate(([0], np.cumsum(size))), []
    for i in range(len(sets)):
        if (root == root[0]).all():
            break
        if not size[i]:
            continue
        mates = np.concatenate([held[begin[w] : begin[w + 1]] for w in which[mine[i] : mine[i + 1]].tolist()])
        near = np.flatnonzero((9 * np.bincount(mates, minlength=len(sets)) >= 4 * (size[i] + size)) & (root != root[i]))
        if len(near):
            met, at = np.unique(root[near], return_index=True)
            links += [(i, j) for j in near[at].tolist()]
            root[np.isin(root, met)] = root[i]
    return links


def _gathered(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links within keys, or whatever ``key`` names, rows of (key, node, root)."""
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = hot.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = ["key", "x", "y"]
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", "root").join(sets, "node").select(*by, "node", "root", "shingles")

    def solve(rows):
        got = link_sets([r[1] for r in rows], [r[2] for r in rows]) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in got], pa.int64()), pa.array([rows[j][0] for _, j in got], pa.int64())], names=["a", "b"])

    def kernel(batches):
        held, rows = None, []
        for batch in batches:
            for at, (*key, node, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*by, "node", "root"]))):
                if key != held:
                    if rows:
                        yield solve(rows)
                    held, rows = key, []
                rows.append((node, root, batch.column("shingles")[at].values.to_numpy().copy()))
        if rows:
            yield solve(rows)

    return dealt.repartition(*by).sortWithinPartitions(*by).transform(small_batches).mapInArrow(kernel, "a bigint, b bigint").distinct()


def near_copy_classes(rows: DataFrame, id_col: str, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, _one, _two, root): the rows' ids, and the node that names the class of each.  ``_one`` and ``_two`` of ``rows`` are hashes that name a row."""
    scratch = Scratch(rows.sparkSession, "nearcopies")
    named = scratch.keep(with_nodes(rows.withColumn("_id", F.col(id_col)), ["_id", "_one", "_two"], text_col, words))
    one = scratch.keep(named.groupBy("node").agg(F.min(F.struct("_one", "_two", *_LANES)).alias("r")).select("node", "r.*"))
    count = one.count()
    several = scratch.keep(keys(one, count).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = scratch.keep(keys(one, count).join(several, "key"))
    # how many others a node shares keys with: a text that copies were made of shares more than they do among themselves
    ranks = scratch.keep(shared.groupBy("node").agg(F.sum("size").alias("rank")))
    sets = scratch.keep(_sets(rows, one.join(ranks, "node").select("node", "_one", "_two").dropDuplicates(["node"]), text_col, words).dropDuplicates(["node"]))
    side = lambda of, c: of.withColumnsRenamed({n: f"{c}_{n}" for n in of.columns if n != "node"} | {"node": c})
    prints = one.join(ranks, "node").select("node", *_LANES)

    def near(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) within FAR bits."""
        both = pairs.join(side(prints, "a"), "a").join(side(prints, "b"), "b")
        apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _LANES), F.lit(0))
        return scratch.keep(both.where(apart <= FAR).select("a", "b"))

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are similar."""
        both = pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
        return both.where(9 * F.size(F.array_intersect("a_shingles", "b_shingles")) >= 4 * (F.size("a_shingles") + F.size("b_shingles"))).select("a", "b")

    def apart(of: DataFrame, by: str, within: str = "key") -> DataFrame:
        """Names and sizes of those keys whose members are apart."""
        return of.groupBy(within).agg(F.min(by).alias("x"), F.max(by).alias("y"), F.count("*").alias("size")).where("x <> y").select(within, "size")

    ranked = scratch.keep(shared.join(ranks, "node").select("key", "node", F.struct("rank", "node").alias("me")))
    led = ranked.join(ranked.groupBy("key").agg(F.max("me").alias("lead")), "key").where("node <> lead.node")
    close = near(led.groupBy("node").agg(F.max("lead").alias("lead")).select(F.col("lead.node").alias("a"), F.col("node").alias("b")))
    links = [scratch.keep(similar(close))]
    roots = connected_components(links[0], scratch)
    families = connected_components(close, scratch).withColumnRenamed("root", "family")
    members = ranks.select("node").join(families, "node", "left").join(roots, "node", "left").select("node", F.coalesce("family", "node").alias("family"), F.coalesce("root", "node").alias("root"))
    members = scratch.keep(members)
    family = members.join(apart(members, "root", "family").select("family"), "family", "left_semi").select(F.col("family").alias("key"), "node", "root")
    links.append(scratch.keep(_gathered(scratch.keep(family), sets)))
    # what is left: nodes of a key in different families
    wide = scratch.keep(shared.select("key", "node").join(members.select("node", "family"), "node"))
    wide = scratch.keep(wide.join(apart(wide, "family"), "key"))
    few = wide.where(F.col("size") <= HOT)
    end = lambda c: few.select("key", F.col("node").alias(c), F.col("family").alias(f"{c}_family"))
    met = end("a").join(end("b"), "key").where("a < b AND a_family <> b_family").select("a", "b").distinct()
    links.append(scratch.keep(similar(near(met))))
    hot = wide.where(F.col("size") > HOT)
    if not hot.isEmpty():
        # keys of the same members are one
        per = hot.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(42), "node")).alias("y"))
        kinds = scratch.keep(per.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key"))
        links.append(scratch.keep(_gathered(scratch.keep(hot.join(kinds, "key", "left_semi").select("key", "node", F.col("node").alias("root"))), sets)))
    links = reduce(DataFrame.unionByName, links)
    roots = scratch.keep(connected_components(links, scratch))
    scratch.only(named, roots)
    return named.join(roots, "node", "left").select(F.col("_id").alias("id"), "_one", "_two", F.coalesce("root", "node").alias("root"))
