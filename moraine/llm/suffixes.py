"""Suffix-array dedup of exact strings: every byte of a ``length``-byte string that also starts elsewhere is removed.

The suffixes of a corpus are too many to move, so they are dealt to buckets by content before they are sorted:

1. Anchors.  Every window of ``length`` bytes names one position inside it: that of the smallest hash among its ``K``-byte grams.
   The choice depends on the window's bytes only, so equal windows, wherever they start, name equal grams at equal offsets.
   Neighbouring windows mostly name the same one; each run of them is a row (gram hash, SHA-256 of the run's bytes, text, place):
   about one row for every ``(length - K) / 2`` bytes.
2. Rows whose gram hash stands once are done: none of their windows is repeated.  The others are grouped by gram (bucket) and by run.
   A run that stands twice repeats whole.  A bucket with one kind of run only is done as well.
3. Suffix sort.  In every other bucket one copy of each kind of run is fetched, and all suffixes at its window starts are sorted:
   a bottom-up mergesort over all buckets of a batch at once, whose comparisons find the common extension of two suffixes by binary search
   over prefix polynomial hashes, in about log2(length) steps, and then compare the next byte.  Neighbours with a common extension of
   ``length`` are repeats.  Equal neighbours are verified byte by byte; after a hash collision the batch is sorted again by its bytes.
4. A bucket of more than ``HOT`` kinds of runs, such as one passage with other words around it in very many texts, would be too much for one task.  Its
   windows are dealt to ``CLASSES`` by the anchor's offset.  The windows of a run in a class have a hull, all their bytes, and a core, the bytes that
   any window of that class there would hold, both named by SHA-256.  A hull that stands twice repeats whole; a core with one kind of hull is
   done; else the few windows of each kind of hull are compared by the bytes that they have besides the core.
   All of these are counts, combined before the shuffle, so no task holds the bucket.
5. The removed intervals meet the texts once, by text.

The same in words: with ``words`` the texts are read as runs of bytes without ASCII white space, each written as a number of 8 bytes, a hash of
the word; every run of that many words that also stands elsewhere is found, whatever its bytes and the white space in it.

All counts are over all places of all texts.  Texts are named by a 64-bit hash; that no two texts share one is checked, and another seed is taken
if they do.  So no string is taken for a repeat on the word of a 64-bit hash, but for words in the word form.

Defined results: null is the empty text; texts shorter than ``length`` lose nothing; strings never cross texts; a text that stands
twice loses all its bytes if it has ``length`` of them; repeated rows, also with equal ids, are separate places; null ids
stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from moraine.llm._common import Scratch, small_batches
from moraine.llm.words import Hasher, each_word, mix, word_places

LENGTH = 400
K = 160  # bytes of an anchor gram; capped at a quarter below the length
CHUNK = 1 << 18  # bytes hashed at a time
HOT, CLASSES = 256, 16
WORD = 8  # bytes that a word is written as
BATCH = 1 << 19  # bytes of runs fetched or sorted at a time, a bucket more at most
def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    step = 1
    while step * 2 <= w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[: len(v) - (w - step)], v[w - step :]) if w > step else v


def gram_size(length: int) -> int:
    return max(1, min(K, length * 3 // 4))


def encoded(text: str, step: int, hasher: Hasher) -> bytes:
    """What is searched of a text: its bytes, or with a step of WORD its words as numbers."""
    raw = text.encode("utf-8", "surrogatepass")
    if step == 1:
        return raw
    buf = np.frombuffer(raw, np.uint8)
    return each_word(buf, *word_places(buf), 0, hasher).tobytes()


def anchor_runs(buf: np.ndarray, valid: np.ndarray, length: int, hasher: Hasher, step: int = 1):
    """(start, n, at, gram hash) of each run of windows that name one anchor; ``valid`` marks the window starts to use, ``step`` apart.

    start: first window's start; n: bytes of all the run's windows; at: the anchor less start.
    """
    k = gram_size(length)
    w = length - k + 1
    h0 = hasher.prefix(buf, 0)
    g = mix(hasher.grams(h0, k))
    low = np.uint64((1 << 24) - 1)
    m = _sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), w)
    p = np.flatnonzero(valid[: len(m)])
    if not len(p):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    a = (m[p] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(p) != step)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(p) - 1]))
    start, end, at = p[first], p[last] + length, a[first]
    return start, end - start, at - start, g[at]


def _pack(start, n, at):
    return (start << 24) | (n << 12) | at


def _unpack(p):
    return p >> 24, (p >> 12) & 0xFFF, p & 0xFFF


def text_id(text, seed: int):
    return F.xxhash64(F.lit(seed), text)


def _anchors(texts: DataFrame, length: int, step: int = 1) -> DataFrame:
    """(gram, run, tid, place) rows of (tid, text)."""

    def kernel(batches):
        hasher = Hasher()

        def work(parts):
            raw = b"".join(x[2] for x in parts)
            buf, view = np.frombuffer(raw, np.uint8), memoryview(raw)
            valid = np.zeros(len(buf), bool)
            ends = np.cumsum([len(x[2]) for x in parts])
            begins = ends - [len(x[2]) for x in parts]
            for b, e in zip(begins, ends):
                valid[b : e - length + 1 : step] = True
            start, n, at, g = anchor_runs(buf, valid, length, hasher, step)
            which = np.searchsorted(ends, start, side="right")
            tid, off = np.array([x[0] for x in parts], np.int64), np.array([x[1] for x in parts], np.int64) - begins
            run = []
            for s, size, a in zip(start.tolist(), n.tolist(), at.tolist()):
                digest = hashlib.sha256(view[s : s + size])
                digest.update(a.to_bytes(2, "little"))
                run.append(digest.digest())
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(run, pa.binary()), pa.array(tid[which]), pa.array(_pack(start + off[which], n, at))], names=["gram", "run", "tid", "place"])

        for batch in batches:
            parts, size = [], 0
            for tid, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoded(t.as_py(), step, hasher)
                for q in range(0, len(raw) - length + 1, CHUNK):
                    parts.append((tid, q, raw[q : q + CHUNK + length - step]))
                    size += len(parts[-1][2])
                    if size >= CHUNK:
                        yield work(parts)
                        parts, size = [], 0
            if parts:
                yield work(parts)

    return texts.transform(small_batches).mapInArrow(kernel, "gram bigint, run binary, tid bigint, place bigint")


def _lcp(h, hasher, i, j, limit: int):
    """Common extension of suffixes i and j of a buffer, ``limit`` at most: binary search over prefix hashes."""
    low, high = np.zeros(len(i), np.int64), np.full(len(i), limit, np.int64)
    swap = i > j
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    shift = hasher.pow[0][j - i]
    hi, hj = h[i], h[j]
    while True:
        todo = low < high
        if not todo.any():
            return low
        mid = (low + high + 1) >> 1
        same = (h[i + mid] - hi) * shift == h[j + mid] - hj
        low, high = np.where(todo & same, mid, low), np.where(todo & ~same, mid - 1, high)


def sort_suffixes(buf: np.ndarray, pos: np.ndarray, segment: np.ndarray, length: int, hasher: Hasher, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``pos`` by (segment, first ``length`` bytes), and for each in that order whether it equals its predecessor.

    All segments are merged at once, bottom up: an element's place in the merged run is its own plus that of the elements before
    it in the other run, found by binary search.
    """
    order = np.argsort(segment, kind="stable")
    seg = segment[order]
    begin = np.concatenate(([0], np.flatnonzero(np.diff(seg)) + 1)) if len(seg) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((begin, [len(seg)])))
    base, total = np.repeat(begin, size), np.repeat(size, size)
    h = hasher.prefix(buf, 0)
    padded = np.concatenate((buf, np.zeros(1, np.uint8)))
    rank = np.arange(len(seg)) - base
    width, most = 1, int(size.max(initial=1))
    while width < most:
        run = rank // width
        other = (run ^ 1) * width  # begin of the run to merge with, within the segment
        todo = np.flatnonzero((other < total))
        lo, hi = (base + other)[todo], (base + np.minimum(other + width, total))[todo]
        left = (run[todo] & 1) == 0  # on ties the left run's element comes first
        me, floor_ = pos[order[todo]], lo.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            you, mine = pos[order[mid]], me[open_]
            ext = _lcp(h, hasher, mine, you, length)
            x, y = padded[np.minimum(you + ext, len(buf))], padded[np.minimum(mine + ext, len(buf))]
            full = ext >= length
            before = np.where(full, ~left[open_], x < y)  # the other's element stands before mine
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        new = np.arange(len(order))
        pair = base[todo] + (run[todo] & ~1) * width
        new[todo] = pair + rank[todo] % width + (lo - floor_)
        merged = np.empty_like(order)
        merged[new] = order
        order = merged
        width *= 2
    equal = np.zeros(len(order), bool)
    if len(order) > 1:
        near = np.flatnonzero(np.diff(seg) == 0) + 1
        i, j = pos[order[near - 1]], pos[order[near]]
        same = _lcp(h, hasher, i, j, length) >= length
        equal[near[same]] = True
        if not _verified(buf, i[same], j[same], length, step):
            keys = [(s, buf[p : p + length].tobytes()) for s, p in zip(segment.tolist(), pos.tolist())]
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
            equal = np.array([r > 0 and keys[order[r]] == keys[order[r - 1]] for r in range(len(order))], bool)
    return order, equal


def _verified(buf: np.ndarray, i: np.ndarray, j: np.ndarray, length: int, step: int = 1) -> bool:
    """Whether all pairs are equal in bytes: the first pair of each diagonal run in full, of the next ones the bytes that are new."""
    if not len(i):
        return True
    o = np.lexsort((i, (j - i), i % step))
    i, j = i[o], j[o]
    goes_on = np.concatenate(([False], (np.diff(i) == step) & (np.diff(j) == step)))
    same = lambda i, j, span: all((buf[i[a : a + 2048, None] + span] == buf[j[a : a + 2048, None] + span]).all() for a in range(0, len(i), 2048))
    return same(i[goes_on], j[goes_on], np.arange(length - step, length)) and same(i[~goes_on], j[~goes_on], np.arange(length))


def _intervals(off: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered intervals of windows at sorted starts."""
    if not len(off):
        return []
    cut = np.flatnonzero(np.diff(off) > length) + 1
    return [(int(a), int(b) + length) for a, b in zip(off[np.concatenate(([0], cut))], off[np.concatenate((cut - 1, [len(off) - 1]))])]


def _class_width(length: int) -> int:
    return -(-(length - gram_size(length) + 1) // CLASSES)


def _slices(asked: DataFrame, length: int, step: int = 1) -> DataFrame:
    """From (tid, z, wants: array of (gram, run, tid, place, hot)): the bytes of runs of cold buckets, and for hot ones a row for each class
    of offsets: hull and core, the reaches (anchor less start) of its windows, and the bytes of the hull left and right of the core."""
    schema = "hot boolean, gram bigint, tid bigint, place bigint, data binary, class int, hull binary, core binary, most int, least int, left binary, right binary"
    kinds = [pa.bool_(), *[pa.int64()] * 3, pa.binary(), pa.int32(), *[pa.binary()] * 2, *[pa.int32()] * 2, *[pa.binary()] * 2]
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(batches):
        hasher, unzip, width = Hasher(), zstandard.ZstdDecompressor(), _class_width(length)

        def pack(rows):
            cols = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

        last = None
        for batch in batches:
            rows, size = [], 0
            for tid, z, wants in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if tid == last:
                    continue
                last, raw = tid, encoded(unzip.decompress(z.as_py()).decode("utf-8", "surrogatepass"), step, hasher)
                for w in wants:
                    w = w.as_py()
                    start, n, at = _unpack(w["place"])
                    data = raw[start : start + n]
                    ids = (w["gram"], w["tid"], w["place"])
                    size += n
                    if not w["hot"]:
                        rows.append((False, *ids, data, *[None] * 7))
                    else:
                        reach = at - np.arange(0, n - length + 1, step)
                        for c in np.unique(reach // width).tolist():
                            mine = reach[reach // width == c]
                            most, least = int(mine[0]), int(mine[-1])
                            # the bytes that all windows of this class hold, in terms of the anchor alone
                            b, e = at - c * width, at - (c + 1) * width + 1 + length
                            hull = data[at - most : at - least + length]
                            name = hashlib.sha256(hull + most.to_bytes(2, "little") + least.to_bytes(2, "little")).digest()
                            rows.append((True, *ids, None, c, name, hashlib.sha256(data[b:e]).digest(), most, least, data[at - most : b], data[e : at - least + length]))
                    if size >= BATCH:
                        yield pack(rows)
                        rows, size = [], 0
            yield pack(rows)

    return asked.transform(small_batches).mapInArrow(kernel, schema)


def _hot_repeats(rows: DataFrame, length: int, step: int, scratch: Scratch) -> DataFrame:
    """(tid, s, e): repeated intervals of the hot buckets' rows of ``_slices``."""
    by = ["gram", "class", "core"]
    kinds = rows.groupBy(*by, "hull").agg(F.count("*").alias("n"), F.min(F.struct("tid", "place", "most", "least", "left", "right")).alias("one"))
    kinds = scratch.keep(kinds)
    anchor = F.shiftright("place", 24) + F.col("place").bitwiseAND(F.lit(0xFFF))
    whole = rows.join(kinds.where("n > 1").select(*by, "hull"), [*by, "hull"], "left_semi").select("tid", (anchor - F.col("most")).alias("s"), (anchor - F.col("least") + length).alias("e"))
    several = kinds.groupBy(*by).agg(F.count("*").alias("hulls")).where("hulls > 1").select(*by)
    width = _class_width(length)
    windows = kinds.join(several, by, "left_semi").select(*by, "n", "one.*").withColumn("reach", F.explode(F.sequence("least", "most", F.lit(step))))
    # what a window has besides the core: the nearest bytes on its left, the others of its length on its right
    more = F.col("reach") - F.col("class") * width
    beside = F.concat(F.substring("left", F.octet_length("left") - more + 1, more), F.substring("right", F.lit(1), width - 1 - more))
    windows = scratch.keep(windows.select(*by, "n", "tid", (anchor - F.col("reach")).alias("s"), "reach", beside.alias("beside")))
    twice = windows.groupBy(*by, "reach", "beside").agg(F.count("*").alias("times")).where("times > 1").select(*by, "reach", "beside")
    found = windows.where("n = 1").join(twice, [*by, "reach", "beside"], "left_semi").select("tid", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(found)


def _sorted_repeats(runs: DataFrame, length: int, step: int = 1) -> DataFrame:
    """(tid, s, e): repeated intervals of runs (gram, place, tid, data), by suffix sort within each gram's bucket."""

    def solve(rows):
        data = [r[3] for r in rows]
        buf = np.frombuffer(b"".join(data), np.uint8)
        base = np.cumsum([0, *map(len, data[:-1])])
        starts, n, at = (np.array(x, np.int64) for x in zip(*(_unpack(r[1]) for r in rows)))
        bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        count = (n - length) // step + 1
        who = np.repeat(np.arange(len(rows)), count)
        off = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
        # equal windows have their anchor at the same offset
        segment = bucket[who] * 4096 + (at[who] - off)
        seen, back, times = np.unique(segment, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[back] > 1)
        who, off, segment = who[several], off[several], back[several]
        order, equal = sort_suffixes(buf, base[who] + off, segment, length, hasher, step)
        twice = equal | np.concatenate((equal[1:], [False]))
        found = order[twice]
        found = found[np.lexsort((off[found], who[found]))]
        for r, part in zip(*_split(who[found], off[found])):
            for s, e in _intervals(part, length):
                yield rows[r][2], int(starts[r]) + s, int(starts[r]) + e

    hasher = Hasher()

    def kernel(batches):
        rows, size = [], 0
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("gram", "place", "tid", "data"))):
                if size >= BATCH and r[0] != rows[-1][0]:
                    out += solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
            yield _interval_batch(out)
        if rows:
            yield _interval_batch(list(solve(rows)))

    return runs.select("gram", "place", "tid", "data").repartition("gram").sortWithinPartitions("gram", "tid", "place").transform(small_batches).mapInArrow(kernel, "tid bigint, s bigint, e bigint")


def _split(who: np.ndarray, off: np.ndarray):
    cut = np.flatnonzero(np.diff(who)) + 1
    return (who[np.concatenate(([0], cut))].tolist() if len(who) else []), np.split(off, cut)


def _interval_batch(rows):
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["tid", "s", "e"])


def _zipped(docs: DataFrame, tid_and_text, *keep: str, once: bool = False) -> DataFrame:
    """(tid, z, keep...): texts as zstd, which halves what the joins by text move.  ``once``: of equal texts each task passes on the first."""
    source = docs.select(*tid_and_text, *keep)

    def kernel(batches):
        zip_, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            if once:
                fresh = [t not in seen and not seen.add(t) for t in batch.column(0).to_pylist()]
                batch = batch.filter(pa.array(fresh, pa.bool_()))
            z = pa.array([zip_.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z, *batch.columns[2:]], names=["tid", "z", *batch.schema.names[2:]])

    schema = StructType([StructField("tid", LongType()), StructField("z", BinaryType()), *(source.schema[c] for c in keep)])
    return source.transform(small_batches).mapInArrow(kernel, schema)


def _named(docs: DataFrame, text_col: str, scratch: Scratch):
    """A seed under which no two texts share an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for seed in range(42, 52):
        ids = docs.select(text_id(text, seed).alias("tid"), F.xxhash64(text, F.lit("again")).alias("x"), F.length(text).alias("n"))
        clash = ids.groupBy("tid").agg(F.min(F.struct("x", "n")).alias("a"), F.max(F.struct("x", "n")).alias("b")).where("a <> b")
        if clash.isEmpty():
            return seed
    raise RuntimeError("no seed without colliding text ids")


def find_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, scratch: Scratch | None = None, words: int | None = None, seed: int | None = None) -> tuple[DataFrame, int]:
    """(tid, spans: sorted array of (s, e)) of each text with repeated strings, and the seed of the text ids, which may be given.  With ``words`` the strings
    are runs of that many words, whatever ``length``, and s and e count words."""
    step = WORD if words else 1
    length = words * WORD if words else length
    if not 1 <= length <= 2000:
        raise ValueError("length is 1 to 2000 bytes, or 250 words: places are packed into 12 bits")
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    seed = _named(docs, text_col, scratch) if seed is None else seed
    text = F.col(text_col)
    least = 2 * words - 1 if words else length
    named = docs.where(text.isNotNull() & (F.octet_length(text) >= least)).select(text_id(text, seed).alias("tid"), text.alias("text"))
    anchors = scratch.keep(_anchors(named, length, step))
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    grams = scratch.keep(grams)  # so that both sides of the join are plain exchanges and a hot gram's rows can be split
    several = scratch.keep(anchors.join(grams, "gram", "left_semi"))
    scratch.drop(anchors)
    runs = scratch.keep(several.groupBy("gram", "run").agg(F.count("*").alias("n"), F.min(F.struct("tid", "place")).alias("first")))
    buckets = runs.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = several.join(runs.where("n > 1").select("gram", "run"), ["gram", "run"], "left_semi")
    whole = whole.select("tid", F.shiftright("place", 24).alias("s"), (F.shiftright("place", 24) + F.shiftright("place", 12).bitwiseAND(F.lit(0xFFF))).alias("e"))
    asked = runs.join(buckets, "gram").select("first.tid", F.struct("gram", "first.tid", "first.place", (F.col("kinds") > HOT).alias("hot")).alias("want"))
    asked = asked.groupBy("tid").agg(F.collect_list("want").alias("wants"))
    one = _zipped(named, ("tid", "text"), once=True)
    fetched = scratch.keep(_slices(one.join(asked, "tid").select("tid", "z", "wants").sortWithinPartitions("tid"), length, step))
    cold = _sorted_repeats(fetched.where("NOT hot"), length, step)
    hot = _hot_repeats(fetched.where("hot"), length, step, scratch)
    every = whole.unionByName(cold).unionByName(hot).distinct()
    spans = F.array_sort(F.collect_list(F.struct((F.col("s") / step).cast("bigint").alias("s"), (F.col("e") / step).cast("bigint").alias("e"))))
    spans = scratch.keep(every.groupBy("tid").agg(spans.alias("spans")))
    scratch.only(spans)
    return spans, seed


def merge_spans(spans) -> list[tuple[int, int]]:
    """Sorted (start, end) pairs as maximal disjoint runs; touching ones become one."""
    out: list[list[int]] = []
    for s, e in spans or ():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(raw: bytes, spans) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, spans) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that what is kept is text."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _word_bytes(raw: bytes, spans) -> list[tuple[int, int]]:
    """The bytes of runs of words."""
    if not spans:
        return []
    start, end = word_places(np.frombuffer(raw, np.uint8))
    return [(int(start[x["s"]]), int(end[x["e"] - 1])) for x in spans]


def _found(docs: DataFrame, text_col: str, length: int, words: int | None, scratch: Scratch) -> tuple[DataFrame, int]:
    """(tid, spans, passages) of texts with repeats: byte strings, and runs of words if ``words``; and the seed."""
    spans, seed = find_repeats(docs, text_col, length, Scratch(docs.sparkSession, "suffixes"))
    if not words:
        return spans.withColumn("passages", F.lit(None).cast(spans.schema["spans"].dataType)), seed
    passages, _ = find_repeats(docs, text_col, words=words, seed=seed, scratch=Scratch(docs.sparkSession, "passages"))
    return scratch.keep(spans.join(passages.withColumnRenamed("spans", "passages"), "tid", "full")), seed


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, spans (array of removed (start, end), disjoint and maximal), kept_sha256, and
    passages: with ``words`` the maximal runs, in bytes, of words that a repeated run of that many words covers; they are told, not removed."""
    spans, seed = _found(docs, text_col, length, words, Scratch(docs.sparkSession, "suffixes"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _zipped(docs.withColumn("_moraine_id", F.col(id_col)), (text_id(text, seed).alias("tid"), text.alias("text")), "_moraine_id")
    joined = rows.join(spans, "tid", "left").select("_moraine_id", "z", "spans", "passages")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    listed = lambda spans: [{"start": s, "end": e} for s, e in spans]

    def kernel(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, got, more in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = unzip.decompress(z.as_py())
                removed = merge_spans((x["s"], x["e"]) for x in got.as_py() or ())
                runs = _word_bytes(raw, [{"s": s, "e": e} for s, e in merge_spans((x["s"], x["e"]) for x in more.as_py() or ())])
                out.append((len(raw), sum(e - s for s, e in removed), listed(removed), hashlib.sha256(cut(raw, removed)).hexdigest(), listed(runs)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), kind, pa.string(), kind)))], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256", "passages"])

    id_type = docs.schema[id_col].dataType.simpleString()
    spans_type = "array<struct<start:bigint,end:bigint>>"
    return joined.transform(small_batches).mapInArrow(kernel, f"id {id_type}, n_bytes bigint, n_removed bigint, spans {spans_type}, kept_sha256 string, passages {spans_type}")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, size_col: str | None = None, words: int | None = None) -> DataFrame:
    """``docs`` with repeated strings cut from the texts, whole characters only; other columns unchanged but ``size_col``, if named,
    which gets the new number of characters.  With ``words``, runs of that many words that also stand elsewhere are cut as well, whatever
    their bytes.  Null texts stay null."""
    spans, seed = _found(docs, text_col, length, words, Scratch(docs.sparkSession, "suffixes"))
    others = [c for c in docs.columns if c != text_col]
    source = docs.select(*others, F.col(text_col).isNull().alias("_moraine_null"), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    # the caller's columns travel as one, so that none can clash with the names used here
    packed = source.select(F.struct("_moraine_null", *others).alias("row"), F.col(text_col).alias("text"))
    rows = _zipped(packed, (text_id(F.col("text"), seed).alias("tid"), F.col("text")), "row")
    joined = rows.join(spans, "tid", "left").select("row", "z", "spans", "passages")

    def kernel(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            row = batch.column("row")
            field = {c: row.field(i) for i, c in enumerate(["_moraine_null", *others])}
            for z, null, got, more in zip(batch.column("z"), field["_moraine_null"], batch.column("spans"), batch.column("passages")):
                raw = unzip.decompress(z.as_py())
                every = [(x["s"], x["e"]) for x in got.as_py() or ()] + _word_bytes(raw, more.as_py())
                removed = whole_characters(raw, merge_spans(sorted(every)))
                texts.append(None if null.as_py() else cut(raw, removed).decode("utf-8", "surrogatepass"))
            cols = {c: field[c] for c in others} | {text_col: pa.array(texts, pa.string())}
            if size_col:
                cols[size_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    names = docs.columns
    return joined.transform(small_batches).mapInArrow(kernel, docs.schema)
