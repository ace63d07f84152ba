"""Benchmark decontamination by a distributed positional inverted index.  DataFrame functions only.

Test windows are all runs of ``width`` words of an item; a shorter item is one window.  How often each test term stands in the training
texts is counted over all of them; the rarest term of a window is where its search begins.  The index stores the training postings of
those terms, (term, text, position), each with the block of postings around it: the terms at the positions within a window's reach.  No
other posting can matter.  A window's candidate starts are the postings of its rarest term less that term's offset.  At a
candidate start the offset-adjusted lists of all its terms are intersected by comparing the block with them: all terms at their offsets are
an exact phrase match; at least ``near`` of its different terms anywhere in the block, in any order, a proximity match.  For those a window
of m different terms is searched from its m - ceil(near m) + 1 rarest: one of them at least stands in any text with ceil(near m) of them.

A frequent term costs postings only if it is the rarest of some window.  Texts are not shuffled, postings neither: blocks meet the test
side by broadcast if its rows number ``BROADCAST`` at most, which is counted first; beyond that the same joins shuffle, and adaptive
execution splits hot terms.

Terms are found by their Unicode lower case, which words that agree but for A-Z share, and then compared with only A-Z lower-cased.

Defined results: null and empty training texts have no words and no matches; null and empty items have no windows; items with the
same id count once; a null item id counts as the empty string; repeated rows stay repeated; empty tables give
results without matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm._common import Scratch
from moraine.llm.tokens import count_words, lowered, positions, raw_words, text_key

WIDTH = 10
BROADCAST = 200_000  # rows of (term, window) on the test side; each some 200 bytes but for odd words


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(window, item, terms): each distinct run of words, with a number made of its words, and the items that hold it."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), lowered(raw_words(F.col(text_col))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    runs = rows.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), width).alias("terms"))
    return runs.select(F.unhex(F.md5(F.array_join("terms", " ").cast("binary"))).alias("window"), "item", "terms").distinct()


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, text_col: str = "text") -> DataFrame:
    """(term, n): how often each of ``terms``, lower-cased, stands in all texts."""
    seen = positions(docs, text_col).select(F.lower("word").alias("term")).join(_small(terms, n_terms), "term", "left_semi")
    return terms.join(seen.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def store_postings(docs: DataFrame, terms: DataFrame, n_terms: int, reach: int, text_col: str = "text") -> DataFrame:
    """(term, key, pos, base, block): the postings of ``terms``; block holds the words at positions base, base + 1, ... around pos."""
    hubs = positions(docs, text_col).withColumn("term", F.lower("word")).join(_small(terms, n_terms), "term", "left_semi")
    base = F.greatest(F.col("pos") - reach, F.lit(0))
    return hubs.select("term", "key", "pos", base.alias("base"), lowered(F.slice("words", base + 1, F.col("pos") - base + (reach + 1))).alias("block"))


def find_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, slop: int = 0, near: float | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, windows).  matches: key (of the text), window, start, size, kind ('exact' or 'near'), each once; near ones only if ``near``, a share
    of a window's terms, is given; ``slop`` words more on either side may then hold them.  windows: those of ``test_windows``."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.keep(test_windows(items, item_id_col, item_text_col, width))
    spots = scratch.keep(windows.select("window", "terms").distinct().select("window", "terms", F.posexplode("terms").alias("offset", "term")).withColumn("term", F.lower("term")))
    n_spots = spots.count()
    counts = scratch.keep(term_counts(docs, spots.select("term").distinct(), n_spots, text_col))
    rarest = Window.partitionBy("window").orderBy("n", "term", "offset")
    known = spots.join(counts, "term")
    if near is None:
        chosen = known.withColumn("k", F.row_number().over(rarest)).where("k = 1 AND n > 0")
    else:
        # of a repeated term all offsets have one rank; terms that no text holds take their rank as well, but have no postings
        m = F.size(F.array_distinct("terms"))
        by_term = Window.partitionBy("window").orderBy("n", "term")
        chosen = known.withColumn("k", F.dense_rank().over(by_term)).where((F.col("k") <= m - F.ceil(m * F.lit(near)) + 1) & (F.col("n") > 0))
    anchors = scratch.keep(chosen.select("term", "window", "terms", F.col("offset").alias("at")))
    index = scratch.keep(store_postings(docs, anchors.select("term").distinct(), n_spots, width - 1 + slop, text_col))
    tried = index.join(_small(anchors, n_spots), "term").withColumn("start", F.col("pos") - F.col("at")).withColumn("size", F.size("terms"))
    meets = F.slice("block", F.greatest(F.col("start") - F.col("base") + 1, F.lit(1)), F.col("size")) == F.col("terms")
    kind = F.when((F.col("start") >= 0) & meets, "exact")
    if near is not None:
        kind = kind.when(F.size(F.array_intersect("block", "terms")) >= F.ceil(F.size(F.array_distinct("terms")) * F.lit(near)), "near")
    matches = tried.select("key", "window", "start", "size", kind.alias("kind")).where("kind IS NOT NULL").distinct()
    return matches, windows


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, slop: int = 0, near: float | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_hit (words inside an exact match), items (sorted ids, as strings, of items with one); with ``near``
    also near_items, those of items with proximity matches only."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    matches, windows = find_matches(docs, items, text_col, item_id_col, item_text_col, width, slop, near, scratch=scratch)
    if near is not None:
        matches = scratch.keep(matches)
    exact = scratch.keep(matches.where("kind = 'exact'").select("key", "window", "start", "size"))
    scratch.only(windows, exact, matches)
    hit = exact.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    which = exact.select("key", "window").distinct().join(windows.select("window", "item"), "window").select("key", "item").distinct()
    which = which.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), count_words(F.col(text_col)).alias("n_words"))
    out = rows.join(hit.join(which, "key"), "key", "left")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    columns = ["id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), listed("items")]
    if near is None:
        return out.select(*columns)
    close = matches.where("kind = 'near'").select("key", "window").distinct().join(windows.select("window", "item"), "window").groupBy("key").agg(F.collect_set("item").alias("close"))
    out = out.join(close, "key", "left").withColumn("near_items", F.array_sort(F.array_except("close", F.coalesce("items", F.array().cast("array<string>")))))
    return out.select(*columns, listed("near_items"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any exact match, all columns unchanged."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    matches, _ = find_matches(docs, items, text_col, item_id_col, item_text_col, width, scratch=scratch)
    bad = scratch.keep(matches.where("kind = 'exact'").select("key").distinct())
    scratch.only(bad)
    # the row travels as one column, so that no name can clash
    rows = docs.select(text_key(docs[text_col]).alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(bad, "key", "left_anti").select("row.*")
