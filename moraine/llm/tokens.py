"""Native word columns: tokens, their positions, and a key that names a text.

DataFrame functions only.  Rows are named by a digest of their text, as ids may be null or repeated and every result here depends
on the text alone; so equal texts are worked on under one name and all their rows get its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm._common import ascii_lower

#: a word: letters and digits of ASCII and everything beyond ASCII.  The other ASCII characters one by one, not as ranges: a class of single
#: characters is a table lookup in Java's matcher, and half as slow
WORD = "[^" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"


def raw_words(text):
    """The words of a text as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(words):
    """An array of words with A-Z lower-cased."""
    return F.transform(words, ascii_lower)


def count_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def text_key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def positions(docs: DataFrame, text_col: str, seen_as=lambda text: text) -> DataFrame:
    """(key, words, pos, word) for every word of every row, pos from 0; ``seen_as`` is applied to the text before it is cut, not for the key.

    ``words`` is the row's whole array: within one stage of generated code it is passed on by reference.
    """
    rows = docs.select(text_key(F.col(text_col)).alias("key"), raw_words(seen_as(F.col(text_col))).alias("words"))
    return rows.select("key", "words", F.posexplode("words").alias("pos", "word"))
