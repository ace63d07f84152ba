import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: a text longer than any buffer that a kernel works in, and what else texts may be
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and extra columns named like internal ones."""
    rows = [
        (1, "Hello wörld, this is the MIT License.", "en", "a", 1),
        (1, "Hello wörld, this is the MIT License.", "en", "a", 1),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (None, "a text without an id", "en", "b", 3),
        (None, None, None, None, None),
        (4, LONG, "la", "b", 4),
        (5, LONG, "la", "b", 4),
        (6, " \t\n ", "en", None, 4),
        (7, "12345 !!! 678", None, "c", 4),
        (8, "\U0001f600 Kİ ÉÀ", "fr", "c", 4),
    ]
    extra = "id bigint, fp bigint, tid bigint, z binary, spans string, key string, words string, h string, label string, size string, p string, open string, source_idx string, _rank string"
    names = [x.split()[0] for x in extra.split(", ")]
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
