"""Decontamination and license scans: SQL, brute force, plans without Python, odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from oracles import duck, same_rows
from moraine.llm import catalog, decontaminate, licenses
from moraine.llm.tokens import WORD, lowered, raw_words

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def is_native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow|MapIn", plan)


def test_words(spark):
    texts = ["", None, "Abc-DEF 12_x É\u212a\u0130ß \x00z\x7fq", "\U0001f600a.B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(lowered(raw_words(F.col("t")))).collect()] == [tokens(t) for t in texts]
    assert all(bool(re.fullmatch(WORD, chr(c))) == bool(re.fullmatch(r"[0-9A-Za-z\x80-\U0010FFFF]", chr(c))) for c in range(300))


def windows(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [tuple(words)] * bool(words)


def brute(docs, items, width):
    by = {}
    for item, text in items:
        for w in windows(tokens(text), width):
            by.setdefault(w, set()).add("" if item is None else str(item))
    out = []
    for _, text in docs:
        words, hit, found = tokens(text), set(), set()
        for w, ids in by.items():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= ids
        out.append((len(words), len(hit), tuple(sorted(found))))
    return out


DOCS = [
    (1, "x a b c d e y"),
    (1, "x a b c d e y"),
    (2, "A B c A B c A B c"),
    (3, None),
    (None, "É b c q"),
    (4, "é b c q r"),
    (5, "a b x c b a q q q"),
    (6, "\u212a b c"),
    (7, ""),
    (8, "word " * 3000 + "a b c d e " + "word " * 3000),
]
ITEMS = [(1, "a b c d"), (2, "b c"), (3, "A b C a"), (3, "c d e"), (None, "q q q q"), (4, None), (5, "é B c"), (6, "k b c"), (10, "a b c d"), (7, "")]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
@pytest.mark.parametrize("width", [3, 10])
def test_contamination_against_brute_force(spark, monkeypatch, width, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST", limit)
    docs = spark.createDataFrame([(*d, "x", "y") for d in DOCS], "doc_id bigint, text string, key string, window string")
    items = spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id bigint, text string, term string")
    out = decontaminate.contamination(docs, items, width=width)
    assert sorted((-1 if r.id is None else r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect()) == sorted((-1 if d[0] is None else d[0], *b) for d, b in zip(DOCS, brute(DOCS, ITEMS, width)))
    clean = decontaminate.remove_contaminated(docs, items, width=width)
    assert clean.columns == docs.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(d[1] or "" for d, b in zip(DOCS, brute(DOCS, ITEMS, width)) if not b[1])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "v d c x b a w"), (2, "a b y y y y y y y c d")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    found = lambda **k: {(r.kind) for r in decontaminate.find_matches(docs.where("doc_id = 1"), items, width=4, **k)[0].collect()}
    assert found() == set() and found(near=1.0, slop=1) == {"near"}
    matches, _ = decontaminate.find_matches(docs.where("doc_id = 2"), items, width=4, near=0.5)
    assert {r.kind for r in matches.collect()} == {"near"}
    assert decontaminate.find_matches(docs.where("doc_id = 2"), items, width=4, near=1.0)[0].isEmpty()


def test_queries_are_native_and_match_sql(spark, sf_dir):
    con = duck(sf_dir)
    df = catalog.op4_decontaminate(spark, sf_dir)
    assert is_native(df) and is_native(catalog.op9_license_scan(spark, sf_dir))
    same_rows(df, con, catalog.OP4_SQL)
    same_rows(catalog.op9_license_scan(spark, sf_dir), con, catalog.OP9_SQL)


def test_notices_match_sql(spark, tmp_path):
    """Notices whole, cut, changed and repeated, beside phrases: the SQL gives the same spans."""
    import duckdb

    text = licenses.NOTICES[0][0]
    w = text.split()
    texts = [text, " ".join(w[4:]), " ".join(w[:9] + ["new"] + w[9:20]), f"{text} MIT License {text}", " ".join(w[:5] + w[12:]), licenses.NOTICES[2][0] * 2, None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same_rows(catalog.op9_license_scan(spark, str(tmp_path)), con, catalog.OP9_SQL)


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contamination(no_docs, items).count() == 0
    none = decontaminate.contamination(odd_docs, items.where("false")).collect()
    assert len(none) == 11 and all(r.n_hit == 0 and r["items"] == [] for r in none)
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == 11 and licenses.scan_licenses(no_docs).count() == 0
    assert [len(r.spans) for r in rows if r.id == 1] == [1, 1]


def base_places(text):
    words, out = tokens(text), []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_base_phrases_against_brute_force(spark, sf_dir):
    texts = ["CC-BY cc by cc", "the MIT\nLicense; apache license apache license", "gnu general public license gnu general public\tlicense mit", "gnu general license public license", "m\u0130t license M\u0130T mit\u212a license", "", None, "É apache licensé apache license"]
    extra = spark.createDataFrame(list(enumerate(texts, 10**6)), "doc_id bigint, text string")
    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    got = {r.id: r for r in licenses.scan_licenses(docs).collect()}
    some = 0
    for d in docs.collect():
        n, places = base_places(d.text)
        r = got[d.doc_id]
        assert r.n_words == n
        assert sorted((s.first, s.label) for s in r.spans if s.is_base) == places
        some += bool(places)
    assert some > 5


def test_notices(spark):
    notice, label = licenses.NOTICES[5]
    words = re.findall(r"\w+", notice)
    texts = ["before " + notice + " after", " ".join(words[:9] + ["extra"] + words[9:]), " ".join(words[:8] + words[10:]), " ".join(words[:7]), " ".join(reversed(words)), notice + " x " * 30 + notice]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: [(s.label, s.first, round(s.share, 2)) for s in r.spans if not s.is_base] for r in licenses.scan_licenses(df).collect()}
    assert got[0] == [(label, 1, 1.0)]
    assert [x[:2] for x in got[1]] == [(label, 0)] and [x[:2] for x in got[2]] == [(label, 0)]
    assert got[3] == [] and got[4] == []
    assert [x[0] for x in got[5]] == [label, label]


def test_a_stray_hit_does_not_split_a_notice(spark, tmp_path):
    """Words of the notice that stand again inside it vote for another diagonal."""
    import duckdb

    notice, label = licenses.NOTICES[0]
    w = notice.split()
    df = spark.createDataFrame([(0, " ".join(w[:12] + w[1:7] + w[18:])), (1, " ".join(w[:12] + w[1:7]))], "doc_id bigint, text string")
    got = {r.id: [(s.label, s.first, s.last) for s in r.spans] for r in licenses.scan_licenses(df).collect()}
    assert got == {0: [(label, 0, len(w) - 1)], 1: []}
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same_rows(catalog.op9_license_scan(spark, str(tmp_path)), con, catalog.OP9_SQL)


def test_templates_are_a_parameter(spark, monkeypatch):
    templates = spark.createDataFrame([("Do what you want", "free", True), ("Do what you want", "free", True), ("one two three four five six", "count", False), ("too short", "none", False), (None, "x", True), ("a b", None, True)], "text string, label string, is_base boolean")
    docs = spark.createDataFrame([(0, "x do what YOU want y one two three four five"), (1, "one two")], "doc_id bigint, text string")
    for bound in (licenses.BROADCAST, 0):
        monkeypatch.setattr(licenses, "BROADCAST", bound)
        got = {r.id: sorted((s.label, s.first, s.last, round(s.share, 2)) for s in r.spans) for r in licenses.scan_licenses(docs, templates=templates).collect()}
        assert got == {0: [("count", 6, 10, 0.83), ("free", 1, 4, 1.0)], 1: []}


def test_clashing_columns_in_the_stage(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 2), (2, "d e", "y", 3)], "doc_id bigint, text string, key string, _bad_key int")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    out = decontaminate.remove_contaminated(docs, items)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "d e", "y", 3)]
