import random

import numpy as np
import pytest

import brute
from moraine.llm import suffixes


def spans_of(df):
    return {r.id: [(x.start, x.end) for x in r.spans] for r in df.collect()}


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    r = random.Random(seed)
    pieces = ["".join(r.choice("abé") for _ in range(r.choice([3, 12, 25, 40]))) for _ in range(12)]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 8))) for _ in range(50)] + ["a" * 90, "", None, "a" * 30, "ab" * 50]
    # one passage in very many texts, with other bytes around it: windows differ at both ends
    texts += [r.choice("xyz") * r.randint(0, 6) + pieces[0] * 2 + r.choice("xyz") * r.randint(0, 6) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = spans_of(suffixes.repeated_bytes(df, length=20))
    assert [got[i] for i in range(len(texts))] == brute.repeated_spans(texts, 20)


def test_query_against_brute_force(spark, sf_dir):
    import hashlib

    from moraine.llm import catalog

    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute.repeated_spans([d.text for d in docs], 400)
    got = {r.doc_id: r for r in catalog.op1_suffix_dedup(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, spans in zip(docs, want):
        raw, r = d.text.encode(), got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(e - s for s, e in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(suffixes.cut(raw, spans)).hexdigest()
    assert any(want)


def test_query_matches_sql(spark, sf_dir):
    from moraine.llm import catalog
    from oracles import duck, same_rows

    same_rows(catalog.op1_suffix_dedup(spark, sf_dir), duck(sf_dir), catalog.OP1_SQL)


def test_suffix_sort_and_collisions(monkeypatch):
    r = np.random.default_rng(2)
    buf = r.integers(97, 99, 400, dtype=np.uint8)
    pos, seg = np.arange(350), r.integers(0, 5, 350)
    want = sorted(range(350), key=lambda i: (seg[i], buf[pos[i] : pos[i] + 8].tobytes()))
    for broken in (False, True):
        if broken:  # a hash that says nothing differs: verification must see it
            monkeypatch.setattr(suffixes, "_lcp", lambda h, hasher, i, j, limit: np.full(len(i), limit))
        order, equal = suffixes.sort_suffixes(buf, pos, seg, 8, suffixes.Hasher())
        key = lambda i: (seg[i], buf[pos[i] : pos[i] + 8].tobytes())
        assert [key(i) for i in order] == [key(i) for i in want]
        assert equal.tolist() == [k > 0 and key(order[k]) == key(order[k - 1]) for k in range(350)]


def test_odd_rows(odd_docs, no_docs):
    rows = suffixes.repeated_bytes(odd_docs).collect()
    assert len(rows) == 11
    long = [r for r in rows if r.id in (4, 5)]
    assert all(r.n_removed == r.n_bytes > 400 and len(r.spans) == 1 for r in long)
    assert all(r.n_removed == 0 for r in rows if r.id not in (4, 5))
    out = suffixes.remove_repeats(odd_docs, size_col="n_chars")
    assert out.columns == odd_docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[4] == ("", 0) and texts[3] == (None, None) and texts[2] == ("", 0) and texts[1][0].startswith("Hello")
    assert suffixes.repeated_bytes(no_docs).count() == 0 and suffixes.remove_repeats(no_docs).count() == 0


def test_characters_stay_whole():
    raw = "aébé".encode()
    assert suffixes.whole_characters(raw, [(2, 5)]) == [(3, 4)]
    assert suffixes.cut(raw, [(3, 4)]).decode() == "aéé"
    assert suffixes.merge_spans([(0, 3), (3, 5), (7, 9), (8, 12)]) == [(0, 5), (7, 12)]
