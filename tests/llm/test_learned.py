"""Toxicity and language identification: held-out accuracy, whole texts, odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from moraine.llm import catalog, langid, toxicity


def test_toxicity_holds_out(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in catalog.table(spark, sf_dir.replace("0.001", "0.01"), "labels").collect()}
    rows = catalog.op10_toxicity(spark, sf_dir.replace("0.001", "0.01")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.9


def test_toxic_word_in_a_very_long_text():
    bad, good = ["you awful zork", "zork off", "what a zork he is"], ["nice day", "you are kind", "what a day it is"]
    texts = [f"{t} {n}" for t in bad + good for n in range(6)]
    model = toxicity.fit([toxicity.features_of(t) for t in texts], np.array([1] * 18 + [0] * 18), penalty=0.02)
    filler = "lorem ipsum dolor sit amet " * 20_000
    assert toxicity.score_text(filler + "you awful zork", model.weights, model.bias) > 0.5 > toxicity.score_text(filler, model.weights, model.bias)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    some = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (8, None), (7, 5)], "doc_id bigint, toxic int")
    for labels in (none, some, some.where("toxic = 1")):
        model = toxicity.train(odd_docs, labels)
        rows = toxicity.score(odd_docs, model).collect()
        assert len(rows) == 11 and len({r.score for r in rows if r.id in (2, 3)}) == 1
    assert all(r.predicted == 0 for r in toxicity.score(odd_docs, toxicity.train(odd_docs, none)).collect())
    model = toxicity.train(odd_docs, some)
    assert toxicity.score(no_docs, model).count() == 0 and toxicity.reject_toxic(odd_docs, model).columns == odd_docs.columns
    assert toxicity.train(no_docs, some).weights.any() == False  # noqa: E712


def test_languages_hold_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    langs = {r.doc_id: r.lang for r in catalog.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = catalog.op2_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def brute_marginals(e, trans, start):
    n, k = e.shape
    p = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = start[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
        for i, y in enumerate(path):
            p[i, y] += np.exp(s)
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_forward_backward(monkeypatch, block):
    """Several texts in one run of blocks: the same as all paths of each, summed."""
    monkeypatch.setattr(langid, "BLOCK", block)
    r = np.random.default_rng(block)
    lengths, trans, start = [5, 1, 6, 2], r.normal(size=(3, 3)), r.normal(size=3)
    e = r.normal(size=(sum(lengths), 3)) * 2
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, at = langid.marginals(e, first, trans, start), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute_marginals(e[at : at + n], trans, start))
        at += n


def test_switches_inside_a_text(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents")
    crf = langid.train(docs)
    by = {r.lang: r.text for r in docs.orderBy("doc_id").collect()}
    a, b = (" ".join(by[x].split()[:60]) for x in ("de", "fr"))
    df = spark.createDataFrame([(1, f"{a} {b}")], "doc_id bigint, text string")
    row = langid.identify(df, crf).first()
    big = [s.lang for s in row.spans if s.words >= 20]
    assert big == ["de", "fr"] and sum(s.words for s in row.spans) == row.n_words


def test_language_odd_rows(odd_docs, no_docs):
    crf = langid.train(odd_docs)
    assert crf.labels == ["en", "fr", "la"]
    rows = langid.identify(odd_docs, crf).collect()
    assert len(rows) == 11
    assert {r.lang for r in rows if r.id in (2, 3, 6, 7)} == {"und"} and {r.score for r in rows if r.id in (2, 3, 6, 7)} == {0.0}
    assert {r.lang for r in rows if r.id in (4, 5)} == {"la"}
    assert {r.lang for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, crf).count() == 0
