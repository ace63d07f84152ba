"""Repeated passages in words, and the pipeline stage that cuts them."""

import random
from collections import Counter

import pytest

from moraine.llm import suffixes, words as word_module


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("words", [1, 3, 20])
def test_passages_against_brute_force(spark, monkeypatch, words, hot):
    monkeypatch.setattr(word_module, "AT_ONCE", 7)
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    r = random.Random(words)
    parts = [" ".join(r.choice(["a", "bb", "é", "d-1"]) for _ in range(n)) for n in (5, 24, 30)]
    texts = [r.choice(["", " ", "x\t"]) + r.choice([" ", "\n ", " q "]).join(r.choice([*parts, f"w{i}"]) for i in range(r.randrange(9))) for _ in range(40)] + [None, "", parts[1], parts[1]]
    cut = [(t or "").split() for t in texts]
    seen = Counter(tuple(t[i : i + words]) for t in cut for i in range(len(t) - words + 1))
    want = []
    for t in cut:
        hit = sorted({p for i in range(len(t) - words + 1) if seen[tuple(t[i : i + words])] > 1 for p in range(i, i + words)})
        # maximal runs: windows that touch are one
        runs = suffixes.merge_spans((i, i + words) for i in range(len(t) - words + 1) if seen[tuple(t[i : i + words])] > 1)
        assert sorted(p for s, e in runs for p in range(s, e)) == hit
        want.append([t[s:e] for s, e in runs])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x.id: [(texts[x.id] or "").encode()[p.start : p.end].decode().split() for p in x.passages] for x in suffixes.repeated_bytes(docs, words=words).collect()}
    assert [got[i] for i in range(len(texts))] == want and any(want)


def test_pipeline_cuts_passages_of_51_words(spark, sf_dir):
    import corpus_pipeline as cp

    passage, short = " ".join(f"it{i}s" for i in range(51)), " ".join(f"no{i}t" for i in range(50))
    own = lambda d: " ".join(f"own{d}word{i}" for i in range(60))
    texts = [f"{own(2 * d)} {passage} {own(2 * d + 1)} {short}" for d in range(2)]
    assert len(passage) < suffixes.LENGTH
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for r in cp.cut_repeats(spark, docs, sf_dir).collect():
        assert r.text.split() == texts[r.doc_id].replace(passage, "").split() and r.n_chars == len(r.text)
