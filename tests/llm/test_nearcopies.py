"""Wide SimHash near-dedup: the pipeline stage against brute force."""

import random

import numpy as np
import pytest

from moraine.llm import nearcopies
from moraine.llm.suffixes import Hasher


def similar_pairs(texts):
    """Pairs (i, j) of similarity 0.8 or more, by comparing all sets."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if 5 * (n := len(sets[i] & sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - n)]


def classes(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def texts_of(seed, changes=5, copies=14):
    """Copies with a few words changed, dense groups and chains of them, passages that many texts share, short and empty texts."""
    r = random.Random(seed)
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, shared = [], new(40)
    for base in [new(n) for n in (3, 20, 60, 120, 120, 400)] + [shared + new(n) for n in (20, 60, 90)]:
        for n in range(copies):
            words = list(base)
            for _ in range(r.randrange(changes)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(words))
            if n % 5 == 0:
                base = words  # a chain
    return [*rows, *(" ".join(shared + new(12)) for _ in range(30)), rows[20], rows[20].upper(), None, "", " "]


@pytest.mark.parametrize("hot, chunk", [(8, 1 << 13), (1, 5)])
def test_stage_against_brute_force(spark, sf_dir, monkeypatch, hot, chunk):
    """All similar pairs that share a key are linked, and nothing is linked below the bound."""
    import corpus_pipeline as cp

    for name, value in (("HOT", hot), ("CHUNK", chunk)):
        monkeypatch.setattr(nearcopies, name, value)
    texts = texts_of(5)
    prints = np.array([nearcopies.fingerprint(runs) for _, runs in nearcopies.features(texts, 5, Hasher())])
    keys = nearcopies.block_keys(prints)
    pairs = similar_pairs(texts)
    found = [(i, j) for i, j in pairs if (keys[i] == keys[j]).any()]
    least, most = classes(len(texts), found), classes(len(texts), pairs)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, _one string, _two bigint")
    out = cp.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    kept = {x.doc_id for x in out.collect()}
    assert kept <= set(least) and set(most) <= kept
    assert len(kept) < len(texts) - 40


def test_recall_of_similar_pairs():
    """Of pairs of similarity 0.8 or more nine in ten share a key at least, and all of those are within FAR bits."""
    texts = texts_of(11, changes=8, copies=60)
    prints = np.array([nearcopies.fingerprint(runs) for _, runs in nearcopies.features(texts, 5, Hasher())])
    keys = nearcopies.block_keys(prints)
    pairs = similar_pairs(texts)
    hit = [(keys[i] == keys[j]).any() for i, j in pairs]
    far = [int(np.bitwise_count(prints[i] ^ prints[j]).sum()) for i, j in pairs]
    assert len(pairs) > 300 and np.mean(hit) >= 0.9 and max(far) <= nearcopies.FAR


def test_pigeonhole():
    """Any pair within BLOCKS - 2 bits shares a key."""
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, (200, nearcopies.LANES), dtype=np.uint64)
    bits = np.unpackbits(a.view(np.uint8), axis=1)
    for row in bits:
        row[r.choice(nearcopies.BITS, nearcopies.BLOCKS - 2, replace=False)] ^= 1
    b = np.packbits(bits, axis=1).view(np.uint64)
    assert (nearcopies.block_keys(a) == nearcopies.block_keys(np.ascontiguousarray(b))).any(axis=1).all()


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    import corpus_pipeline as cp

    out = cp.drop_near_copies(spark, odd_docs, sf_dir)
    # one of the texts without words, one of the repeated row, one of the long copies
    assert out.columns == odd_docs.columns and out.count() == 6
    assert cp.drop_near_copies(spark, no_docs, sf_dir).count() == 0
