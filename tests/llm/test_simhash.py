import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from moraine.llm import catalog, simhash


def plain(text, words=3):
    tokens = [t for t in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if t]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, d):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= d) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(ids[i])
    return {x: min(v) for v in groups.values() for x in v}


def test_fingerprints(spark):
    for text in ("", None, "one", "one two", "A b  C\td e f g", "é É x y z", "\x1f\x20a\x0bb c d"):
        assert simhash.fingerprint(text) == plain(text)
    # the same hash as Spark's
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole == plain(text)


def test_query_against_brute_force(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents").collect()
    fps = np.array([plain(d.text) for d in docs], np.uint64)
    want = components([d.doc_id for d in docs], fps, 2)
    got = catalog.op3_simhash_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {d.doc_id: f"{f:016x}" for d, f in zip(docs, fps.tolist())}


@pytest.mark.parametrize("d, hot, chunk", [(2, 64, 1 << 18), (2, 1, 1 << 18), (4, 2, 3), (6, 1, 5)])
def test_links_connect_what_is_close(spark, monkeypatch, d, hot, chunk):
    """Dense clusters around a few centres, chains among them: the same components in hot and other blocks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = np.random.default_rng(d)
    centres = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = []
    for c in centres:
        x = int(c)
        for _ in range(15):
            for b in r.integers(0, 64, int(r.integers(1, d + 3))):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    from moraine.llm._common import Scratch, connected_components

    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    roots = connected_components(simhash.close_links(df, scratch, d, hot), scratch).collect()
    signed = fps.view(np.int64).tolist()
    want = {k: v for k, v in components(signed, fps, d).items() if list(components(signed, fps, d).values()).count(v) > 1}
    assert {x.node: x.root for x in roots} == want


def test_several_seeds(spark, sf_dir):
    """Two texts link if their fingerprints of any seed are close."""
    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(d.doc_id, d.text) for d in docs[:60]] + [(1000 + i, " ".join(words[(j * j + i * (j == 70)) % 8] for j in range(140))) for i in range(8)]
    ids, fps = [r[0] for r in rows], [np.array([simhash.fingerprint(r[1], 5, seed) for r in rows], np.uint64) for seed in (42, 43)]
    label = {i: i for i in ids}
    for f in fps:  # merge to a fixed point
        for _ in range(4):
            for i in range(len(ids)):
                for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 6):
                    a, b = label[ids[i]], label[ids[int(j)]]
                    if a != b:
                        label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.simhash_components(df, words=5, max_distance=6, seeds=(42, 43)).collect()
    assert {r.id: r.component for r in got} == label


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == 11
    empty = [r for r in rows if r.fp == 0]
    assert len(empty) == 4 and {r.component for r in empty} == {2}
    assert {r.component for r in rows if r.id in (4, 5)} == {4}
    alone = [r for r in rows if r.id is None and r.fp != 0]
    assert len(alone) == 1 and alone[0].component is None
    assert simhash.simhash_components(no_docs).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_components(odd_docs, max_distance=9)
