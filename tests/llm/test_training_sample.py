"""The training sample with very long texts."""

from moraine.llm import sampling


def test_long_texts_do_not_end_the_sample(spark):
    rows = [(1, "a", 500), (2, "a", 30), (3, "a", 60), (4, "a", 25), (5, "a", 5), (1, "b", 900), (2, "b", 800), (1, "c", 900), (2, "c", 10), (9, "c", 20)]
    df = spark.createDataFrame(rows, "h bigint, label string, size int")
    assert sorted(sampling.choose(df, 3, 300)) == [(2, "a"), (2, "b"), (2, "c"), (3, "a"), (9, "c")]
    assert sorted(sampling.choose(df, 1, 300)) == [(2, "a"), (2, "b"), (2, "c")]
    assert sampling.choose(df.where("false"), 3, 300) == []


def test_a_large_class_is_ranked_below_a_bound(spark):
    import random

    r = random.Random(3)
    rows = [(r.randrange(-(1 << 63), 1 << 63), "a", 1) for _ in range(3000)] + [(r.randrange(-(1 << 63), 1 << 63), "b", 1) for _ in range(20)]
    # hashes that aren't even at all: too few stay under the bound
    rows += [((1 << 62) + i, "c", 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "h bigint, label string, size int")
    want = sorted((h, c) for c in "abc" for h in sorted(h for h, label, _ in rows if label == c)[:50])
    assert sorted(sampling.choose(df, 50, 10**6)) == want
