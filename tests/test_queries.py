"""Every registered query of the engine against DuckDB, and the plans of the main ones."""

import pytest

from oracles import duck, same_rows
from moraine.plans import acceptance

SQL = acceptance.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    same_rows(acceptance.queries()[name](spark, sf_dir), con, SQL[name])


def test_codecs_agree(spark, sf_dir):
    rows = acceptance.codec_roundtrip(spark, sf_dir).collect()
    assert len(rows) == 4 and len({r[1:] for r in rows}) == 1


def test_merge_on_read_equals_log(spark, sf_dir):
    a, b = acceptance.latest_snapshot(spark, sf_dir), acceptance.run_merge(spark, sf_dir)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_entry_works_without_optional_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 157
    assert set(acceptance.queries()) <= set(e.queries())


def test_ranking_is_limited_before_the_shuffle(spark, sf_dir):
    plan = acceptance.latest_snapshot(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert plan.count("Exchange") <= 2
    assert "props" not in plan  # columns that aren't needed aren't read


def test_entry_without_what_the_optional_parts_need(spark, monkeypatch):
    """A module that the optional parts import is missing: the other queries are there all the same."""
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("moraine.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    assert set(e.queries()) == set(acceptance.queries()) and set(e.oracle_sql()) == set(SQL)


def test_large_manifests_are_not_broadcast(spark, monkeypatch):
    """Range joins with a manifest beyond the bound give the same rows without a nested loop."""
    from moraine.operators import compaction, lookup

    r = __import__("random").Random(4)
    runs = [(i, i % 3, lo, lo + r.randrange(40)) for i, lo in enumerate(r.randrange(5000) for _ in range(3000))]
    manifest = spark.createDataFrame(runs, "file_seq bigint, level int, lo bigint, hi bigint")
    keys = spark.range(-5, 5100, 7).withColumnRenamed("id", "k")
    want = sorted((k.k, x[0]) for k in keys.collect() for x in runs if x[2] <= k.k <= x[3])
    pairs = sorted((a[0], b[0], a[2] <= b[2] and a[3] >= b[3]) for i, a in enumerate(runs) for b in runs[i + 1 :] if a[2] <= b[3] and a[3] >= b[2])
    for bound in (lookup.BROADCAST, 10):
        monkeypatch.setattr(lookup, "BROADCAST", bound)
        met = lookup.candidate_runs(keys, manifest.select("file_seq", "lo", "hi"), "k")
        assert ("NestedLoop" in met._jdf.queryExecution().executedPlan().toString()) == (bound > 10)
        assert sorted((x.k, x.file_seq) for x in met.collect()) == want
        assert sorted(tuple(x) for x in compaction.overlap_pairs(manifest).collect()) == pairs
        below = lookup.candidate_runs(keys.limit(40), manifest.select("file_seq", "lo"), "k", upper=False)
        assert below.count() == sum(x[2] <= k.k for k in keys.limit(40).collect() for x in runs)


def test_a_temporary_checkpoint_folder_is_for_one_machine(spark, monkeypatch):
    from moraine.sources import paths

    class Context:
        master = "yarn"
        _jsc = spark.sparkContext._jsc

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext, conf = Context, {}

    monkeypatch.setattr(type(spark.sparkContext._jsc.sc().getCheckpointDir()), "isDefined", lambda self: False, raising=False)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        paths.shared_dir(Session)
