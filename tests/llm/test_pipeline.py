"""The pipeline as a whole: on sf0.001, on empty tables, on odd rows with clashing columns."""

import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes the tables that the pipeline reads, and gives their folder."""

    def write(docs, labels=(), benchmark=()):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(benchmark), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_runs_over_the_tables(spark, sf_dir):
    import corpus_pipeline as cp
    from moraine.llm.catalog import table

    docs = table(spark, sf_dir, "documents")
    out = cp.run(spark, sf_dir)
    ids = [r.doc_id for r in out.collect()]
    assert 0 < len(ids) < docs.count() and len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.collect()}


def test_empty_tables(spark, tables, no_docs):
    import corpus_pipeline as cp

    assert cp.run(spark, tables(no_docs)).count() == 0


def test_stages_keep_odd_rows_and_clashing_columns(spark, tables, odd_docs):
    import corpus_pipeline as cp

    clash = {"_one": "a", "_two": "b", "_bad_key": "c", "row": "d", "node": "e", "root": "f", "passages": "g", "shingles": "h"}
    from pyspark.sql import functions as F

    docs = odd_docs.withColumns({k: F.lit(v) for k, v in clash.items()})
    passage = "one two three four five six seven eight nine ten"
    sf_dir = tables(docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(77).cast("bigint"), "text": F.lit(f"x {passage} y")})), [(1, 1, 0), (None, None, None)], [(1, passage), (2, None), (None, "")])
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = kept.columns, kept.count()
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == columns, name
        assert all(r[k] == v for r in kept.collect() for k, v in clash.items()), name
    ids = [r.doc_id for r in kept.collect()]
    # one of the copies, one of the rows without words, and not the contaminated one
    assert len(ids) == before - 6 and 77 not in ids
    assert cp.mix_sources(spark, kept, sf_dir).count() == len(ids)
