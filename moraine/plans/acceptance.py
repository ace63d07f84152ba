"""The registered queries of the engine's own operators and the SQL that checks them.

They run on the events table read as a mutation log: key floor(event_id / 5) + user_id, a delete where the type is 'error', cut into eight
runs by event_id, the first four at level 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import keys as K
from moraine.operators import compaction, lookup, runs, snapshot
from moraine.options import CODECS
from moraine.plans.picking import Run, pick
from moraine.sources.paths import delete_path, shared_dir

CLUSTER = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    n = events.count()
    k = F.floor(F.col("event_id") / 5.0).cast("bigint") + F.col("user_id")
    gone = F.col("event_type") == "error"
    size = F.length(k.cast("string")) + F.when(gone, 1).otherwise(8)
    seq = 1 + F.floor(F.col("event_id") * 8.0 / n).cast("bigint")
    rows = events.select(F.col("event_id").alias("seq"), k.alias("k"), gone.alias("is_del"), F.when(~gone, F.col("value")).alias("v"), seq.alias("file_seq"), size.alias("sz"))
    return rows.withColumn("level", F.when(F.col("file_seq") <= 4, 1).otherwise(0))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush(mutations(spark, sf_dir), "k").select("level", "file_seq", "k", "is_del", "v", "sz")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.describe(entries(spark, sf_dir), "k", "is_del", "sz")


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as a table of records: it is metadata, one row a run, which readers hold."""
    rows = manifest(spark, sf_dir)
    return spark.createDataFrame(rows.collect(), rows.schema)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that a major compaction of level 0 takes."""
    return _chosen(spark, run_records(spark, sf_dir))


def _chosen(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Chosen on the driver, from one record a run."""
    rows = records.select("file_seq", "level", "lo", "hi").collect()
    got = pick([Run(**r.asDict()) for r in rows], 0)
    return spark.createDataFrame([(r.file_seq,) for r in got], "file_seq bigint")


def latest_snapshot(spark, sf_dir):
    return snapshot.latest(mutations(spark, sf_dir), "k", "seq", "is_del").select("k", "v")


def run_merge(spark, sf_dir):
    return snapshot.merge_runs(entries(spark, sf_dir), "k").where("NOT is_del").select("k", "v")


def log_replay(spark, sf_dir):
    """The log read twice over, from its operation codes: replay changes nothing."""
    log = mutations(spark, sf_dir).select("seq", "k", "v", K.operation(F.col("is_del")).alias("op"))
    twice = log.unionByName(log).withColumn("is_del", K.is_delete(F.col("op")))
    return snapshot.latest(twice, "k", "seq", "is_del").select("k", "v")


def flush_runs(spark, sf_dir):
    return entries(spark, sf_dir).select("file_seq", "k", "v", "is_del")


def run_order_check(spark, sf_dir):
    return runs.order_violations(entries(spark, sf_dir), "k")


def run_scan(spark, sf_dir):
    return entries(spark, sf_dir).where("file_seq = 5").select("k", "v", "is_del")


def run_manifest(spark, sf_dir):
    return manifest(spark, sf_dir)


def _index(spark, sf_dir):
    return runs.sparse_index(entries(spark, sf_dir), CLUSTER, "k")


def sparse_index(spark, sf_dir):
    return _index(spark, sf_dir)


def cluster_locate(spark, sf_dir):
    return lookup.locate_cluster(probes(spark, sf_dir), _index(spark, sf_dir), run_records(spark, sf_dir), "k")


def cluster_lcp(spark, sf_dir):
    text = entries(spark, sf_dir).withColumn("t", F.lpad(F.col("k").cast("string"), 10, "0"))
    index = runs.sparse_index(text, CLUSTER, "t")
    return runs.cluster_prefix(index).select("file_seq", "cluster_id", "lcp")


def multi_get(spark, sf_dir):
    return lookup.multi_get(probes(spark, sf_dir), snapshot.merge_runs(entries(spark, sf_dir), "k"), "k", "is_del", "v")


def search_stats(spark, sf_dir):
    return lookup.hit_counts(lookup.multi_get(probes(spark, sf_dir), snapshot.merge_runs(entries(spark, sf_dir), "k"), "k", "is_del", "v"))


def range_prune(spark, sf_dir):
    return lookup.candidate_runs(probes(spark, sf_dir), run_records(spark, sf_dir).select("file_seq", "lo", "hi"), "k").groupBy("k").agg(F.count("*").alias("candidates"))


def seek_histogram(spark, sf_dir):
    return lookup.seek_histogram(lookup.seeks(probes(spark, sf_dir), entries(spark, sf_dir), run_records(spark, sf_dir), "k"))


def derived_stats(spark, sf_dir):
    """All lookups of the probes, and the hits that opened no run."""
    found, opened = search_stats(spark, sf_dir), seek_histogram(spark, sf_dir)
    hist = opened.agg(F.map_from_entries(F.collect_list(F.struct("seeks", "n"))).alias("hist"))  # an entry for each number of seeks: the number of runs at most
    return lookup.derived_stats(found.join(hist))


def runs_with_key(spark, sf_dir):
    return lookup.runs_with_key(probes(spark, sf_dir), entries(spark, sf_dir), "k")


def overlap_pairs(spark, sf_dir):
    return compaction.overlap_pairs(run_records(spark, sf_dir))


def compaction_trigger(spark, sf_dir):
    return compaction.triggers(manifest(spark, sf_dir))


def level_capacity(spark, sf_dir):
    return spark.range(5).select(F.col("id").cast("int").alias("level"), compaction.level_capacity(F.col("id")).alias("capacity"))


def compaction_pick(spark, sf_dir):
    return chosen(spark, sf_dir)


def compact_gc(spark, sf_dir):
    return compaction.merge_chosen(entries(spark, sf_dir), chosen(spark, sf_dir), "k", deleted="is_del").select("k", "v", "is_del")


def manifest_swap(spark, sf_dir):
    """The manifest after that compaction, whose output is one run of level 1."""
    before = run_records(spark, sf_dir)
    gone = _chosen(spark, before)
    merged = compaction.merge_chosen(entries(spark, sf_dir), gone, "k", deleted="is_del")
    number = F.broadcast(runs.next_file_seq(before).withColumnRenamed("next_seq", "file_seq"))
    added = runs.describe(merged.drop("level", "file_seq").join(number).withColumn("level", F.lit(1)), "k", "is_del", "sz")
    return compaction.swap(before, gone, added).select("level", "file_seq", "n_entries", "n_del", "lo", "hi", "bytes")


def combined_range(spark, sf_dir):
    return runs.combined_range(manifest(spark, sf_dir))


def next_file_seq(spark, sf_dir):
    return runs.next_file_seq(manifest(spark, sf_dir))


def avg_entries(spark, sf_dir):
    return runs.average_entries(manifest(spark, sf_dir))


def memtable_bytes(spark, sf_dir):
    return snapshot.memtable_bytes(mutations(spark, sf_dir), "k", "seq", "sz").select("seq", "mem_bytes")


def unit_size(spark, sf_dir):
    m = mutations(spark, sf_dir)
    key, value = F.encode(F.col("k").cast("string"), "UTF-8"), F.when(F.col("v").isNotNull(), K.long_to_bytes(F.lit(0)))
    return m.select("seq", K.unit_size(key, value, F.col("is_del")).alias("sz"))


def signed_order(spark, sf_dir):
    """Distinct texts, whole, and their rank in signed byte order."""
    texts = _table(spark, sf_dir, "conversations").select("text").where("text IS NOT NULL").distinct()
    ranked = runs.rank_all(texts.withColumn("okey", K.order_key(F.encode("text", "UTF-8"))), "okey", "rank")
    return ranked.select("text", "rank")


def level_check(spark, sf_dir):
    """Levels of the runs that the compaction takes, and how many of them there are."""
    records = run_records(spark, sf_dir)
    return compaction.mixed_levels(records, _chosen(spark, records))


def split_files(spark, sf_dir):
    """The files of 4,000 unit bytes that a size-bounded writer makes of each run."""
    cut = compaction.split_files(entries(spark, sf_dir), 4_000, "k", "sz")
    return cut.groupBy("file_seq", "file").agg(F.count("*").alias("n_entries"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("sz").cast("bigint").alias("bytes"))


def file_name_parse(spark, sf_dir):
    """Names made of the manifest, and an unfinished file's, taken apart again."""
    named = manifest(spark, sf_dir).select(K.run_name(F.col("level"), F.col("file_seq")).alias("name"))
    names = named.unionByName(named.select(F.concat(F.lit("Level_0_UNFINISHED_"), "name").alias("name")))
    level, seq = K.run_name_parts(F.col("name"))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return names.select("name", shown(level).alias("level"), shown(seq).alias("file_seq"))


def codec_roundtrip(spark, sf_dir):
    """Entries and a checksum of them, as reread from each codec."""
    source, root, out = entries(spark, sf_dir), f"{shared_dir(spark)}/codecs-{uuid.uuid4().hex}", None
    for name, codec in CODECS.items():
        source.write.option("compression", codec).parquet(f"{root}/{name}")
        back = spark.read.schema(source.schema).parquet(f"{root}/{name}")
        row = back.agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.count_if("is_del").alias("n_del"), F.bit_xor(F.xxhash64("file_seq", "k", "v", "is_del")).alias("digest")).first()
        got = spark.createDataFrame([(name, *row)], "codec string, n bigint, sum_k bigint, n_del bigint, digest bigint")
        out = got if out is None else out.unionByName(got)
    delete_path(spark, root)
    return out


_NAMES = """latest_snapshot run_merge log_replay flush_runs run_order_check run_scan run_manifest sparse_index cluster_locate cluster_lcp multi_get
search_stats range_prune seek_histogram derived_stats runs_with_key overlap_pairs compaction_trigger level_capacity compaction_pick compact_gc manifest_swap
combined_range next_file_seq avg_entries memtable_bytes unit_size signed_order file_name_parse codec_roundtrip level_check split_files""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES}


_LOG = """WITH RECURSIVE n AS (SELECT COUNT(*) AS n FROM events),
m AS (SELECT event_id AS seq, CAST(FLOOR(event_id/5.0) AS BIGINT)+user_id AS k, event_type='error' AS is_del,
  CASE WHEN event_type='error' THEN NULL ELSE value END AS v, 1+CAST(FLOOR(event_id*8.0/n.n) AS BIGINT) AS file_seq,
  LENGTH(CAST(CAST(FLOOR(event_id/5.0) AS BIGINT)+user_id AS VARCHAR))+CASE WHEN event_type='error' THEN 1 ELSE 8 END AS sz
  FROM events CROSS JOIN n),
r AS (SELECT CASE WHEN file_seq<=4 THEN 1 ELSE 0 END AS level, file_seq, k, is_del, v, sz
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_seq, k ORDER BY seq DESC) AS rn FROM m) WHERE rn=1),
man AS (SELECT level, file_seq, COUNT(*) AS n_entries, CAST(SUM(CASE WHEN is_del THEN 1 ELSE 0 END) AS BIGINT) AS n_del, MIN(k) AS lo, MAX(k) AS hi,
  CAST(SUM(sz) AS BIGINT) AS bytes FROM r GROUP BY level, file_seq),
ix AS (SELECT file_seq, cluster_id, MIN(k) AS first_key, MAX(k) AS last_key, COUNT(*) AS n FROM (SELECT file_seq, k,
  CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY file_seq ORDER BY k)-1)/10.0) AS BIGINT) AS cluster_id FROM r) GROUP BY 1, 2),
top AS (SELECT k, v, is_del FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY k ORDER BY level, file_seq DESC) AS rn FROM r) WHERE rn=1),
q AS (SELECT DISTINCT o_custkey AS k FROM orders),
seed AS (SELECT lo, hi FROM man WHERE level=0 AND file_seq=(SELECT MIN(file_seq) FROM man WHERE level=0)),
cl AS (SELECT c.file_seq, c.lo, c.hi FROM man c, seed WHERE c.level=0 AND c.lo<=seed.hi AND c.hi>=seed.lo
  UNION SELECT o.file_seq, o.lo, o.hi FROM cl JOIN man o ON o.level=0 AND o.file_seq<cl.file_seq AND o.lo<=cl.hi AND o.hi>=cl.lo),
nx AS (SELECT c.file_seq FROM man c, seed WHERE c.level=1 AND seed.lo<=c.hi AND seed.hi>=c.lo
  AND NOT EXISTS (SELECT 1 FROM man z WHERE z.level=1 AND z.file_seq>c.file_seq AND z.lo<=c.hi AND z.hi>=c.lo)),
sel AS (SELECT file_seq FROM cl UNION SELECT file_seq FROM nx),
gc AS (SELECT k, v, is_del, sz FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY k ORDER BY level, file_seq DESC) AS rn FROM r WHERE file_seq IN (SELECT file_seq FROM sel)) c
  WHERE rn=1 AND NOT (is_del AND NOT EXISTS (SELECT 1 FROM r o WHERE o.k=c.k AND o.file_seq NOT IN (SELECT file_seq FROM sel))))
"""

_LIVE = "SELECT k, v FROM (SELECT x.*, ROW_NUMBER() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {} x) WHERE rn=1 AND NOT is_del"
_SQL = {
    "latest_snapshot": _LIVE.format("m"),
    "run_merge": "SELECT k, v FROM top WHERE NOT is_del",
    "log_replay": _LIVE.format("(SELECT seq, k, v, CASE op WHEN 'D' THEN TRUE WHEN 'W' THEN FALSE END AS is_del FROM (SELECT *, CASE WHEN is_del THEN 'D' ELSE 'W' END AS op FROM (SELECT * FROM m UNION ALL SELECT * FROM m)))"),
    "flush_runs": "SELECT file_seq, k, v, is_del FROM r",
    "run_order_check": "SELECT COUNT(*) AS violations FROM (SELECT k, LAG(k) OVER (PARTITION BY file_seq ORDER BY k) AS p FROM r) WHERE p>=k",
    "run_scan": "SELECT k, v, is_del FROM r WHERE file_seq=5",
    "run_manifest": "SELECT * FROM man",
    "sparse_index": "SELECT * FROM ix",
    "cluster_locate": "SELECT q.k, ix.file_seq, MAX(ix.cluster_id) AS cluster_id FROM q JOIN ix ON ix.first_key<=q.k GROUP BY 1, 2",
    "cluster_lcp": "SELECT file_seq, cluster_id, (SELECT MAX(CAST(i AS BIGINT)) FROM range(0, 11) t(i) WHERE LEFT(LPAD(CAST(first_key AS VARCHAR), 10, '0'), CAST(i AS INT))=LEFT(LPAD(CAST(last_key AS VARCHAR), 10, '0'), CAST(i AS INT))) AS lcp FROM ix",
    "multi_get": "SELECT g.k, t.k IS NOT NULL AS found, CASE WHEN t.is_del THEN NULL ELSE t.v END AS v FROM q g LEFT JOIN top t ON t.k=g.k",
    "search_stats": "SELECT COUNT(t.k) AS ok, COUNT(*)-COUNT(t.k) AS miss FROM q LEFT JOIN top t ON t.k=q.k",
    "range_prune": "SELECT q.k, COUNT(*) AS candidates FROM q JOIN man ON q.k BETWEEN lo AND hi GROUP BY q.k",
    "seek_histogram": "SELECT seeks, COUNT(*) AS n FROM (SELECT c.k, MIN(c.seeks) AS seeks FROM (SELECT q.k, file_seq, ROW_NUMBER() OVER (PARTITION BY q.k ORDER BY level, file_seq DESC) AS seeks FROM q JOIN man ON q.k BETWEEN lo AND hi) c JOIN r ON r.k=c.k AND r.file_seq=c.file_seq GROUP BY c.k) GROUP BY seeks",
    "derived_stats": "SELECT ok+miss AS total, ok-opened AS from_cache FROM (SELECT COUNT(t.k) AS ok, COUNT(*)-COUNT(t.k) AS miss FROM q LEFT JOIN top t ON t.k=q.k), (SELECT COUNT(DISTINCT q.k) AS opened FROM q JOIN r ON r.k=q.k)",
    "runs_with_key": "SELECT q.k, r.file_seq FROM q JOIN r ON r.k=q.k WHERE r.level>=0",
    "overlap_pairs": "SELECT a.file_seq AS a, b.file_seq AS b, a.lo<=b.lo AND a.hi>=b.hi AS a_contains_b FROM man a JOIN man b ON a.file_seq<b.file_seq AND a.lo<=b.hi AND a.hi>=b.lo",
    "compaction_trigger": "SELECT level, n_runs, capacity, n_runs>capacity AS due FROM (SELECT level, COUNT(*) AS n_runs, CAST(FLOOR(POWER(10, level+1)/(3*(level+1))) AS BIGINT) AS capacity FROM man GROUP BY level)",
    "level_capacity": "SELECT CAST(i AS INT) AS level, CAST(FLOOR(POWER(10, i+1)/(3*(i+1))) AS BIGINT) AS capacity FROM range(0, 5) t(i)",
    "compaction_pick": "SELECT file_seq FROM sel",
    "compact_gc": "SELECT k, v, is_del FROM gc",
    "manifest_swap": "SELECT level, file_seq, n_entries, n_del, lo, hi, bytes FROM man WHERE file_seq NOT IN (SELECT file_seq FROM sel) UNION ALL SELECT 1, (SELECT MAX(file_seq)+1 FROM man), COUNT(*), CAST(SUM(CASE WHEN is_del THEN 1 ELSE 0 END) AS BIGINT), MIN(k), MAX(k), CAST(SUM(sz) AS BIGINT) FROM gc",
    "combined_range": "SELECT level, MIN(lo) AS lo, MAX(hi) AS hi FROM man GROUP BY level",
    "next_file_seq": "SELECT COALESCE(MAX(file_seq), 0)+1 AS next_seq FROM man",
    "avg_entries": "SELECT level, CAST(FLOOR(AVG(n_entries)) AS BIGINT) AS avg_entries FROM man GROUP BY level",
    "memtable_bytes": "SELECT seq, CAST(SUM(d) OVER (ORDER BY seq) AS BIGINT) AS mem_bytes FROM (SELECT seq, sz-COALESCE(LAG(sz) OVER (PARTITION BY k ORDER BY seq), 0) AS d FROM m)",
    "unit_size": "SELECT seq, sz FROM m",
    "signed_order": "SELECT text, ROW_NUMBER() OVER (ORDER BY [(b+128)%256 FOR b IN [('0x' || hex(encode(text))[2*i-1:2*i])::INT FOR i IN range(1, octet_length(encode(text))+1)]]) AS rank FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL)",
    "level_check": "SELECT COUNT(DISTINCT level) AS levels, COUNT(*) AS known FROM man WHERE file_seq IN (SELECT file_seq FROM sel)",
    "split_files": "SELECT file_seq, file, COUNT(*) AS n_entries, MIN(k) AS lo, MAX(k) AS hi, CAST(SUM(sz) AS BIGINT) AS bytes FROM (SELECT *, CAST(FLOOR(COALESCE(SUM(sz) OVER (PARTITION BY file_seq ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/4000.0) AS BIGINT) AS file FROM r) GROUP BY file_seq, file",
    "file_name_parse": "SELECT name, regexp_extract(name, '^SST_([0-9]+)_([0-9]+)[.]sst$', 1) AS level, regexp_extract(name, '^SST_([0-9]+)_([0-9]+)[.]sst$', 2) AS file_seq FROM (SELECT 'SST_' || level || '_' || file_seq || '.sst' AS name FROM man UNION ALL SELECT 'Level_0_UNFINISHED_SST_' || level || '_' || file_seq || '.sst' FROM man)",
}


def oracle_sql() -> dict[str, str]:
    return {name: _LOG + body for name, body in _SQL.items()}
