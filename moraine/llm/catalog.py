"""The registered queries of the training-data operators, each over its whole table with production parameters, and SQL where
SQL can express them.  A query derives the digest columns from its operator's real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import decontaminate, langid, licenses, mixing, ogg, simhash, suffixes, toxicity, urlfilter, warc

#: fixed values: the rules of the url contract, (host, path, action)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: words of a repeated passage that op1 tells beside its byte strings
PASSAGE = 51


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of each document as 400-byte strings that stand elsewhere too; n_passages is the number of its passages of over 50 words, of
    any bytes, that stand elsewhere too.  Null and empty texts have 0 bytes and lose none; rows with equal ids or texts are separate documents."""
    out = suffixes.repeated_bytes(table(spark, sf_dir, "documents"), words=PASSAGE)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", F.size("passages").cast("bigint").alias("n_passages"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, encode(coalesce(text, '')) AS h FROM documents),
w AS MATERIALIZED (SELECT rid, s, md5(h[s+1:s+400]) AS k FROM (SELECT rid, h, unnest(range(0, octet_length(h) - 399)) AS s FROM d WHERE octet_length(h) >= 400)),
r AS (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT rid, s, sum(CASE WHEN s - p <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS g FROM r),
sp AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM (SELECT rid, min(s) AS a, max(s) + 400 AS b FROM g GROUP BY rid, g)),
cut AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(hex(h[before+1:a]), '' ORDER BY a) AS kept, max(b) AS tail FROM sp JOIN d USING (rid) GROUP BY rid),
t AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
v AS MATERIALIZED (SELECT rid, s, md5(array_to_string(w[s:s+50], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 49)) AS s FROM t WHERE len(w) >= 51)),
q AS (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS p FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1)),
n AS (SELECT rid, count(*) FILTER (p IS NULL OR s - p > 51) AS n_passages FROM q GROUP BY rid)
SELECT doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(coalesce(unhex(kept || hex(h[tail+1:])), h)) AS kept_sha256, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages
FROM d LEFT JOIN cut USING (rid) LEFT JOIN n USING (rid)
"""


def held_out(id_col):
    """Rows whose crc32(id as text) mod 5 is 0.  A null id has no remainder: it is held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out.  Null texts and texts without letters are ``und`` with score 0; ties go
    to the language that sorts first; rows with equal ids are judged each by its own text; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs.where(~held_out("doc_id"))), spans=False)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), F.col("lang").alias("lang_pred"), "score", "n_words")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, learned from the labels of rows that aren't held out.  Null and empty texts get the model's base score; a text with both
    labels counts for each; without labels all score near 0; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~held_out("doc_id")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.  Null and empty texts have fingerprint zero and link like any other; a component's id is its smallest id
    that isn't null; repeated rows stay repeated; an empty table gives no rows."""
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows.  Null and empty texts have no words and no hits; items without words have no windows, items with one id
    count once, a null id is the empty string; an empty benchmark leaves all documents clean."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(w[s:s+9], ' ') AS run, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
m AS (SELECT rid, s, n, item FROM (SELECT rid, s, n, array_to_string(w[s:s+n-1], ' ') AS run FROM dw) x JOIN iw USING (run, n)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Ogg, read back and described.  Null is the empty text, one block of zeros; equal texts have equal values; repeated rows stay; an empty
    table gives no rows."""
    return ogg.media_columns(table(spark, sf_dir, "documents"), keep_media=False).withColumnRenamed("id", "doc_id")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a response and a later revisit record, which is parsed and resolved.  Null urls are empty ones (``no-url``), null pages empty bodies, null
    ids stay null; pages with equal ids are captured each; an empty table gives no rows."""
    records = warc.parse_warc(warc.capture_pages(table(spark, sf_dir, "pages")))
    out = warc.resolve_revisits(records)
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit("="), e.value))), "\n")
    page = F.split("record_id", ":")[2].try_cast("bigint")
    return out.select(page.alias("page_id"), "record_id", "canonical", "outcome", "response_id", "digest", "body_bytes", F.sha2(headers.cast("binary"), 256).alias("headers_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix to target weights takes of every document.  Null and empty texts have size 0 and nothing is taken; a null source is the last source; ties are
    broken by hashes of id and text, repeated rows are mixed each; an empty table gives no rows."""
    return mixing.mix_to_weights(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(URL_RULES, "host string, path string, action string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url.  Null urls and urls without ``://`` have empty host and path, no rule and verdict allow; of rules of equal
    length the one with the longer host wins, then block; repeated rows stay; an empty table gives no rows."""
    out = urlfilter.judge_urls(table(spark, sf_dir, "pages"), url_rules(spark))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP8_SQL = """
WITH rules(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
p AS (SELECT page_id, rid, translate(regexp_extract(tail, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.*, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
      FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document.  Null and empty texts have no words and no places, empty labels and score 0; repeated rows stay; an empty
    table gives no rows."""
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.is_base)
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    starts = F.transform(base, lambda s: s.first)
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), score.alias("score"))


def _templates_sql() -> str:
    """The templates as rows of (id, label, base, k, words)."""
    return ", ".join(f"({i}, '{label}', {base}, {k}, string_split('{' '.join(w)}', ' '))" for i, label, base, k, w in licenses.template_rows())


OP9_SQL = (
    r"""
WITH t(id, label, base, k, tw) AS (VALUES """
    + _templates_sql()
    + r"""),
tg AS (SELECT id, k, i - 1 AS t, array_to_string(tw[i:i+k-1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(tw) - k + 2)) AS i FROM t)),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT rid, k, i - 1 AS p, array_to_string(w[i:i+k-1], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (2), (4)) x(k) WHERE len(w) >= k)),
h AS (SELECT rid, id, p, t, p - t AS diag, base, label, tg.k, len(tw) AS size FROM dg JOIN tg USING (k, gram) JOIN t USING (id)),
ph AS (SELECT rid, label, diag AS first FROM h WHERE base GROUP BY rid, id, label, size, k, diag HAVING count(*) = size - k + 1),
dg2 AS (SELECT rid, id, label, size, k, diag, list(t) AS ts FROM h WHERE NOT base GROUP BY rid, id, label, size, k, diag),
br AS (SELECT *, CASE WHEN diag - lag(diag) OVER o > 3 THEN 1 ELSE 0 END AS broken FROM dg2 WINDOW o AS (PARTITION BY rid, id ORDER BY diag)),
sp AS (SELECT *, sum(broken) OVER (PARTITION BY rid, id ORDER BY diag ROWS UNBOUNDED PRECEDING) AS span FROM br),
nt AS (SELECT rid, label, count(DISTINCT c) / size AS share FROM (SELECT rid, id, label, size, span, unnest(range(t, t + k)) AS c FROM (SELECT *, unnest(ts) AS t FROM sp)) GROUP BY rid, id, label, size, span HAVING count(DISTINCT c) / size >= 0.6),
al AS (SELECT rid, label, 1.0::DOUBLE AS share FROM ph UNION ALL SELECT rid, label, share FROM nt),
b AS (SELECT rid, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ph GROUP BY rid),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM al GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_simhash_near_dedup, op4_decontaminate, op5_ogg_media, op6_warc_revisits, op7_mixing, op8_url_filter, op9_license_scan, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op4_decontaminate": OP4_SQL, "op8_url_filter": OP8_SQL, "op9_license_scan": OP9_SQL}
