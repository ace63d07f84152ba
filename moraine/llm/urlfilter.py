"""URL filters by a sort-merge range join of reversed-host canonical keys.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's.  The canonical key of a host
and path is the host's labels reversed, a slash, and the path; a host can't hold a slash, so the first slash ends it.
Under that key a rule is the interval of keys that start with its own.  A url has one key for each ancestor of its host
(``a.b.com``: com, com.b, com.b.a), so it meets the rules of each.  Rules and keys are dealt by (ancestor host, salt), sorted,
and swept once: the sweep keeps the stack of rules whose interval is open, all nested, and its top is the longest rule
of that host that fits.  The longest rule over the ancestors wins; of equal lengths the one with the longer host, then block.

Only ancestors that have a rule are kept.  One that many urls share is split by salts, one for every ``PER_SALT`` of its urls as counted, and its rules
are repeated for each; equal urls are swept once.

Defined results: a null url, or one without ``://``, has empty host and path and meets no rule; no rule: the verdict is
``default``; rules with a null or empty host, or a null path, are ignored; of rules with the same host and path block wins;
repeated rows stay repeated; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm._common import ascii_lower, small_batches

PER_SALT = 20_000  # urls of an ancestor that are swept together, about


def url_parts(url):
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1"))
    after = F.substring_index(url, "://", 1)
    tail = F.when(rest.isNotNull(), F.substr(url, F.length(after) + 4)).otherwise("")
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def reversed_host(host):
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _sweep(batches):
    """Rows sorted by (ancestor, salt, key, rules first): the longest rule of the ancestor for each url's key."""
    stack: list[tuple] = []  # (key, group, rule, action) of the open rules, each inside the one below it
    for pdf in batches:
        out = []
        for group, salt, key, is_url, url, rule, action, size in zip(pdf.ancestor, pdf.salt, pdf.key, pdf.is_url, pdf.url, pdf.rule, pdf.action, pdf["size"]):
            while stack and (stack[-1][1] != (group, salt) or not key.startswith(stack[-1][0])):
                stack.pop()
            if not is_url:
                if not (stack and stack[-1][0] == key):  # block sorts first among equal rules
                    stack.append((key, (group, salt), rule, action, size))
            elif stack:
                out.append((url, *stack[-1][2:], group.count(".")))
        yield pd.DataFrame(out, columns=["url", "rule", "action", "size", "depth"])


def match_rules(urls: DataFrame, rules: DataFrame, per_salt: int = PER_SALT) -> DataFrame:
    """(url, host, path, rule, action) for each distinct url of column ``url``; rule and action are null where none fits.

    ``rules`` has columns host, path, action (allow or block).
    """
    host, path = url_parts(F.col("url"))
    each = urls.select("url").where("url IS NOT NULL").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split("host", r"\.", -1))
    n = F.size(labels)
    ancestors = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, 1, k), "."))
    none = lambda t: F.lit(None).cast(t)
    rule_host = ascii_lower(F.col("host"))
    usable = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND action IN ('allow', 'block')")
    usable = usable.select(reversed_host(rule_host).alias("ancestor"), F.col("path"), F.concat(rule_host, "path").alias("rule"), "action", F.length(F.concat("host", "path")).alias("size"))
    keys = each.where("host <> ''").select("url", "path", F.explode(ancestors).alias("ancestor")).join(usable.select("ancestor").distinct(), "ancestor", "left_semi")
    salts = keys.groupBy("ancestor").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("url"), F.col("salts")).cast("int")
    keys = keys.join(salts, "ancestor").select("ancestor", salt.alias("salt"), F.concat("ancestor", F.lit("/"), "path").alias("key"), F.lit(True).alias("is_url"), "url", none("string").alias("rule"), none("string").alias("action"), none("int").alias("size"))
    opened = usable.join(salts, "ancestor").select("ancestor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.concat("ancestor", F.lit("/"), "path").alias("key"), F.lit(False).alias("is_url"), none("string").alias("url"), "rule", "action", "size")
    events = keys.unionByName(opened).repartition("ancestor", "salt").sortWithinPartitions("ancestor", "salt", "key", "is_url", F.col("action").desc(), "url")
    hits = events.transform(small_batches).mapInPandas(_sweep, "url string, rule string, action string, size int, depth int")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "action"), F.struct("size", "depth")).alias("best"))
    return each.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", per_salt: int = PER_SALT) -> DataFrame:
    """One row per input row: id, url, host, path, rule, verdict."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    found = match_rules(rows, rules, per_salt).withColumnRenamed("url", "u")
    joined = rows.join(found, F.col("url") == F.col("u"), "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return joined.select("id", "url", empty("host").alias("host"), empty("path").alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
