"""WARC: records in and out, and not-modified revisits resolved to the response they stand for.

A revisit (``WARC-Type: revisit``, profile server-not-modified, HTTP 304) has no body.  It is resolved by an as-of join on the
canonical URL to the latest full response (HTTP 200) captured strictly earlier.  Its validators are checked: an ETag, if the revisit
has one, must equal the response's under weak comparison; else Last-Modified, if it has one, must equal; a revisit with neither can't be
checked.  If they hold, the resolved record is the response with those headers of the 304 merged in that a cache may update
(RFC 9111, 3.2): not the ones that describe the stored body or a hop.

The as-of join needs no task that holds a URL's whole history.  All captures of a URL at one instant become one row first, combined before the
shuffle, with the response that counts as the latest there; time is cut into chunks, the instants of each (url, chunk) are walked by
themselves, and the latest response of earlier chunks comes from one small row for each (url, chunk).  Revisits then meet their instant.

Defined results: of responses at one time the larger record id counts as later, a revisit at that time doesn't see them; a null
or empty URL, or a null time, resolves to nothing (status ``no-url`` or ``no-time``); without an earlier response the status is
``no-response``; differing validators ``mismatch``, none ``unchecked``; repeated rows stay; null ids stay; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm._common import ascii_lower, small_batches

#: fixed values: headers that a 304 may not change in a stored response
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
#: fixed values: query parameters that only track where a visit came from
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid)"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
CHUNK_SECONDS = 86_400
RECORD = "record_id string, type string, url string, time timestamp, status int, headers map<string,string>, digest string, body_bytes bigint"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
SPAN = 8_000_000  # pages whose times differ: beyond it they begin anew
DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?Z)?)?)?")


def canonical_url(url):
    """Scheme and ``www.`` dropped, host lower-cased, default ports, fragment, tracking parameters and a final slash gone."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = ascii_lower(F.regexp_extract(bare, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, rf"(?<=[?&]){TRACKING}=[^&]*(?:&|$)", "")
    return F.concat(host, F.regexp_replace(rest, r"[?&/]+$", ""))


def write_record(record_id: str, kind: str, url: str, time: datetime, status: int, headers: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record with an HTTP message in it."""
    http = f"HTTP/1.1 {status} {'OK' if status == 200 else 'Not Modified'}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode("utf-8", "surrogatepass") + body
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": url, "WARC-Date": time.strftime("%Y-%m-%dT%H:%M:%SZ"), "Content-Type": "application/http; msgtype=response"}
    if kind == "revisit":
        head["WARC-Profile"] = PROFILE
    else:
        head["WARC-Payload-Digest"] = "sha1:" + b32encode(hashlib.sha1(body).digest()).decode()
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes], joined: bool = False) -> dict[str, str]:
    """Header fields by lower-cased name; a line that begins with a blank goes on with the one before; of equal names the last stays, or with
    ``joined`` their values are one list (RFC 9110, 5.3), but for Set-Cookie, whose values hold commas."""
    out, last = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            old = f"{out[last]}, " if joined and last in out and last != "set-cookie" else ""
            out[last] = old + value.strip()
    return out


def warc_date(text: str) -> datetime | None:
    """A WARC-Date: UTC, of any precision from years to fractions of a second, of which microseconds are kept; None if it isn't one."""
    m = DATE.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(x) if x else low for x, low in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0)))
    try:
        return datetime(year, month, day, hour, minute, second, int((m[7] or "").ljust(6, "0")[:6]), timezone.utc)
    except ValueError:
        return None


def read_records(data: bytes):
    """Yields a dict of RECORD's fields (and ``body``) for each record; stops at the first bytes that are none."""
    at = 0
    while data.startswith(b"WARC/1.", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = _fields(data[at:end].split(b"\r\n")[1:])
        size = head.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        while data.startswith(b"\r\n", at):
            at += 2
        http, _, body = block.partition(b"\r\n\r\n")
        lines = http.split(b"\r\n")
        first = lines[0].split()
        yield {
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "type": head.get("warc-type"),
            "url": head.get("warc-target-uri"),
            "time": warc_date(head.get("warc-date", "")),
            "status": int(first[1]) if len(first) > 1 and first[0].startswith(b"HTTP/") and first[1].isdigit() else None,
            "headers": _fields(lines[1:], joined=True),
            "digest": head.get("warc-payload-digest"),
            "body_bytes": len(body),
            "body": body,
        }


def capture_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(warc): each page as the bytes of two records, a full response and a later not-modified revisit.

    Null urls and pages are written as empty ones, null ids as ``null``.  Of seven revisits one asks with a validator of another version, one with none.
    """
    source = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def kernel(batches):
        for batch in batches:
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                i, name = page or 0, "null" if page is None else f"{page:012d}"
                body = html.encode("utf-8", "surrogatepass")
                tag, seen = hashlib.sha256(body).hexdigest()[:16], EPOCH + timedelta(seconds=37 * (i % SPAN))
                full = {"Date": f"day {i // 1000}", "ETag": f'"{tag}"', "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body)), "Cache-Control": "max-age=60"}
                asks = {"Date": f"day {i // 1000 + 1}", "Cache-Control": "max-age=600", "Content-Length": "0", "Content-Type": "text/plain", "X-Cache": "HIT"}
                if i % 7 != 6:
                    asks["ETag"] = f'W/"{tag}"' if i % 7 != 5 else '"other"'
                out.append(write_record(f"urn:moraine:{name}:full", "response", url, seen, 200, full, body) + write_record(f"urn:moraine:{name}:visit", "revisit", url, seen + timedelta(days=2), 304, asks, b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["warc"])

    return source.transform(small_batches).mapInArrow(kernel, "warc binary")


def parse_warc(files: DataFrame, warc_col: str = "warc") -> DataFrame:
    """Rows of RECORD from a binary column of WARC bytes.  Bodies are measured, not passed on."""

    def kernel(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            rows = [r for x in batch.column(0) if x.is_valid for r in read_records(x.as_py())]
            cols = [[list(r[n].items()) if n == "headers" else r[n] for r in rows] for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return files.select(warc_col).transform(small_batches).mapInArrow(kernel, RECORD)


def resolve_revisits(records: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One row per revisit of ``records`` (rows of RECORD): record_id, url, canonical, time, outcome (``resolved`` or a reason), response_id,
    response_time, digest, body_bytes, headers (merged).  The response's columns are null unless there is one; headers unless resolved."""
    url = canonical_url(F.coalesce("url", F.lit("")))
    rows = records.where("type IN ('response', 'revisit')").select("*", url.alias("canonical"), F.unix_micros("time").alias("at"))
    usable = (F.col("canonical") != "") & F.col("at").isNotNull()
    full = (F.col("type") == "response") & (F.col("status") == 200)
    kept = rows.where(usable & (full | (F.col("type") == "revisit"))).withColumn("full", full).withColumn("chunk", F.floor(F.col("at") / (chunk_seconds * 1_000_000)))
    one = F.when(F.col("full"), F.struct("at", "record_id", "digest", "body_bytes", "headers"))
    # a map can't be compared, so max_by over a key that can
    instants = kept.groupBy("canonical", "chunk", "at").agg(F.max_by(one, F.when(F.col("full"), F.coalesce("record_id", F.lit("")))).alias("one"), F.bool_or(~F.col("full")).alias("asked"))
    earlier = Window.partitionBy("canonical", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = instants.withColumn("near", F.last("one", ignorenulls=True).over(earlier)).where("asked").select("canonical", "chunk", "at", "near")
    # the last response of each chunk, then of the chunks before it
    ends = kept.groupBy("canonical", "chunk").agg(F.max_by(one, F.when(F.col("full"), F.struct("at", F.coalesce("record_id", F.lit(""))))).alias("end"))
    before = Window.partitionBy("canonical").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(before)).where("far IS NOT NULL").select("canonical", "chunk", "far")
    latest = near.join(carried, ["canonical", "chunk"], "left").select("canonical", "at", F.coalesce("near", "far").alias("found"))
    met = kept.where("NOT full").join(latest, ["canonical", "at"])
    lost = rows.where(~F.coalesce(usable, F.lit(False)) & (F.col("type") == "revisit")).withColumn("found", F.lit(None).cast(met.schema["found"].dataType))
    cols = ["record_id", "url", "canonical", "time", "at", "headers", "found"]
    every = met.select(cols).unionByName(lost.select(cols))
    weak = lambda x: F.regexp_replace(x, r"^\s*W/", "")
    tag, stamp = F.col("headers")["etag"], F.col("headers")["last-modified"]
    old_tag, old_stamp = F.col("found.headers")["etag"], F.col("found.headers")["last-modified"]
    holds = F.when(tag.isNotNull(), F.coalesce(weak(tag) == weak(old_tag), F.lit(False))).when(stamp.isNotNull(), F.coalesce(stamp == old_stamp, F.lit(False)))
    outcome = F.when(F.col("canonical") == "", "no-url").when(F.col("at").isNull(), "no-time").when(F.col("found").isNull(), "no-response").when(holds.isNull(), "unchecked").when(holds, "resolved").otherwise("mismatch")
    update = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*KEPT_HEADERS))
    # the response's headers that the update doesn't name, and the update
    merged = F.map_concat(F.map_filter("found.headers", lambda k, v: ~F.map_contains_key(update, k)), update)
    return every.withColumn("outcome", outcome).select("record_id", "url", "canonical", "time", "outcome", F.col("found.record_id").alias("response_id"), F.timestamp_micros("found.at").alias("response_time"), F.col("found.digest").alias("digest"), F.col("found.body_bytes").alias("body_bytes"), F.when(F.col("outcome") == "resolved", merged).alias("headers"))
