"""Ogg, WARC, mixing, URL filters and the pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from oracles import duck, same_rows
from moraine.llm import catalog, mixing, ogg, urlfilter, warc


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_ogg_round_trip():
    r = random.Random(1)
    for n in (64, 4032, 4096, 8000, 255 * 64, 70_016, 400_000):
        payload = r.randbytes(n)
        data = ogg.store(payload)
        back, times = ogg.load(data)
        assert back == payload and times[-1][1] == n / ogg.RATE and all(a[1] == b[0] for a, b in zip(times, times[1:])) and times[0][0] == 0
    assert ogg.page_crc(data[:5000]) == slow_crc(data[:5000])


def test_ogg_packets_over_pages():
    """Packets of lacing-sized lengths, empty ones, and one over many pages."""
    sizes = [19, 0, 255, 510, 1, 255 * 255, 200_000, 254]
    packets = [ogg.Packet(bytes([i % 251]) * n, i) for i, n in enumerate(sizes)]
    other = [ogg.Packet(b"head", 0), ogg.Packet(b"x" * 70_000, 3)]
    streams = ogg.demultiplex(ogg.multiplex([(7, packets), (9, other)]))
    assert [p.data for p in streams[7].packets] == [p.data for p in packets] and [p.data for p in streams[9].packets] == [p.data for p in other]
    assert streams[7].ended and streams[7].packets[-1].granule == 7 and not streams[7].lost


def test_ogg_damage():
    data = bytearray(ogg.store(bytes(range(256)) * 1000))
    for at in (30, 100, len(data) // 2, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.load(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.load(bytes(data[: len(data) // 2]))
    assert ogg.load(b"junk OggS junk" + bytes(data))[0] == bytes(range(256)) * 1000
    assert ogg.demultiplex(b"") == {}


def test_a_missing_page_is_noticed():
    """Also if the pages around it begin and end with whole packets."""
    packets = [ogg.Packet(bytes([i % 251]) * 10, i) for i in range(800)]
    pages = [page for _, page in ogg.stream_pages(7, packets)]
    assert len(pages) > 3
    for i in range(len(pages)):
        got = ogg.demultiplex(b"".join(p for j, p in enumerate(pages) if j != i))[7]
        assert got.lost > 0 or (i == len(pages) - 1 and not got.ended)


def test_media_query(spark, sf_dir):
    rows = {r.doc_id: r for r in catalog.op5_ogg_media(spark, sf_dir).collect()}
    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw, r = (d.text or "").encode(), rows[d.doc_id]
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        data = ogg.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        # the payload stands in the stored bytes, page heads aside
        samples = b"".join(body for *_, body in (p for p in ogg.read_pages(data) if p[2] == zlib.crc32(payload)))
        assert samples.endswith(payload) and (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest()) and r.feature


def test_media_rows(odd_docs, no_docs):
    rows = ogg.media_columns(odd_docs).collect()
    assert len(rows) == 11 and ogg.media_columns(no_docs).count() == 0
    for r in rows:
        back, _ = ogg.load(bytes(r.media))
        assert (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:])) == (r.payload_bytes, r.payload_sha256, r.tail_crc32)
        assert (len(r.media), hashlib.sha256(r.media).hexdigest()) == (r.media_bytes, r.media_sha256)
        assert back[r.n_bytes :].strip(b"\0") == b"" and len(back) % 64 == 0
    assert len({r.media_sha256 for r in rows if r.id in (4, 5)}) == 1


def plain_resolve(rows):
    out = {}
    for r in rows:
        if r["type"] != "revisit":
            continue
        before = [x for x in rows if x["type"] == "response" and x["status"] == 200 and x["canonical"] == r["canonical"] and x["time"] < r["time"]]
        best = max(before, key=lambda x: (x["time"], x["record_id"]), default=None)
        if best is None:
            out[r["record_id"]] = ("no-response", None)
            continue
        tag, stamp = r["headers"].get("etag"), r["headers"].get("last-modified")
        bare = lambda t: t and t.removeprefix("W/")
        holds = bare(tag) == bare(best["headers"].get("etag")) if tag else stamp == best["headers"].get("last-modified") if stamp else None
        out[r["record_id"]] = ("unchecked" if holds is None else "resolved" if holds else "mismatch", best["record_id"])
    return out


@pytest.mark.parametrize("chunk", [5, 100_000])
def test_revisits_against_brute_force(spark, chunk):
    r, rows = random.Random(4), []
    for i in range(300):
        kind = r.choice(["response", "revisit", "revisit", "request"])
        headers = {"etag": r.choice(['"1"', 'W/"1"', '"2"'])} if r.random() < 0.6 else {"last-modified": r.choice("ab")} if r.random() < 0.6 else {}
        url = r.choice(["http://a.com/x", "https://www.A.com/x/#f", "http://hot.com/?utm_source=q", "http://hot.com"])
        t = datetime.fromtimestamp(r.randrange(60), timezone.utc)
        rows.append({"record_id": f"r{i:03d}", "type": kind, "url": url, "time": t, "status": r.choice([200, 200, 404]) if kind == "response" else 304, "headers": headers, "digest": f"d{i}", "body_bytes": i, "canonical": "a.com/x" if "om/x" in url else "hot.com"})
    df = spark.createDataFrame([tuple(x[n] for n in ("record_id", "type", "url", "time", "status", "headers", "digest", "body_bytes")) for x in rows], warc.RECORD)
    got = warc.resolve_revisits(df, chunk).collect()
    assert {x.record_id: (x.outcome, x.response_id) for x in got} == plain_resolve(rows)
    for x in got:
        assert (x.headers is not None) == (x.outcome == "resolved")


def test_merged_headers_and_odd_records(spark):
    t = lambda s: datetime.fromtimestamp(s, timezone.utc)
    rows = [
        ("a", "response", "http://x.org/p?ref=1&q=2", t(1), 200, {"etag": '"1"', "content-length": "9", "date": "old", "vary": "v"}, "sha1:A", 9),
        ("b", "revisit", "https://X.org:443/p?q=2#z", t(2), 304, {"etag": '"1"', "content-length": "0", "date": "new", "transfer-encoding": "chunked"}, None, 0),
        ("c", "revisit", None, t(2), 304, {}, None, 0),
        ("d", "revisit", "http://x.org/p?q=2", None, 304, None, None, None),
        (None, "revisit", "http://x.org/p?q=2", t(3), None, None, None, None),
        (None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, warc.RECORD)
    got = {x.record_id: x for x in warc.resolve_revisits(df).collect()}
    assert got["b"].headers == {"etag": '"1"', "content-length": "9", "date": "new", "vary": "v"} and got["b"].digest == "sha1:A"
    assert (got["c"].outcome, got["d"].outcome, got[None].outcome, got[None].response_id) == ("no-url", "no-time", "unchecked", "a")
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_warc_bytes(spark):
    when = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    data = warc.write_record("urn:1", "response", "http://é.org/", when, 200, {"A": "b", "ETag": '"x"'}, b"body\r\n\r\nWARC/1.1\r\n") + warc.write_record("urn:2", "revisit", "", when, 304, {}, b"")
    a, b = warc.read_records(data)
    assert (a["record_id"], a["url"], a["time"], a["status"], a["headers"], a["body"]) == ("urn:1", "http://é.org/", when, 200, {"a": "b", "etag": '"x"'}, b"body\r\n\r\nWARC/1.1\r\n")
    assert (b["type"], b["status"], b["body_bytes"], b["digest"]) == ("revisit", 304, 0, None)
    assert len(list(warc.read_records(data[:-30]))) == 1 and list(warc.read_records(b"nothing")) == []
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "http://a.org", "<p>", "y"), (2, "", "", "z")], "page_id bigint, url string, html string, warc string")
    records = warc.parse_warc(warc.capture_pages(pages))
    assert records.count() == 6 and warc.parse_warc(warc.capture_pages(pages.where("false"))).count() == 0
    assert warc.parse_warc(spark.createDataFrame([(None,), (bytearray(b"x"),)], "warc binary")).count() == 0


def test_warc_dates_ids_and_repeated_headers(spark):
    day = lambda *a: datetime(*a, tzinfo=timezone.utc)
    for text, want in (("2024-05-06T07:08:09.25Z", day(2024, 5, 6, 7, 8, 9, 250_000)), ("2024-05-06T07:08:09.123456789Z", day(2024, 5, 6, 7, 8, 9, 123_456)), ("2024-05-06T07:08Z", day(2024, 5, 6, 7, 8)), ("2024-05", day(2024, 5, 1)), ("2024-13-01", None), ("", None), ("2024-05-06T07:08:09", None)):
        assert warc.warc_date(text) == want, text
    assert warc._fields([b"Vary: a", b"vary: b", b"Set-Cookie: c", b"Set-Cookie: d"], joined=True) == {"vary": "a, b", "set-cookie": "d"}
    pages = spark.createDataFrame([(9_000_000_000, "http://a.org/1", "x"), (-1, "http://a.org/2", "y"), (None, "http://a.org/3", "z"), (2**63 - 1, "http://a.org/4", "")], "page_id bigint, url string, html string")
    got = {x.canonical[-1]: x for x in warc.resolve_revisits(warc.parse_warc(warc.capture_pages(pages))).collect()}
    assert [got[k].record_id.split(":")[2] for k in "1234"] == ["009000000000", "-00000000001", "null", str(2**63 - 1)]


def test_revisit_query(spark, sf_dir):
    """Every page's revisit against the plain version, and its page's id."""
    rows = [r.asDict() for r in warc.parse_warc(warc.capture_pages(catalog.table(spark, sf_dir, "pages"))).withColumn("canonical", warc.canonical_url(F.col("url"))).collect()]
    want = {k: v for k, v in plain_resolve([r for r in rows if r["canonical"]]).items()}
    got = {x.record_id: x for x in catalog.op6_warc_revisits(spark, sf_dir).collect()}
    assert len(got) == catalog.table(spark, sf_dir, "pages").count()
    assert {k: (got[k].outcome, got[k].response_id) for k in want} == want
    assert all(int(k.split(":")[2]) == x.page_id for k, x in got.items())


def water(sizes, weights=(1, 2, 3), limit=3):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_targets(spark):
    r = random.Random(2)
    for case in range(4):
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, 5000]) for i in range(r.randrange(1, 9))} | ({None: 70} if case % 2 else {})
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {x.source: x.target for x in mixing.source_targets(df).collect()}
        assert got == pytest.approx(water(sizes))


def test_mix(spark, sf_dir):
    docs = catalog.table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    rows = mixing.mix_to_weights(docs).collect()
    again = mixing.mix_to_weights(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size and r.copies <= 3
    for part in by.values():
        ratio = part[0].target / part[0].source_size
        assert all(r.copies in (int(ratio), int(ratio) + 1) for r in part)
        # the sum of copies is kept but for one residual; words stay within the largest document
        assert abs(sum(r.copies for r in part) - ratio * len(part)) <= 1 + 1e-6
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part)


def test_mix_expectation(spark):
    """Over seeds, each document is taken as often as its fraction says."""
    docs = spark.createDataFrame([(i, "w " * (3 + i % 5), "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, source string")
    total = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix_to_weights(docs, seed=seed).collect():
            total[r.id] += r.copies
    a = [total[i] / 12 for i in range(0, 40, 2)]
    assert 0.5 < sum(a) / len(a) < 0.85 and len({round(x, 2) for x in a}) > 2


def test_mix_odd_rows(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 2)
    rows = mixing.mix_to_weights(odd_docs).collect()
    assert len(rows) == 11 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.target for r in rows if r.source is None} == {0.0}
    assert mixing.mix_to_weights(no_docs).count() == 0


def plain_rule(url, rules):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
    host, rest = tail[:cut], tail[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, None)))


@pytest.mark.parametrize("per_salt", [3, 10**6])
def test_url_rules_against_brute_force(spark, per_salt):
    r = random.Random(3)
    labels, paths = ["a", "b", "com", "x-y", ""], ["", "/", "/a", "/a/", "/ab", "/a/b/c", "/é"]
    rules = [(".".join(r.choice(labels) for _ in range(r.randrange(1, 4))), r.choice(paths), r.choice(["block", "allow"])) for _ in range(60)] + [(None, "/", "block"), ("a", None, "block"), ("", "", "block")]
    urls = [f"{r.choice(['http', 'S'])}://{'.'.join(r.choice(labels + ['A']) for _ in range(r.randrange(1, 5)))}{r.choice(paths)}{r.choice(['', '?q://z', '#f', '/more'])}" for _ in range(300)] + [None, "", "no scheme", "://", "http://", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate(urls)], "page_id bigint, url string, key string, host string")
    out = urlfilter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, action string"), per_salt=per_salt)
    got = {x.id: (x.host, x.path, x.rule, x.verdict) for x in out.collect()}
    for i, u in enumerate(urls):
        host, path, rule, action = plain_rule(u, rules)
        assert got[i] == (host, path, rule, action or "allow"), u


def test_url_query_and_empty(spark, sf_dir):
    same_rows(catalog.op8_url_filter(spark, sf_dir), duck(sf_dir), catalog.OP8_SQL)
    pages, rules = catalog.table(spark, sf_dir, "pages"), catalog.url_rules(spark)
    assert urlfilter.judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, rules.where("false"), default="block").collect()} == {"block"}


def test_every_operator_has_a_query():
    names = catalog.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(catalog.oracle_sql()) <= set(names)


def test_pipeline(spark, sf_dir, tmp_path):
    """Stage by stage over real documents and planted ones."""
    import corpus_pipeline as cp

    docs = catalog.table(spark, sf_dir, "documents")
    item = catalog.table(spark, sf_dir, "benchmark").first().text
    fresh = " ".join(f"unique{i}word{i * i}" for i in range(120))
    planted = [(10**6, fresh, "en", "src0", len(fresh)), (10**6 + 1, fresh, "en", "src1", len(fresh)), (10**6 + 2, fresh.upper(), "en", "src2", len(fresh)), (10**6 + 3, "before " + item + " after", "en", "src3", 5), (None, None, None, None, None), (10**6 + 4, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    columns, ids = docs.columns, {}
    for n, (name, stage) in enumerate(cp.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if n < len(cp.STAGES) - 1:
            assert docs.columns == columns and docs.schema == before.schema
    near = ids["simhash_near_dedup"]
    assert 10**6 in near and 10**6 + 1 not in near and 10**6 + 2 not in near
    # of the empty documents one stays
    assert near.count(None) + (10**6 + 4 in near) <= 1
    assert ids["suffix_dedup"].count(10**6) == 1 and sorted(map(str, ids["suffix_dedup"])) == sorted(map(str, near))
    assert 10**6 + 3 in near and 10**6 + 3 not in ids["decontaminate"]
    assert sorted(map(str, ids["mixing"])) == sorted(map(str, ids["decontaminate"]))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "decontaminate", "mixing"]
