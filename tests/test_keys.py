import random

import pytest
from pyspark.sql import functions as F

from moraine.functions import keys as K


def signed(b):
    return [x - 256 if x > 127 else x for x in b]


def test_order_keys(spark):
    r = random.Random(3)
    keys = [b"", b"\x00", b"\x80", b"\x7f", b"\xff"] + [bytes(r.randrange(256) for _ in range(r.randrange(5))) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    for order, by in (("signed", signed), ("unsigned", list)):
        got = [bytes(x.key) for x in df.orderBy(K.order_key(F.col("key"), order)).collect()]
        assert got == sorted(keys, key=by)
    reverse = df.orderBy(K.order_key(F.col("key"), lambda k: F.lpad((F.lit(1000) - F.octet_length(k)).cast("string"), 5, "0"))).first()
    assert len(reverse.key) == max(map(len, keys))


def test_sizes_codes_and_names(spark):
    df = spark.createDataFrame([(bytearray(b"ab"), bytearray(b"xyz"), False), (bytearray(b"ab"), None, True), (bytearray(b""), bytearray(b""), False)], "k binary, v binary, d boolean")
    assert [r[0] for r in df.select(K.unit_size(F.col("k"), F.col("v"), F.col("d"))).collect()] == [5, 3, 0]
    assert [r[0] for r in df.select(K.is_delete(K.operation(F.col("d")))).collect()] == [False, True, False]
    assert [r[0] for r in df.select(K.from_marker(K.marker(F.col("d")))).collect()] == [False, True, False]
    with pytest.raises(Exception, match="unknown operation"):
        spark.range(1).select(K.is_delete(F.lit("X"))).collect()
    level, seq = K.run_name_parts(F.col("n"))
    got = spark.createDataFrame([("SST_3_17.sst",), ("Level_1_UNFINISHED_SST_1_2.sst",), (None,)], "n string").select(level, seq).collect()
    assert [tuple(r) for r in got] == [(3, 17), (None, None), (None, None)]


def test_prefixes_and_numbers(spark):
    df = spark.createDataFrame([("abcd", "abxy"), ("", "a"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(K.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 4]
    row = df.limit(1).select(K.rebuild_key(F.col("a"), F.lit(2), F.lit("zz"))).first()
    assert row[0] == "abzz"
    ns = [0, 1, -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    assert [bytes(r[0]) for r in df.select(K.long_to_bytes(F.col("n"))).collect()] == [n.to_bytes(8, "big", signed=True) for n in ns]
    assert [r[0] for r in df.select(K.bytes_to_long(K.long_to_bytes(F.col("n")))).collect()] == ns


def test_checksums_and_previews(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,), (bytearray(32),), (bytearray(b"\xff" * 32),)], "k binary")
    # fixed values: published check values of CRC-32C
    assert [r[0] for r in df.select(K.key_checksum(F.col("k"))).collect()] == [0xE3069283, 0, None, 0x8A9136AA, 0x62A8AB43]
    df = spark.createDataFrame([(bytearray(b"0123456789"),), (bytearray(b"0123456789a"),), (bytearray(b""),)], "k binary")
    assert [r[0] for r in df.select(K.preview(F.col("k"))).collect()] == ["30313233343536373839", "30313233343536373839...", ""]


def test_common_prefix_of_binaries_and_nulls(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xffa"), bytearray(b"\x00\xffb")), (None, bytearray(b"a")), (bytearray(b""), bytearray(b"")), (bytearray(b"x"), bytearray(b"y"))], "a binary, b binary")
    assert [r[0] for r in df.select(K.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, None, 0, 0]
