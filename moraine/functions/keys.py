"""Column functions on keys, units and file names.  All are built of Spark functions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CASTAGNOLI = 0x82F63B78  # the polynomial of CRC-32C, reflected
_LATIN = "".join(map(chr, range(256)))


def order_key(key: Column, order="signed") -> Column:
    """A string column that sorts as the binary keys shall.

    Spark compares strings by UTF-8 bytes, that is by code point.  Each byte becomes one character from U+0100 on; with ``signed`` order
    its top bit is flipped first, so that 0x80..0xFF come before 0x00..0x7F.
    """
    if callable(order):
        return order(key)
    flip = 0x80 if order == "signed" else 0
    return F.translate(F.decode(key, "ISO-8859-1"), _LATIN, "".join(chr(0x100 + (b ^ flip)) for b in range(256)))


def unit_size(key: Column, value: Column, is_deleted: Column) -> Column:
    """Bytes that a unit counts for: key and value, or key and one for a tombstone."""
    return (F.octet_length(key) + F.when(is_deleted, 1).otherwise(F.octet_length(value))).cast("bigint")


def is_delete(op: Column) -> Column:
    """Operation code to tombstone flag; any other code than W and D raises."""
    return F.when(op == "W", F.lit(False)).when(op == "D", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null")))).cast("boolean"))


def operation(is_deleted: Column) -> Column:
    return F.when(is_deleted, "D").otherwise("W")


def marker(is_deleted: Column) -> Column:
    """Tombstone flag to its stored byte."""
    return F.when(is_deleted, 1).otherwise(0).cast("tinyint")


def from_marker(byte: Column) -> Column:
    return byte == 1


def run_name(level: Column, file_seq: Column) -> Column:
    return F.format_string("SST_%d_%d.sst", level, file_seq)


def run_name_parts(name: Column) -> tuple[Column, Column]:
    """(level, file_seq) of a run's name; null where the name is none, as an unfinished file's."""
    part = lambda i: F.regexp_extract(name, r"^SST_([0-9]+)_([0-9]+)[.]sst$", i)
    return F.try_to_number(F.nullif(part(1), F.lit("")), F.lit("9" * 9)).cast("int"), F.try_to_number(F.nullif(part(2), F.lit("")), F.lit("9" * 18)).cast("bigint")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings or binaries."""
    n = F.least(F.length(a), F.length(b))
    same = lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))
    # one character after another, as long as they agree
    longest = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda length, i: F.when((length == i - 1) & same(i), i).otherwise(length))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(n > 0, longest).otherwise(0)).cast("bigint")


def rebuild_key(first: Column, prefix: Column, suffix: Column) -> Column:
    """A key from the first key of its cluster, the length of the common prefix and its own rest."""
    return F.concat(F.substring(first, F.lit(1), prefix.cast("int")), suffix)


def long_to_bytes(n: Column) -> Column:
    """Big-endian bytes of a 64-bit number."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def bytes_to_long(b: Column) -> Column:
    return F.conv(F.hex(b), 16, -10).cast("bigint")


def _castagnoli(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (CASTAGNOLI if byte & 1 else 0)
    return byte


def key_checksum(key: Column) -> Column:
    """CRC-32C of a key, unsigned."""
    table = F.array(*[F.lit(_castagnoli(b)).cast("bigint") for b in range(256)])
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("bigint"))
    all_ones = F.lit(0xFFFFFFFF).cast("bigint")
    step = lambda crc, b: F.shiftrightunsigned(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")))
    return F.when(F.octet_length(key) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(codes, all_ones, step).bitwiseXOR(all_ones))


def preview(b: Column) -> Column:
    """The first ten bytes, in hex, for logs."""
    return F.concat(F.hex(F.substring(b, 1, 10)), F.when(F.octet_length(b) > 10, "...").otherwise(""))
