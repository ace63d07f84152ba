"""Store options with the bounds they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

MIB = 1 << 20
#: fixed values: codec names of the store and of the Parquet writer
CODECS = {"none": "none", "snappy": "snappy", "lz4": "lz4_raw", "zstd": "zstd"}


@dataclass(frozen=True)
class StoreOptions:
    """flush_bytes: unit bytes of the log tail at which it is flushed, by each write that reaches it if ``auto_flush``, else by ``maybe_flush`` only.  target_file_bytes: unit bytes of a level-0 file; level n
    takes (n + 1) times that.  cluster_size: entries for each entry of the sparse index.  key_order: ``signed`` (bytes as -128..127),
    ``unsigned``, or a function from the key column to a string column that sorts as the keys shall."""

    flush_bytes: int = 512 * MIB
    target_file_bytes: int = 256 * MIB
    cluster_size: int = 10
    compression: str = "lz4"
    key_order: str | Callable[[Column], Column] = "signed"
    bloom: bool = True
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 * MIB
    auto_flush: bool = True

    def __post_init__(self):
        if self.target_file_bytes < MIB:
            raise ValueError("target_file_bytes is 1 MiB at least")
        if self.flush_bytes < self.target_file_bytes:
            raise ValueError("flush_bytes is target_file_bytes at least")
        if not 2 <= self.cluster_size <= 20:
            raise ValueError("cluster_size is 2 to 20")
        if self.compression not in CODECS:
            raise ValueError(f"compression is one of {', '.join(CODECS)}")
        if not callable(self.key_order) and self.key_order not in ("signed", "unsigned"):
            raise ValueError("key_order is signed, unsigned or a function")

    def level_file_bytes(self, level: int) -> int:
        return self.target_file_bytes * (level + 1)
