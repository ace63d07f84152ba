"""Ogg media columns: pages with checksums, packets in lacing values, logical streams, granule positions.

Fixed format facts (RFC 3533): capture pattern ``OggS``, version 0, a 27-byte page head, up to 255 lacing values,
flags 1 = continued packet, 2 = first page of a stream, 4 = last page; the checksum is a CRC of polynomial
0x04C11DB7 over the page with its checksum field zero, no reflection, initial value and final xor zero.

A text is stored as 8-bit samples in one logical stream; a second stream, multiplexed with it, carries a CRC-32 for
each sample packet.  Reading verifies every page, resynchronises after damage, reassembles packets from lacing
values, splits the streams by serial number and derives times from granule positions.

Defined results: null is the empty text, padded like any other to one block of zeros; equal texts give equal
bytes; repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm._common import small_batches

HEAD = "<4sBBqIIIB"
HEAD_SIZE = struct.calcsize(HEAD)
CONTINUED, FIRST, LAST = 1, 2, 4
RATE = 8000  # samples a second of the stored form
PACKET = 4000  # samples in a packet
BLOCK = 64
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The page checksum.  zlib's CRC is the same one over reflected bits, so bytes and result are bit-reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Packet:
    data: bytes
    granule: int  # position at the end of the packet, in samples; -1 if its page tells none


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    ended: bool = False
    lost: int = 0  # gaps in the page sequence, and packets dropped as a part of theirs is missing: 0 if and only if nothing is


def stream_pages(serial: int, packets: list[Packet]) -> list[tuple[int, bytes]]:
    """(granule, page) of a logical stream.  The first packet has a page of its own, as headers must."""
    pages: list[list] = []  # lacing, body parts, granule, continued
    for i, p in enumerate(packets):
        lacing = [255] * (len(p.data) // 255) + [len(p.data) % 255]
        at, fresh = 0, True
        while lacing:
            if not pages or len(pages[-1][0]) == 255 or i == 1 and fresh:
                pages.append([[], [], -1, not fresh])
            page = pages[-1]
            take = lacing[: 255 - len(page[0])]
            del lacing[: len(take)]
            size = sum(take)
            page[0] += take
            page[1].append(p.data[at : at + size])
            at, fresh = at + size, False
            if not lacing:
                page[2] = p.granule
    out = []
    for k, (lacing, parts, granule, goes_on) in enumerate(pages):
        flags = CONTINUED * goes_on | FIRST * (k == 0) | LAST * (k == len(pages) - 1)
        rest = bytes(lacing) + b"".join(parts)
        crc = page_crc(struct.pack(HEAD, b"OggS", 0, flags, granule, serial, k, 0, len(lacing)) + rest)
        out.append((granule, struct.pack(HEAD, b"OggS", 0, flags, granule, serial, k, crc, len(lacing)) + rest))
    return out


def multiplex(streams: list[tuple[int, list[Packet]]]) -> bytes:
    """All first pages, then the pages of all streams by granule position."""
    paged = [stream_pages(serial, packets) for serial, packets in streams]
    out, rest = [p[0][1] for p in paged if p], []
    for s, pages in enumerate(paged):
        at = 0
        for k, (granule, page) in enumerate(pages[1:]):
            at = max(at, granule)
            rest.append((at, s, k, page))
    return b"".join(out + [x[3] for x in sorted(rest, key=lambda x: x[:3])])


def read_pages(data: bytes):
    """Yields (flags, granule, serial, sequence, lacing, body) of each sound page; after damage, goes on at the next capture
    pattern that begins a sound page."""
    at = data.find(b"OggS")
    while 0 <= at and at + HEAD_SIZE <= len(data):
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(HEAD, data, at)
        lacing = data[at + HEAD_SIZE : at + HEAD_SIZE + n]
        end = at + HEAD_SIZE + n + sum(lacing)
        if version == 0 and len(lacing) == n and end <= len(data) and page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc:
            yield flags, granule, serial, sequence, lacing, data[at + HEAD_SIZE + n : end]
            at = data.find(b"OggS", end)
        else:
            at = data.find(b"OggS", at + 1)


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, their packets whole; a packet with a missing part is dropped and counted."""
    streams: dict[int, Stream] = {}
    open_: dict[int, tuple[int, list[bytes] | None]] = {}  # serial: next sequence, parts of the unfinished packet
    for flags, granule, serial, sequence, lacing, body in read_pages(data):
        s = streams.setdefault(serial, Stream(serial))
        expected, parts = open_.get(serial, (0, None))
        if sequence != expected:
            s.lost, parts = s.lost + 1, None
        skipping = bool(flags & CONTINUED) and parts is None  # its begin is missing
        if not flags & CONTINUED and parts is not None:
            s.lost, parts = s.lost + 1, None
        done, at, size = [], 0, 0
        for x in lacing:
            size += x
            if x < 255:
                piece = body[at : at + size]
                at, size = at + size, 0
                if skipping:
                    s.lost, skipping = s.lost + 1, False
                else:
                    done.append(b"".join([*(parts or []), piece]))
                    parts = None
        if lacing and lacing[-1] == 255 and not skipping:
            parts = [*(parts or []), body[at : at + size]]
        s.packets += [Packet(d, -1) for d in done]
        if done:
            s.packets[-1].granule = granule
        s.ended |= bool(flags & LAST)
        open_[serial] = sequence + 1, parts
    return streams


def packet_times(stream: Stream, rate: int, length=lambda p: len(p.data)) -> list[tuple[float, float]]:
    """(start, end) in seconds of each packet after the header, from granule positions: a page tells the position at the
    end of its last packet, the others follow from packet lengths."""
    ends, after = [0] * len(stream.packets), None
    for i in range(len(stream.packets) - 1, 0, -1):
        p = stream.packets[i]
        ends[i] = p.granule if p.granule >= 0 else after
        after = None if ends[i] is None else ends[i] - length(p)
    return [((e - length(p)) / rate, e / rate) for p, e in list(zip(stream.packets, ends))[1:] if e is not None]


def store(payload: bytes) -> bytes:
    """The payload as an Ogg file of 8-bit samples, with a second stream of checks."""
    serial = zlib.crc32(payload)
    chunks = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    samples, checks, at = [Packet(b"\x80pcm8\0\0\0" + struct.pack("<IQ", RATE, len(payload)), 0)], [Packet(b"\x80check\0\0" + struct.pack("<I", serial), 0)], 0
    for c in chunks:
        at += len(c)
        samples.append(Packet(c, at))
        checks.append(Packet(struct.pack("<I", zlib.crc32(c)), at))
    return multiplex([(serial, samples), ((serial + 1) & 0xFFFFFFFF, checks)])


class OggError(ValueError):
    """The stored bytes don't hold a whole payload."""


def load(data: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """The payload of ``store`` and its packets' times; OggError if any part is damaged or missing."""
    streams = demultiplex(data)
    by_kind = {s.packets[0].data[:8]: s for s in streams.values() if s.packets}
    samples, checks = by_kind.get(b"\x80pcm8\0\0\0"), by_kind.get(b"\x80check\0\0")
    if samples is None or checks is None or samples.lost or checks.lost or not samples.ended or not checks.ended:
        raise OggError("a stream is damaged or missing")
    rate, n = struct.unpack_from("<IQ", samples.packets[0].data, 8)
    payload = b"".join(p.data for p in samples.packets[1:])
    if [struct.pack("<I", zlib.crc32(p.data)) for p in samples.packets[1:]] != [p.data for p in checks.packets[1:]] or len(payload) != n:
        raise OggError("the samples don't match their checks")
    return payload, packet_times(samples, rate)


def pad(raw: bytes) -> bytes:
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def describe(payload: bytes, times: list[tuple[float, float]]) -> str:
    """Features of the samples: how long, how many packets, mean, root mean square, zero crossings around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    sign = x >= 128
    return f"seconds={times[-1][1]:.6f};packets={len(times)};mean={x.sum() / len(x):.6f};rms={float(np.dot(x, x) / len(x)) ** 0.5:.6f};crossings={int((sign[1:] != sign[:-1]).sum())}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, media (the stored form; left out if not ``keep_media``), and what reading it back
    gives: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.  No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def kernel(batches):
        for batch in batches:
            rows, media = [], []
            for t in batch.column(1):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                data = store(pad(raw))
                back, times = load(data)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), describe(back, times)))
                if keep_media:
                    media.append(data)
            cols = list(zip(*rows)) or [()] * len(names)
            arrays = [batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(media, pa.binary())] if keep_media else []), names=["id", *names] + ["media"] * keep_media)

    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * keep_media
    return source.transform(small_batches).mapInArrow(kernel, schema)
