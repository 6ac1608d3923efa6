"""Media columns: text payloads stored as 8-bit samples in Ogg containers.

A stored form is one Ogg file with two interleaved logical streams: ``SAMPLES``
carries a header packet and the samples in packets, ``INDEX`` a header and one
entry per sample packet.  Reading verifies every page checksum, rebuilds packets from
lacing values, sorts them by stream and takes times from granule positions.

Defined results: a null or empty text is stored as 64 zero bytes; equal texts
give equal containers; a damaged container raises :class:`OggError`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RATE = 8000
PACKET = 16000
SAMPLES, INDEX = 1, 2
#: Bytes with their bits in opposite order, for the unreflected checksum of this format.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The container's pages or packets are not whole."""


def checksum(page: bytes) -> int:
    """Unreflected CRC-32 (start 0, no final inversion), by the reflected one over reversed bits."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


def _pages(serial: int, number: int, packet: bytes, granule: int, first: bool, last: bool) -> list[bytes]:
    """Pages of one packet: at most 255 lacing values each; a packet ends with a value under 255."""
    lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
    out, at = [], 0
    for k in range(0, len(lacing), 255):
        part = lacing[k : k + 255]
        ends = k + 255 >= len(lacing)
        body = packet[at : at + sum(part)]
        at += len(body)
        flags = (1 if k else 0) | (2 if first and not k else 0) | (4 if last and ends else 0)
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule if ends else -1, serial, number + len(out), 0) + bytes([len(part)]) + part
        page = head + body
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
    return out


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Store samples losslessly; times count samples."""
    chunks = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    streams = {SAMPLES: [(struct.pack("<8sIQ", b"PCMU8\0\0\0", rate, len(payload)), 0)], INDEX: [(b"INDEX\0\0\0", 0)]}
    done = 0
    for c in chunks:
        done += len(c)
        streams[SAMPLES].append((c, done))
        streams[INDEX].append((struct.pack("<QI", done - len(c), zlib.crc32(c)), done))
    out, numbers = [], dict.fromkeys(streams, 0)
    for i in range(len(chunks) + 1):
        for serial, packets in streams.items():
            pages = _pages(serial, numbers[serial], *packets[i], first=not i, last=i == len(chunks))
            numbers[serial] += len(pages)
            out += pages
    return b"".join(out)


def decode(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets with their granule positions by logical stream."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    pending: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(data):
        if len(data) < at + 27:
            raise OggError("page cut short")
        magic, version, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one is due")
        lacing = data[at + 27 : at + 27 + count]
        body_at = at + 27 + count
        end = body_at + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise OggError("page cut short")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("wrong checksum")
        if number != expected.get(serial, 0) or serial in ended or bool(flags & 2) != (serial not in expected):
            raise OggError("pages missing or out of order")
        if bool(flags & 1) != bool(pending.get(serial)):
            raise OggError("packet not continued")
        expected[serial] = number + 1
        parts, found = pending.pop(serial, []), streams.setdefault(serial, [])
        run = body_at
        for v in lacing:
            parts.append(data[run : run + v])
            run += v
            if v < 255:
                found.append((b"".join(parts), granule))
                parts = []
        if parts:
            pending[serial] = parts
        if flags & 4:
            ended.add(serial)
        at = end
    if pending or ended != set(streams):
        raise OggError("stream not ended")
    return streams


def read_back(data: bytes) -> tuple[bytes, str]:
    """The samples, and features: rate, seconds by granule position, level, zero crossings and packets."""
    streams = decode(data)
    _, rate, n = struct.unpack("<8sIQ", streams[SAMPLES][0][0])
    packets = streams[SAMPLES][1:]
    payload = b"".join(p for p, _ in packets)
    times = [g for _, g in packets]
    marks = [struct.unpack("<QI", p) for p, _ in streams[INDEX][1:]]
    if len(payload) != n or marks != [(g - len(p), zlib.crc32(p)) for p, g in packets]:
        raise OggError("samples and index differ")
    low = sum(map(payload.count, (0, 9, 10, 13, 32)))
    feature = f"rate={rate};seconds={times[-1] / rate:.6f};packets={len(packets)};gaps={low / n:.6f};crc={zlib.crc32(payload):08x}"
    return payload, feature


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0)), len(raw)


_STORED = "doc_id long, n_bytes long, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            rows = [padded(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([encode(p) for p, _ in rows], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )


def store(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_bytes, media)`` with one container per document."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, _STORED)


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            rows = []
            for m in part.column(2).to_pylist():
                payload, feature = read_back(m)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def examine(media: DataFrame) -> DataFrame:
    """Verify and read containers ``(doc_id, n_bytes, media)``; digests of what was read, and features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _examine, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
