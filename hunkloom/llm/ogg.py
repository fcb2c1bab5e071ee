"""Media columns: byte payloads as samples of an Ogg file, and back.

Writing: a payload becomes 8-bit samples, 576 a packet, in one logical stream; a second stream
holds a packet of facts about the payload. Their pages are interleaved in one physical stream.
A page has at most 255 lacing values, its checksum is the CRC of generator 0x04c11db7, and its
granule position counts the samples that end in it.

Reading checks the capture pattern, version, checksum and sequence number of each page,
demultiplexes pages by serial number, reassembles packets from lacing values (also across pages)
and derives timestamps from granule positions. A damaged file is an error.

Defined results: null is the empty payload; a payload is padded with bytes 255 to a positive
multiple of 576; equal payloads give equal files (serial numbers come from the payload); repeated
rows are treated alike; columns of the input are carried along, those named as an output are replaced.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, with_fields

FRAME, RATE = 576, 8000
#: Fixed values of the container format: capture pattern, header layout, flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<8sBII")  # of a stream: kind, version, rate, samples a packet
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC (most significant bit first, from 0), by way of zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def lacing_of(size: int) -> bytes:
    """Lacing values of a packet: 255 for each full segment, then the rest, which may be 0."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def pages_of(serial: int, number: int, packets: list[bytes], granules: list[int], last: bool) -> Iterator[bytes]:
    """Pages of whole or continued packets; a page in which no packet ends has granule -1."""
    values, body, granule, flags = bytearray(), [], -1, 0
    for packet, end in zip(packets, granules, strict=True):
        own, at = lacing_of(len(packet)), 0
        while own:
            take = own[: 255 - len(values)]
            size = sum(take)
            values += take
            body.append(packet[at : at + size])
            own, at = own[len(take) :], at + size
            if not own:
                granule = end
            if len(values) == 255:
                done = last and not own and packet is packets[-1]
                yield page(flags | LAST * done, granule, serial, number, bytes(values), b"".join(body))
                number, flags, granule = number + 1, CONTINUED * bool(own), -1
                values, body = bytearray(), []
    if values:
        yield page(flags | LAST * last, granule, serial, number, bytes(values), b"".join(body))


_FULL = lacing_of(FRAME) * 85  # 85 packets of 576 bytes fill a page's 255 lacing values


def write(payload: bytes, size: int) -> bytes:
    """An Ogg file of a payload (a multiple of 576 bytes), of which the first `size` bytes are meant."""
    serial = zlib.crc32(payload)
    facts = serial ^ 0xFFFFFFFF
    out = [page(FIRST, 0, serial, 0, bytes([HEAD.size]), HEAD.pack(b"samples8", 0, RATE, FRAME)), page(FIRST, 0, facts, 0, bytes([HEAD.size]), HEAD.pack(b"facts\0\0\0", 0, 0, 0))]
    step = 85 * FRAME
    for number, at in enumerate(range(0, len(payload), step), 1):
        body = payload[at : at + step]
        out.append(page(LAST * (at + step >= len(payload)), at + len(body), serial, number, _FULL[: 3 * (len(body) // FRAME)], body))
        if number == 1:  # between pages of the other stream
            out += pages_of(facts, 1, [struct.pack("<QQ", size, len(payload))], [1], True)
    return b"".join(out)


def read(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, and for each page's last packet its granule position."""
    streams: dict[int, dict] = {}
    at = 0
    view = memoryview(media)
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError(f"a page header is cut off at byte {at}")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if capture != CAPTURE or version or len(lacing) < n or end > len(media):
            raise ValueError(f"no whole page at byte {at}")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise ValueError(f"a page's checksum fails at byte {at}")
        s = streams.get(serial)
        if (s is None) != bool(flags & FIRST):
            raise ValueError(f"stream {serial} does not begin with its first page")
        if s is None:
            s = streams[serial] = {"packets": [], "part": b"", "next": 0, "granules": [], "ended": False}
        if number != s["next"] or s["ended"] or bool(flags & CONTINUED) != bool(s["part"]):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        s["next"], s["ended"] = number + 1, bool(flags & LAST)
        spot = at + 27 + n
        values = np.frombuffer(lacing, np.uint8)
        ends = np.flatnonzero(values < 255)
        for size in np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)[ends]]).tolist():
            s["packets"].append(s["part"] + media[spot : spot + size])
            s["part"] = b""
            spot += size
        s["part"] += media[spot:end]
        if len(ends):
            s["granules"].append((len(s["packets"]), granule))
        at = end
    if any(not s["ended"] or s["part"] for s in streams.values()):
        raise ValueError("a stream has no last page")
    return streams


def payload_of(media: bytes) -> tuple[bytes, int, list[float]]:
    """The stored samples, how many of them are meant, and the end time in seconds of each page of samples."""
    streams = read(media)
    kinds = {HEAD.unpack(s["packets"][0])[0].rstrip(b"\0"): s for s in streams.values()}
    head = HEAD.unpack(kinds[b"samples8"]["packets"][0])
    times = [g / head[2] for n, g in kinds[b"samples8"]["granules"] if n > 1]
    size, whole = struct.unpack("<QQ", kinds[b"facts"]["packets"][1])
    payload = b"".join(kinds[b"samples8"]["packets"][1:])
    if len(payload) != whole or round(times[-1] * head[2]) != whole:
        raise ValueError("samples are missing")
    return payload, size, times


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def feature(payload: bytes, times: list[float]) -> str:
    """Features of the samples: duration, pages, mean, deviation and sign changes about 128."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    high = x >= 128
    return f"seconds={times[-1]:.6f};pages={len(times)};sum={total};deviation={math.sqrt(max(0, squares * len(x) - total * total)) / len(x):.6f};crossings={int((high[1:] != high[:-1]).sum())}"


def store(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """The rows with the file (`media`, if `keep`) of each text and what reading it back gives."""
    new = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep
    docs = docs.drop(*(c for c in [f.split()[0] for f in new.split(", ")] if c != text))
    bound_batches(docs.sparkSession)
    schema = with_fields(docs, new)

    def run(it):
        for batch in it:
            column = batch.column(text)
            for at in range(0, len(column), 500):
                rows = []
                for t in column.slice(at, 500).to_pylist():
                    media = write(*padded(t))
                    payload, size, times = payload_of(media)
                    rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, times), media)[: 7 + keep])
                part = batch.slice(at, 500)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=False))], names=schema.names)

    return docs.mapInArrow(run, schema)


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return store(docs, keep=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
