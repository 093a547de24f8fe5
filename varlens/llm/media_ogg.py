"""Ogg media columns: bytes stored losslessly as 8-bit samples in two multiplexed logical streams.

``encode`` pads a text's UTF-8 bytes with spaces to a positive multiple of ``FRAME`` and deals packets of
``PACKET`` samples in turn to the streams "left" and "right"; each page carries a checksum, its
packets' lacing values and, as granule position, its stream's samples up to the last packet that ends
in it. ``decode`` verifies every page's checksum, reassembles packets that span pages, demultiplexes
the streams by serial number, checks page order, and derives timestamps from granule positions.

A media file depends on the text alone. Documents are independent rows: nothing is shuffled, and a
worker holds a few megabytes of texts at a time.

Defined results: null and empty text are 192 spaces, with n_bytes 0; a damaged file has its reason in
``error`` and nulls elsewhere; repeated rows and null doc_ids pass through; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.llm.tokens import text_runs
from varlens.session import ship

FRAME = 192
PACKET = 64 * FRAME
RATE = 8000
_HEAD = struct.Struct("<4sBBqIIIB")
_INFO = struct.Struct("<5sBBIQ")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
DECODED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, seconds double, packets long, error string"
)


def page_checksum(*parts: bytes) -> int:
    """Ogg's CRC: polynomial 04c11db7, most significant bit first, from 0, not inverted.

    It is zlib's CRC of the bit-reversed bytes, bit-reversed, without zlib's two inversions.
    """
    crc = 0xFFFFFFFF
    for p in parts:
        crc = zlib.crc32(p.translate(_REVERSED), crc)
    return int(f"{crc ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_checksum(head, body)) + head[26:] + body


def _stream_pages(packets: list[bytes], serial: int, last: int) -> list[bytes]:
    """Data pages of one stream from page 1 on; ``last``: the number of its last packet, -1 if it has none."""
    lacing, ends = bytearray(), {}
    for k, p in enumerate(packets):
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        ends[len(lacing) - 1] = k
    body, at, samples, pages = b"".join(packets), 0, 0, []
    for a in range(0, len(lacing), 255):
        part = bytes(lacing[a : a + 255])
        done = [ends[i] for i in range(a, a + len(part)) if i in ends]
        samples += sum(len(packets[k]) for k in done)
        flags = (1 if a and a - 1 not in ends else 0) | (4 if last in done else 0)
        size = sum(part)
        pages.append(_page(flags, samples if done else -1, serial, len(pages) + 1, part, body[at : at + size]))
        at += size
    return pages


def encode(text: bytes) -> bytes:
    """The media file of a text."""
    payload = text + b" " * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))
    packets = [payload[a : a + PACKET] for a in range(0, len(payload), PACKET)]
    base = zlib.crc32(payload) & 0xFFFFFFFE
    out, streams = [], []
    for side in (0, 1):
        own = packets[side::2]
        info = _INFO.pack(b"\x01PCM8", side, 2, RATE, len(text))
        out.append(_page(2 if own else 6, 0, base + side, 0, bytes([len(info)]), info))
        streams.append(_stream_pages(own, base + side, len(own) - 1))
    for k in range(max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


def pages_of(media: bytes):
    """(flags, granule, serial, number, lacing, body) of each page; ValueError where a page is damaged."""
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError(f"page header cut off at {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = media[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError(f"page cut off at {at}")
        body = media[start:end]
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : start], body) != crc:
            raise ValueError(f"wrong checksum at {at}")
        yield flags, granule, serial, number, lacing, body
        at = end


def demultiplex(media: bytes) -> dict[int, dict]:
    """By serial number: ``packets`` and ``times``, each packet's end in seconds by its page's granule position."""
    streams: dict[int, dict] = {}
    for flags, granule, serial, number, lacing, body in pages_of(media):
        if flags & 2:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = {"packets": [], "times": [], "part": b"", "next": 0, "ended": False, "open": False}
        if (s := streams.get(serial)) is None or s["next"] != number or s["ended"]:
            raise ValueError(f"stream {serial}: page {number} out of order")
        if bool(flags & 1) != s["open"]:
            raise ValueError(f"stream {serial}: page {number} continues wrongly")
        s["next"] += 1
        at, size, first = 0, 0, len(s["packets"])
        for v in lacing:
            size += v
            if v < 255:
                s["packets"].append(s["part"] + body[at : at + size])
                s["part"], at, size = b"", at + size, 0
        s["part"] += body[at:]
        s["open"] = bool(lacing) and lacing[-1] == 255
        if granule >= 0 and number:  # it dates the page's last packet; those before it end their own samples earlier
            ends, left = [], granule
            for p in reversed(s["packets"][first:]):
                ends.append(left / RATE)
                left -= len(p)
            s["times"] += ends[::-1]
        s["ended"] = bool(flags & 4)
    if any(not s["ended"] or s["open"] for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def decode(media: bytes) -> tuple[bytes, int, list[float]]:
    """The padded payload, the text's bytes without padding, and each packet's end in seconds of its stream."""
    sides = {}
    n_bytes = 0
    for s in demultiplex(media).values():
        kind, side, _, _, n_bytes = _INFO.unpack(s["packets"][0])
        if kind != b"\x01PCM8":
            raise ValueError("no 8-bit samples")
        sides[side] = (s["packets"][1:], s["times"])
    count = sum(len(p) for p, _ in sides.values())
    order = [(sides[k % 2][0][k // 2], sides[k % 2][1][k // 2]) for k in range(count)]
    return b"".join(p for p, _ in order), n_bytes, [t for _, t in order]


def describe(payload: bytes) -> str:
    """Features of the samples around their zero line, 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    energy = (x.reshape(-1, FRAME) ** 2).mean(axis=1)
    return f"mean={x.mean():.6f};rms={np.sqrt(energy.mean()):.6f};peak={np.abs(x).max()};crossings={crossings};loudest={int(energy.argmax())};frames={len(energy)}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``, the Ogg bytes of each text."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in text_runs(texts):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "media": pa.array([encode(t) for t in texts[a:b]], pa.binary())})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, a row per media file."""

    def row(doc_id, data):
        if data is None:
            return (doc_id, *[None] * 9, "null")
        try:
            payload, n_bytes, times = decode(data)
        except (ValueError, struct.error, KeyError, IndexError) as e:
            return (doc_id, *[None] * 9, f"{type(e).__name__}: {e}")
        return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(payload), max(times, default=0.0), len(times), None)

    def run(batches):
        names = [c.split()[0] for c in DECODED.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        types = [kinds[c.split()[1]] for c in DECODED.split(", ")]
        for batch in batches:
            rows = [row(i, m) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ship(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(run, DECODED)
