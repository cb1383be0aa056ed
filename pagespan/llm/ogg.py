"""Media columns in Ogg: a writer for 8-bit samples, and a reader that verifies page checksums, reassembles packets
from their lacing values, separates the logical streams and derives times from granule positions.

Nulls and empty texts are stored as one block of pad bytes, very long texts whole. Equal payloads give equal bytes. A page
with a wrong checksum, version or length is left out and counted; a packet that lacks a part is dropped and counted, as
are those of a stream whose header is lost. Streams of another kind are passed over. Bytes that hold no page give an empty
payload, null media nulls. Repeated rows give repeated results, an empty table an empty one; further columns pass through,
those named as an output are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, out_schema

RATE, BLOCK, PACKET, PAD = 8000, 192, 4032, b" "
SERIALS = (0x5041_0001, 0x5041_0002)
_MAGIC = b"PGS8"
_PAGE = struct.Struct("<4sBBqIIIB")
_HEAD = struct.Struct("<4sIBBBxI")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 04C11DB7, most significant bit first, from 0): zlib's runs over reflected bits, so bytes and result are reflected."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def pad(data: bytes, block: int = BLOCK) -> bytes:
    return data + PAD * (max(1, -(-len(data) // block)) * block - len(data))


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


class _Stream:
    """Collects one logical stream's pages as (granule for the order, page)."""

    def __init__(self, serial: int):
        self.serial, self.seq, self.pages = serial, 0, []

    def page(self, segments: bytes, body: bytes, granule: int, flags: int, order: int) -> None:
        head = lambda crc: _PAGE.pack(b"OggS", 0, flags, granule, self.serial, self.seq, crc, len(segments)) + segments
        self.pages.append((order, self.serial, head(page_crc(head(0) + body)) + body))
        self.seq += 1

    def fill(self, packets: list[tuple[bytes, int]]) -> None:
        """Header page made; now pages of up to 255 segments, over which packets may run."""
        segments = b"".join(_lacing(len(p)) for p, _ in packets)
        body = b"".join(p for p, _ in packets)
        ends, at = [], 0
        for p, g in packets:
            at += len(p) // 255 + 1
            ends.append((at, g))
        done = begun = byte = 0
        for a in range(0, len(segments), 255):
            own = segments[a : a + 255]
            n, granule = sum(own), -1
            before = begun
            while done < len(ends) and ends[done][0] <= a + len(own):
                granule, begun = ends[done][1], ends[done][0]
                done += 1
            flags = (1 if a and before != a else 0) | (4 if a + 255 >= len(segments) else 0)
            self.page(own, body[byte : byte + n], granule, flags, granule if granule >= 0 else ends[done][1])
            byte += n


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """payload as 8-bit samples in two logical streams that take the packets in turn; a granule position is the number of samples up to a packet's end."""
    cut = [(payload[a : a + packet], min(a + packet, len(payload))) for a in range(0, len(payload), packet)]
    streams = []
    for i, serial in enumerate(SERIALS):
        s, own = _Stream(serial), cut[i :: len(SERIALS)]
        head = _HEAD.pack(_MAGIC, rate, 1, i, len(SERIALS), packet)
        s.page(_lacing(len(head)), head, 0, 2 | (0 if own else 4), -1)
        if own:
            s.fill(own)
        streams.append(s)
    return b"".join(p for _, _, p in sorted((x for s in streams for x in s.pages), key=lambda x: x[:2]))


def read_pages(media: bytes) -> tuple[list[tuple], int]:
    """(flags, granule, serial, seq, lacing values, body) of each sound page, and how many were not. After a bad page the reader looks for the next capture pattern."""
    out, bad, at = [], 0, media.find(b"OggS")
    bad += at != 0 and len(media) > 0
    while at >= 0 and at < len(media):
        if len(media) - at >= 27 and media[at : at + 4] == b"OggS":
            _, version, flags, granule, serial, seq, crc, n = _PAGE.unpack_from(media, at)
            lacing = media[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(media) and page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == crc:
                out.append((flags, granule, serial, seq, lacing, media[at + 27 + n : end]))
                at = end
                continue
        bad += 1
        at = media.find(b"OggS", at + 1)
    return out, bad


def packets(pages: list[tuple]) -> tuple[dict[int, list[tuple[bytes, int]]], int]:
    """By serial number the packets in order, each with the granule of its page if it is the last that ends there, else -1; and how many were lost."""
    streams: dict[int, dict] = {}
    lost = 0
    for flags, granule, serial, seq, lacing, body in pages:
        s = streams.setdefault(serial, {"parts": [], "open": False, "seq": seq, "out": []})
        if seq != s["seq"] or bool(flags & 1) != s["open"]:
            lost += bool(s["open"])
            s["parts"], s["open"] = (None, True) if flags & 1 else ([], False)
        s["seq"] = seq + 1
        at, last = 0, None
        start = 0
        while start < len(lacing):
            end = start
            while end < len(lacing) and lacing[end] == 255:
                end += 1
            n = 255 * (end - start) + (lacing[end] if end < len(lacing) else 0)
            whole = end < len(lacing)
            if s["parts"] is not None:
                s["parts"].append(body[at : at + n])
            at, start = at + n, end + 1
            if whole:
                if s["parts"] is None:
                    lost += 1
                else:
                    last = len(s["out"])
                    s["out"].append((b"".join(s["parts"]) if len(s["parts"]) > 1 else s["parts"][0], -1))
                s["parts"], s["open"] = [], False
            else:
                s["open"] = True
        if last is not None:
            s["out"][last] = (s["out"][last][0], granule)
    return {k: s["out"] for k, s in streams.items()}, lost + sum(bool(s["open"]) for s in streams.values())


def header(packet: bytes) -> dict | None:
    """What a stream's first packet says; None if it is no header of a sample stream."""
    if len(packet) != _HEAD.size:
        return None
    magic, rate, channels, index, count, size = _HEAD.unpack(packet)
    return {"rate": rate, "channels": channels, "index": index, "count": count, "size": size} if magic == _MAGIC and rate and count else None


def timed(stream: list[tuple[bytes, int]], head: dict) -> list[tuple[int, int, bytes]]:
    """The stream's packets after its header as (first sample, end sample, bytes). The last packet of a page ends at the page's granule; those before it count back, as a stream takes every count-th packet."""
    out, start = [], None
    for data, granule in reversed(stream[1:]):
        if granule >= 0:
            start = granule - len(data)
        elif start is not None:
            start -= head["size"] * head["count"]
        if start is not None:
            out.append((start, start + len(data), data))
    return out[::-1]


def decode(media: bytes) -> dict:
    """payload from the packets of all sample streams in the order of their granule positions, with what the reader found."""
    pages, bad = read_pages(media)
    streams, lost = packets(pages)
    begun = {serial for flags, _, serial, *_ in pages if flags & 2}
    found, rate = [], RATE
    for serial, s in streams.items():
        head = header(s[0][0]) if s and serial in begun else None
        if head:
            rate = head["rate"]
            found += timed(s, head)
        elif serial not in begun:
            lost += len(s)
    found.sort(key=lambda x: x[:2])
    gaps = sum(a[1] != b[0] for a, b in zip(found, found[1:], strict=False))
    return {"payload": b"".join(x[2] for x in found), "pages": len(pages), "bad": bad, "lost": lost, "gaps": gaps, "streams": len(streams), "packets": len(found), "rate": rate, "seconds": found[-1][1] / rate if found else 0.0}


def features(d: dict) -> str:
    """Whole numbers of the samples: time in ms, mean and RMS level in thousandths, peak, sign changes per 1000 samples; then pages, packets and streams."""
    x = np.frombuffer(d["payload"], np.uint8).astype(np.int32) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = int(1000 * (int((x.astype(np.int64) ** 2).sum()) / n) ** 0.5)
    return f"ms={round(1000 * d['seconds'])};mean={1000 * int(x.sum()) // n};rms={rms};peak={int(np.abs(x).max(initial=0))};zc={1000 * crossings // n};pages={d['pages']};packets={d['packets']};streams={d['streams']}"


def encode_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with the Ogg bytes of the text in place of the text, and its length in UTF-8 bytes as n_bytes."""
    ensure_importable(df.sparkSession)
    source = df.select(*[c for c in df.columns if c not in (text, media, "n_bytes")], F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(text))
    schema = out_schema(source.drop(text), n_bytes=T.LongType(), **{media: T.BinaryType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                raw = part.column(text).to_pylist()
                kept = [part.column(n) for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(map(len, raw), pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def decode_column(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """Reads the stored bytes back: digests of the payload and of the bytes, what the reader found, the features; the payload itself if asked for."""
    ensure_importable(df.sparkSession)
    kinds = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "bad_pages": T.IntegerType(), "lost_packets": T.IntegerType()} | ({"payload": T.BinaryType()} if payload else {})
    schema = out_schema(df.drop(media), **kinds)
    source = df.select(*[c for c in df.columns if c == media or c.lower() not in kinds])

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * len(kinds)
        d = decode(m)
        p = d["payload"]
        return (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(d), d["bad"], d["lost"], *([p] if payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b.column(n) for n in b.schema.names if n != media]
            rows = [one(m) for m in b.column(media).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, _arrow(schema, kinds), strict=True))], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def _arrow(schema: T.StructType, kinds: dict) -> list[pa.DataType]:
    of = {T.LongType: pa.int64(), T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}
    return [of[type(k)] for k in kinds.values()]
