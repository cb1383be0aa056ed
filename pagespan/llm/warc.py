"""WARC archives in Zstandard: one frame for each record after a leading skippable frame that holds the dictionary, and a
reader that loads that dictionary, decodes frame by frame and validates headers, lengths and digests.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest key is a response and the others
are revisits that refer to it; smaller payloads are responses. Null payloads are empty, very long ones make a record and
an archive of their own. A record that fails validation, a dictionary that can't be loaded, a frame that is damaged or cut
off and a null archive come back as a row with an error and null fields; the reader goes on with the next frame. Skippable
frames between records are passed over. Keys should be unique: rows that repeat the smallest key with the same payload
are all responses, as are rows without a key. Columns but for key, uri and payload are not written. An empty table gives
no archives.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, apart, ensure_importable, is_small, store

MIN_REVISIT = 100
#: Magic number of the skippable frame that carries a dictionary, as the zstd variant of WARC has it.
DICT_FRAME = 0x184D2A5D
#: Magic numbers of skippable frames, that one among them.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: Bound of the dictionary's training: so many whole payloads, the first by a hash of the key, and so many bytes in all; a payload that does not fit is passed over.
SAMPLE, SAMPLE_BYTES, DICT_BYTES, SEED = 200, 4 << 20, 32_768, 41
#: An archive holds about so many payload bytes; one record may be larger.
ARCHIVE_BYTES, LEVEL = 8 << 20, 3
_CRLF = b"\r\n"


def record(key: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC record: an HTTP response, or a revisit that holds only the HTTP headers of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{key}>", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def lead(dictionary: bytes) -> bytes:
    """The skippable frame with the dictionary; nothing without one."""
    return struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary if dictionary else b""


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("header without a colon")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def parse(raw: bytes) -> dict:
    """A decoded frame as a record; ValueError where headers, lengths or the digest are wrong."""
    head, gap, rest = raw.partition(_CRLF * 2)
    first, *lines = head.split(_CRLF)
    if not gap or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    h = _headers(lines)
    kind, n = h.get("warc-type"), h.get("content-length", "")
    if kind not in ("response", "revisit") or not h.get("warc-record-id", "").startswith("<urn:record:"):
        raise ValueError("type or id missing")
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != _CRLF * 2:
        raise ValueError("length of the record is wrong")
    block = rest[:-4]
    http, gap, payload = block.partition(_CRLF * 2)
    status, *lines = http.split(_CRLF)
    own = _headers(lines)
    if not gap or not status.startswith(b"HTTP/") or not own.get("content-length", "").isdigit():
        raise ValueError("no HTTP header")
    size, digest = int(own["content-length"]), h.get("warc-payload-digest", "").removeprefix("sha256:")
    refers = h.get("warc-refers-to", "").removeprefix("<urn:record:").removesuffix(">") or None
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("length or digest of the payload is wrong")
    if kind == "revisit" and (payload or refers is None):
        raise ValueError("revisit with a payload, or without the record it refers to")
    return {"key": h["warc-record-id"][12:-1], "uri": h.get("warc-target-uri"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": refers}


def _skippable(archive: bytes, at: int) -> tuple[int, bytes] | None:
    """Magic number and content of the skippable frame there, if one begins there; ValueError if it is cut off."""
    if len(archive) - at < 4 or (magic := struct.unpack_from("<I", archive, at)[0]) not in SKIPPABLE:
        return None
    if len(archive) - at < 8 or len(archive) - at - 8 < (n := struct.unpack_from("<I", archive, at + 4)[0]):
        raise ValueError("the skippable frame is cut off")
    return magic, archive[at + 8 : at + 8 + n]


def read(archive: bytes | None) -> Iterator[dict]:
    """The records of an archive, one of each frame; what can't be decoded or parsed gives {"error": ...}."""
    if archive is None:
        yield {"error": "no content"}
        return
    at, opener = 0, zstd.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        try:
            if skipped := _skippable(archive, at):
                begin, at = at, at + 8 + len(skipped[1])
                if skipped[0] == DICT_FRAME and begin == 0:
                    raw = skipped[1]
                    opener = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(opener.decompress(raw) if raw[:4] == zstd.FRAME_HEADER else raw))
                continue
            one = opener.decompressobj()
            out = one.decompress(view[at:])
            if not one.eof:
                raise ValueError("the frame is cut off")
            at = len(archive) - len(one.unused_data)
        except (zstd.ZstdError, ValueError) as e:
            yield {"error": str(e)}
            at = archive.find(zstd.FRAME_HEADER, at + 4 if archive[at : at + 4] == zstd.FRAME_HEADER else at)
            if at < 0:
                return
            continue
        try:
            yield parse(out)
        except ValueError as e:
            yield {"error": str(e)}


def decide(df: DataFrame, key: str, payload: str) -> DataFrame:
    """df with payload_ (bytes), payload_bytes, payload_digest and refers_to (null: a response). Digests are counted with partial sums; those that repeat are broadcast, so that payloads stay where they are, or if they are many, joined salted."""
    pages, back = apart(df, key, payload)
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8") if dict(df.dtypes)[payload] != "binary" else F.coalesce(F.col(payload), F.lit(b""))
    known = pages.withColumn("payload_", raw).withColumns({"payload_bytes": F.octet_length("payload_").cast("long"), "payload_digest": F.sha2("payload_", 256)})
    seen = known.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min(key).alias("first_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    seen = store(seen, "digests")
    if is_small(seen):
        out = known.join(F.broadcast(seen), "payload_digest", "left")
    else:
        salted = seen.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = known.withColumn("salt_", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt_"], "left")
    out = out.withColumn("refers_to", F.when((F.col("payload_bytes") >= MIN_REVISIT) & (F.col(key) != F.col("first_")), F.col("first_")))
    return back(out, ["payload_", "payload_bytes", "payload_digest", "refers_to"])


def train_dictionary(df: DataFrame, key: str, payload: str) -> bytes:
    """From a bounded sample of payloads, the same however df is partitioned; empty if there are too few."""
    raw = F.col(payload).cast("binary")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(F.xxhash64(name, F.lit(SEED)).alias("draw"), F.octet_length(raw).alias("n"), raw.alias("t")).where("n > 0")
    drawn, held = [], 0
    for r in rows.select("draw", "n").distinct().orderBy("draw", "n").limit(SAMPLE).collect():
        if held + r["n"] <= SAMPLE_BYTES:
            drawn.append(r["draw"])
            held += r["n"]
    one = rows.where(F.col("draw").isin(drawn) & (F.col("n") <= SAMPLE_BYTES)).groupBy("draw").agg(F.min(F.struct("n", "t")).alias("x")) if drawn else None
    texts = [bytes(r["x"]["t"]) for r in one.orderBy("draw").collect()] if drawn else []
    if len(texts) < 16:
        return b""
    try:
        return zstd.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstd.ZstdError:  # too little in them
        return b""


def write(df: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", dictionary: bytes | None = None) -> DataFrame:
    """Archives as rows (archive string, content binary), one or more for each partition of df. Each holds about ARCHIVE_BYTES of payload."""
    ensure_importable(df.sparkSession)
    known = train_dictionary(df, key, payload) if dictionary is None else dictionary
    rows = decide(df.select(*dict.fromkeys([key, uri, payload])), key, payload).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("u"),
        F.when(F.col("refers_to").isNull(), F.col("payload_")).alias("p"), "payload_digest", "payload_bytes", F.col("refers_to").cast("string").alias("r"), F.spark_partition_id().alias("part"),
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(known)) if known else zstd.ZstdCompressor(level=LEVEL)
        frames, held, n, name = [lead(known)], 0, 0, ""
        for part in parts:
            for k, u, p, digest, size, r, of in part.itertuples(index=False):
                name = f"part-{of:06d}-{n:05d}.warc.zst"
                frames.append(made.compress(record(k, u.replace("\r", " ").replace("\n", " "), p or b"", digest, size, r)))
                held += len(p or b"")
                if held >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [name], "content": [b"".join(frames)]})
                    frames, held, n = [lead(known)], 0, n + 1
        if len(frames) > 1:
            yield pd.DataFrame({"archive": [name], "content": [b"".join(frames)]})

    return rows.mapInPandas(run, "archive string, content binary")


SCHEMA = "archive string, key string, uri string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, error string"


def records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives (archive, content); also of files that spark.read.format("binaryFile") found, with their path as archive. Without payload that column is null, after its validation."""
    ensure_importable(archives.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    source = archives.select(F.col("archive" if "archive" in archives.columns else "path").alias("archive"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in part.itertuples(index=False):
                rows = []
                for r in read(content):
                    rows.append([name, *(r.get(c) if c != "payload" or payload else None for c in names[1:])])
                    if len(rows) >= 500:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    return source.mapInPandas(run, SCHEMA)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
