"""Packages in and out: ZIP archives and exploded folders as entries, names resolved tolerantly, entries as archives.

entries: pub_id, path, ord (order in the archive), length (uncompressed), content. The first pass can do without content,
so that lengths are known before anything is inflated.
"""

from __future__ import annotations

import glob
import io
import os
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import paths
from ..functions.types import lit

ENTRIES = "pub_id string, path string, ord int, length long, content binary"
ERRORS = "pub_id string, kind string, message string"
# Image extensions that stand in for one another.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
MIMETYPE = b"application/epub+zip"
#: What a damaged archive can raise.
DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError, OSError)


def read_archives(spark: SparkSession, path: str, glob: str = "*.epub") -> DataFrame:
    """Archives below a folder: pub_id (the path) and content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("pub_id"), "content")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """Exploded packages, one in each folder below root, as entries; lengths are file sizes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cut = F.regexp_extract("path", r"/" + root.strip("/").rsplit("/", 1)[-1] + r"/([^/]+)/(.*)$", 1)
    inner = F.regexp_extract("path", r"/" + root.strip("/").rsplit("/", 1)[-1] + r"/([^/]+)/(.*)$", 2)
    rows = found.select(cut.alias("pub_id"), inner.alias("path"), lit(None).cast("int").alias("ord"), "length", "content")
    return rows.where("pub_id <> '' and path <> ''").where(~paths.escapes_root("path"))


def _open(pub_id: str, content: bytes, names: set[str] | None, data: bool) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i, info in enumerate(z.infolist()):
            if info.is_dir() or (names is not None and info.filename not in names):
                continue
            yield pub_id, info.filename, i, info.file_size, z.read(info) if data else None


def entries(archives: DataFrame, content: bool = True, names: list[str] | None = None) -> DataFrame:
    """Entries of archives (pub_id, content); without content only the directory is read. Archives that can't be read give no rows here and one in unreadable()."""
    schema = pa.schema([("pub_id", pa.string()), ("path", pa.string()), ("ord", pa.int32()), ("length", pa.int64()), ("content", pa.binary())])
    wanted = set(names) if names is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pub, raw in zip(b.column("pub_id"), b.column("content"), strict=True):
                try:
                    rows = list(_open(pub.as_py(), raw.as_py() or b"", wanted, content))
                except DAMAGE:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, schema.types, strict=True)], schema=schema)

    return archives.select(F.col("pub_id").cast("string").alias("pub_id"), "content").mapInArrow(run, ENTRIES)


def unreadable(archives: DataFrame) -> DataFrame:
    """pub_id, kind, message of the archives that entries() can't read."""

    def why(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                z.testzip()
        except DAMAGE as e:
            return str(e) or type(e).__name__
        return None

    checked = archives.select("pub_id", F.udf(why, "string", useArrow=True)("content").alias("message"))
    return checked.where("message is not null").select("pub_id", lit("zip").alias("kind"), "message")


def find_entries(wanted: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """wanted (pub_id and a path) with entry_path: the entry of that name, or else the first in archive order that differs by case, or else by case and an image extension. Equi-joins on derived keys, each only for what the one before left over."""
    names = known.select(F.col("pub_id").alias("p_"), F.col("path").alias("n_"), F.col("ord").alias("o_"))
    keys = lambda c: F.array(
        F.struct(lit(0).alias("tier"), c.alias("key")), F.struct(lit(1).alias("tier"), F.lower(c).alias("key")),
        F.struct(lit(2).alias("tier"), F.when(F.substring_index(F.lower(c), ".", -1).isin(*IMAGE_EXTENSIONS), F.regexp_replace(F.lower(c), r"\.[^./]*$", "")).alias("key")),
    )
    index = names.select("p_", "n_", "o_", F.explode(keys(F.col("n_"))).alias("k")).where("k.key is not null").groupBy("p_", "k").agg(F.min_by("n_", F.struct("o_", "n_")).alias("entry"))
    asked = wanted.select("pub_id", F.col(path).alias("w_")).distinct().select("pub_id", "w_", F.explode(keys(F.col("w_"))).alias("k")).where("k.key is not null")
    best = asked.join(index, (asked.pub_id == index.p_) & (asked.k == index.k)).groupBy(asked.pub_id, "w_").agg(F.min_by("entry", asked.k.tier).alias("entry_path"))
    return wanted.join(best.select(F.col("pub_id").alias("p_"), "w_", "entry_path"), (F.col("pub_id") == F.col("p_")) & (F.col(path) == F.col("w_")), "left").drop("p_", "w_")


def pack(files: list[tuple[str, bytes]]) -> bytes:
    """An archive of files in order; the media type comes first and isn't compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        stamp = (1980, 1, 1, 0, 0, 0)
        z.writestr(zipfile.ZipInfo("mimetype", stamp), MIMETYPE, zipfile.ZIP_STORED)
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, stamp), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _mounted(path: str) -> str:
    """A folder that every machine has mounted; other stores are for read_archives()."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path}: format('epub') needs a mounted folder; read_archives() reads any store")
    return path.rstrip("/")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = _mounted(options["path"]), options.get("content", "true").lower() == "true"

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in sorted(glob.glob(f"{glob.escape(self.path)}/*.epub"))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            raw = f.read()
        try:
            rows = list(_open(unquote(os.path.basename(partition.path).removesuffix(".epub")), raw, None, self.content))
        except DAMAGE:  # as in entries(); unreadable() tells why
            return
        yield from rows


class _Message(WriterCommitMessage):
    def __init__(self, written: list[str]):
        self.written = written


class _Writer(DataSourceArrowWriter):
    """Archives are written beside their place and moved there when all tasks are done; overwriting removes the others."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = _mounted(options["path"]), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        written, attempt = [], TaskContext.get().taskAttemptId()
        for b in batches:
            for pub, raw in zip(b.column("pub_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                if pub is None or raw is None:
                    continue
                name = f"{self.path}/{quote(str(pub), safe=' ')}.epub"
                with open(f"{name}.{attempt}.part", "wb") as f:
                    f.write(raw)
                written.append(f"{name}.{attempt}.part")
        return _Message(written)

    def commit(self, messages: list[_Message | None]) -> None:
        parts = [x for m in messages if m for x in m.written]
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.path)}/*.epub"):
                os.remove(old)
        for x in parts:
            os.replace(x, x.rsplit(".", 2)[0])

    def abort(self, messages: list[_Message | None]) -> None:
        for x in [x for m in messages if m for x in m.written]:
            if os.path.exists(x):
                os.remove(x)


class PackageSource(DataSource):
    """format("epub"): reads a folder of archives, mounted on every machine, as entries; writes rows (pub_id, content) as one archive each, named by the quoted id. Rows without id or content write none, archives that can't be read give no rows. For other stores use read_archives()."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)
