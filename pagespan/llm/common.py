"""What the operators of this subpackage share: stored tables, code shipping, words."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import storage
from ..storage import forget

#: One word, as a Java and Python regular expression: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest side, in rows, that an operator broadcasts after counting it; above it the join shuffles.
BROADCAST_ROWS = 500_000
#: And in bytes of its values; a session whose driver or executors have less memory to spare may set less.
BROADCAST_BYTES = 64 << 20
#: A stored table of at most so many rows and bytes is read by one task.
FEW_ROWS, FEW_BYTES = 100_000, 32 << 20
#: Files into which the tables of few texts go, and the bytes of text up to which they are few.
FEW_FILES, FEW_TEXT = 8, 64 << 20
#: Parts into which join_hot() cuts the rows of each key.
SALTS = 32

#: Limits of an Arrow batch that goes to Python, where the session allows more: texts may be long, and workers have little memory.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20

_ROOT = str(Path(__file__).resolve().parents[2])


def ensure_importable(spark: SparkSession) -> None:
    """Ship this package to the Python workers unless their path has it anyway, and keep their batches small: texts may be long. The session's batches stay that small, as the returned plans run later."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT in map(os.path.abspath, filter(None, paths)) or getattr(spark.sparkContext, "_pagespan_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="pagespan-code-")  # the driver's own; addPyFile sends the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/pagespan_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(Path(_ROOT, "pagespan").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(archive)
    if archive in sys.path:
        sys.path.remove(archive)
    spark.sparkContext._pagespan_sent = True


class Scratch:
    """Tables stored inside a with block go when it ends, but for those that keep() names; what is read of them must be stored by then."""

    open_: ClassVar[list[list[DataFrame]]] = []

    def __enter__(self) -> Scratch:
        self.open_.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves the table to an enclosing block, if there is one."""
        self.open_[-1] = [x for x in self.open_[-1] if x is not df]
        if len(self.open_) > 1:
            self.open_[-2].append(df)
        return df

    def __exit__(self, *error: object) -> None:
        for df in self.open_.pop():
            forget(df)


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors. Belongs to the innermost Scratch block."""
    out = storage.store(df, name)
    if Scratch.open_:
        Scratch.open_[-1].append(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def out_schema(df: DataFrame, **more: T.DataType) -> T.StructType:
    """df's schema with further columns; a column of the same name is replaced."""
    kept = [f for f in df.schema.fields if f.name.lower() not in {m.lower() for m in more}]
    return T.StructType([*kept, *(T.StructField(k, v) for k, v in more.items())])


def add_columns(df: DataFrame, inputs: list[str], more: dict[str, T.DataType], make: Callable[[], Callable[..., tuple]], keep: bool = False) -> DataFrame:
    """df with further columns that Python computes row by row: make() gives, once for each task, the function from the inputs' values to a tuple. The other columns stay in Arrow as they are; the inputs are dropped unless keep."""
    ensure_importable(df.sparkSession)
    taken = {m.lower() for m in more}
    source = df.select(*[c for c in df.columns if c in inputs or c.lower() not in taken])
    schema = out_schema(source if keep else source.drop(*inputs), **more)
    kinds = [to_arrow_type(t) for t in more.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                rows = [f(*x) for x in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                kept = [part.column(n) for n in part.schema.names if (keep or n not in inputs) and n.lower() not in taken]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return source.mapInArrow(run, schema)


def apart(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df's needed columns with the others as one struct, so that no name inside an operator meets theirs; and what puts them back: back(result, made, drop) has df's columns but for those dropped or made anew, then those made."""
    rest = [c for c in df.columns if c not in needed]
    packed = df.select(*dict.fromkeys(needed), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest")] if rest else []))

    def back(out: DataFrame, made: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
        gone = {m.lower() for m in [*made, *drop]}
        return out.select(*[F.col("__rest").getField(c).alias(c) if c in rest else F.col(c) for c in df.columns if c.lower() not in gone], *made)

    return packed, back


def identity(text: str, key: str, copies: bool = True) -> Column:
    """The digest that tells documents apart: of key and text, or without copies of the text alone; null where the text is."""
    own = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.col(text)) if copies else F.col(text)
    return F.unhex(F.md5(own.cast("binary")))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows that training must not see: crc32 of the id as text, mod 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text as an array, empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + WORD + ")"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _value_bytes(f: T.StructField) -> Column:
    """About how many bytes a value takes."""
    c, kind = F.col(f"`{f.name}`"), f.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return 8 * F.greatest(F.size(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, held: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; no more rows than that are read."""
    size = sum((_value_bytes(f) for f in df.schema.fields), F.lit(16)).cast("long")
    n, b = df.select(size.alias("b")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and b <= held


def small(df: DataFrame, rows: int = BROADCAST_ROWS, held: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is: the join then shuffles."""
    return F.broadcast(df) if is_small(df, rows, held) else df


def together(df: DataFrame) -> DataFrame:
    """df, a stored table, in one partition if it is so small that one task can take it: what follows then needs no shuffle and writes one file, not one for each partition. For a local folder Hadoop starts processes for every file, each of which shares the executor's memory for a moment."""
    return df.coalesce(1) if is_small(df, FEW_ROWS, FEW_BYTES) else df


def writer(df: DataFrame, text: str) -> Callable[[DataFrame, str], DataFrame]:
    """store() for what is made of df's texts: few texts' tables go into few files, however many partitions a shuffle has; see together() for why. Only the last step of what makes a table is done by so few tasks."""
    few = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) <= FEW_TEXT
    return lambda made, name: store(made.coalesce(FEW_FILES) if few else made, name)


def join_hot(big: DataFrame, side: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Inner join where a key may hold a great part of big and one row of side: broadcast, or else salted by the column spread."""
    if is_small(side):
        return big.join(F.broadcast(side), on)
    salted = side.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt_"]).drop("salt_")
