"""New packages and chapters as a stream. The operators that read one package or chapter at a time keep no state, so a
stream needs no watermark; only dropping packages that come again does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.positions import PAGE, position_count
from ..sources.packages import entries
from ..storage import fresh_path


def stream_archives(spark: SparkSession, folder: str, glob: str = "*.epub") -> DataFrame:
    """Archives as they arrive in a folder: pub_id, arrived, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.col("path").alias("pub_id"), F.col("modificationTime").alias("arrived"), "content")


def once(archives: DataFrame, delay: str = "1 day") -> DataFrame:
    """Archives whose bytes haven't come before within the delay."""
    keyed = archives.withColumn("digest", F.sha2("content", 256)).withWatermark("arrived", delay)
    return keyed.dropDuplicatesWithinWatermark(["digest"]).drop("digest")


def stream_entries(archives: DataFrame, content: bool = True) -> DataFrame:
    return entries(archives, content)


def chapter_counts(chapters: DataFrame, page: int = PAGE) -> DataFrame:
    """Position counts of chapters (pub_id, spine_index, linear, length), batch or stream."""
    return chapters.where("linear").select("pub_id", "spine_index", position_count("length", page).alias("n"))


def run_available(spark: SparkSession, schema: T.StructType, path: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f over all that is at path now, as a stream that stops when it has read it; the result is the sink's table. A pattern lets single files be a source too."""
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    out, at = f(source), fresh_path(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
