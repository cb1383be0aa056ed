"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; a cluster, whose machines would each write to their own, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own or not os.path.isdir(_own[-1]):
        _own.append(tempfile.mkdtemp(prefix="pagespan-work-"))
        atexit.register(shutil.rmtree, _own[-1], True)
    return _own[-1]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/pagespan-{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the stored table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pagespan_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that store() wrote and that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_pagespan_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
