"""The driver's tables seen as publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.types import lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation a book, each turn a chapter; turns of the system are outside the reading order."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    return c.select(
        F.col("conv_id").alias("pub_id"), F.col("turn").cast("int").alias("spine_index"), F.concat(lit("ch"), turn).alias("idref"), F.concat(lit("text/ch"), turn, lit(".xhtml")).alias("href"),
        (F.col("role") != "system").alias("linear"), F.col("text").alias("body"), F.octet_length("text").cast("long").alias("length"), "role",
    )


def page_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages a book."""
    p = table(spark, sf_dir, "pages")
    at = (F.col("page_id") % 10).cast("int")
    return p.select(F.floor(F.col("page_id") / 10).cast("long").alias("pub_id"), at.alias("spine_index"), F.concat(lit("ch"), at.cast("string")).alias("idref"), F.concat(lit("text/ch"), at.cast("string"), lit(".xhtml")).alias("href"), lit(True).alias("linear"), "html", "page_id", "url")


def doc_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source a book of its documents; German ones have a fixed layout. Numbers within a source come from counts of blocks of ids, so that no source is sorted in one task."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("length"))
    block = F.floor(F.col("doc_id") / 4096)
    before = d.groupBy("source", block.alias("block")).agg(F.count("*").alias("n"))
    before = before.select("source", "block", (F.sum("n").over(W.partitionBy("source").orderBy("block")) - F.col("n")).alias("start"))
    own = d.withColumn("block", block).withColumn("r", F.row_number().over(W.partitionBy("source", "block").orderBy("doc_id")))
    at = (F.col("start") + F.col("r") - 1).cast("int")
    return own.join(before, ["source", "block"]).select(
        F.col("source").alias("pub_id"), at.alias("spine_index"), F.concat(lit("d"), F.col("doc_id").cast("string")).alias("idref"), F.concat(lit("text/d"), F.col("doc_id").cast("string"), lit(".xhtml")).alias("href"),
        lit(True).alias("linear"), "length", F.when(F.col("lang") == "de", "pre-paginated").alias("layout_override"), "lang", "doc_id",
    )


def toc_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and supplier as a tree of three levels: one book, adjacency rows in pre-order."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    href = lambda kind, key: F.concat(lit(f"text/{kind}"), F.col(key).cast("string"), lit(".xhtml"))
    none = lit(None).cast("int")
    rows = (
        r.select("r_regionkey", none.alias("nk"), none.cast("long").alias("sk"), F.col("r_name").alias("title"), href("r", "r_regionkey").alias("href"), lit(0).alias("depth"))
        .unionByName(n.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("nk"), none.cast("long").alias("sk"), F.col("n_name").alias("title"), href("n", "n_nationkey").alias("href"), lit(1).alias("depth")))
        .unionByName(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), F.col("s_nationkey").alias("nk"), F.col("s_suppkey").alias("sk"), F.col("s_name").alias("title"), F.concat(href("n", "s_nationkey"), lit("#s"), F.col("s_suppkey").cast("string")).alias("href"), lit(2).alias("depth")))
    )
    regions = W.partitionBy("r_regionkey").orderBy(F.asc_nulls_first("nk"), F.asc_nulls_first("sk"))
    before = rows.groupBy("r_regionkey").agg(F.count("*").alias("c"))
    start = before.select("r_regionkey", (F.sum("c").over(W.orderBy("r_regionkey")) - F.col("c")).alias("start"))  # a row for each region
    out = rows.withColumn("i", F.row_number().over(regions)).join(F.broadcast(start), "r_regionkey").withColumn("node_id", (F.col("start") + F.col("i") - 1).cast("int"))
    up = out.where("depth < 2").select(F.col("r_regionkey").alias("pr"), F.col("nk").alias("pn"), F.col("depth").alias("pd"), F.col("node_id").alias("parent_id"))
    joined = out.join(up, (F.col("depth") == F.col("pd") + 1) & (F.col("r_regionkey") == F.col("pr")) & ((F.col("pd") == 0) | (F.col("nk") == F.col("pn"))), "left")
    return joined.select(lit(1).alias("pub_id"), lit("toc").alias("list"), "node_id", "parent_id", "depth", F.col("node_id").alias("pre_order"), "title", "href")
