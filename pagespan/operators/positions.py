"""Reading positions: virtual pages of a publication by entry length, and look-ups between coordinates, positions and
progressions. Sums run over blocks of the spine first and inside each block then, so that no publication, however long, is
sorted in one task; look-ups are equi-joins and arithmetic.

Inputs: spine(pub_id, spine_index, idref, linear, layout_override), manifest(pub_id, id, href), lengths by pub and href.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.types import lit, string

PAGE = 1024
#: Spine items whose positions are summed up in one task.
BLOCK = 4096


def position_count(length: Column | str, page: int = PAGE) -> Column:
    """At least 1; a page length under 1 counts as 1."""
    n = string(length).cast("long")
    return F.greatest(F.floor((n + (max(1, page) - 1)) / max(1, page)), lit(1)).cast("long")


def effective_length(original: Column | str, entry: Column | str) -> Column:
    """The length before encryption, or else that of the entry, or 0."""
    return F.coalesce(string(original), string(entry), lit(0)).cast("long")


def is_fixed(layout_override: Column | str, layout: Column | str) -> Column:
    return F.coalesce(string(layout_override), string(layout), lit("reflowable")) == "pre-paginated"


def positions(chapters: DataFrame, page: int = PAGE) -> DataFrame:
    """chapters: pub_id, spine_index, idref, href, linear, length and, if there, layout_override, layout, title.

    Positions of the linear chapters in reading order: pub_id, spine_index, href, cfi, global_position (from 1), chapter_progression, total_progression, title. A page of 0 is the default; spine_index counts all of the spine.
    """
    page = page or PAGE
    has = set(chapters.columns)
    col = lambda name: F.col(name) if name in has else lit(None).cast("string")
    n = F.when(is_fixed(col("layout_override"), col("layout")), lit(1).cast("long")).otherwise(position_count("length", page))
    counted = chapters.where("linear").select("pub_id", "spine_index", "idref", "href", col("title").alias("title"), n.alias("n"))
    counted = counted.withColumn("block", F.floor(F.col("spine_index") / BLOCK))
    sums = counted.groupBy("pub_id", "block").agg(F.sum("n").alias("n"))
    run = F.coalesce(F.sum("n").over(W.partitionBy("pub_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), lit(0))
    sums = sums.select("pub_id", "block", run.alias("start"), F.sum("n").over(W.partitionBy("pub_id")).alias("total"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("pub_id", "block").orderBy("spine_index").rowsBetween(W.unboundedPreceding, -1)), lit(0))
    placed = counted.withColumn("inside", inside).join(sums, ["pub_id", "block"]).withColumn("before", F.col("start") + F.col("inside"))
    each = placed.withColumn("p", F.explode(F.sequence(lit(0).cast("long"), F.col("n") - 1)))
    share = lambda a, b: (a.cast("double") / b.cast("double")).cast("float")
    base = F.concat(lit("epubcfi(/6/"), ((F.col("spine_index") + 1) * 2).cast("string"), lit("["), F.col("idref"), lit("]!/4"))
    return each.select(
        "pub_id", "spine_index", "href",
        F.concat(base, F.when(F.col("p") > 0, F.concat(lit("/"), (F.col("p") * 2).cast("string"))).otherwise(lit("")), lit(")")).alias("cfi"),
        (F.col("before") + F.col("p") + 1).alias("global_position"),
        F.when(F.col("n") > 1, share(F.col("p"), F.col("n"))).otherwise(lit(0.0).cast("float")).alias("chapter_progression"),
        share(F.col("before") + F.col("p"), F.col("total")).alias("total_progression"), "title",
    )


def position_index(found: DataFrame) -> DataFrame:
    """pub_id, spine_index, start (positions before the chapter), n: what look-ups need of the positions."""
    return found.groupBy("pub_id", "spine_index").agg((F.min("global_position") - 1).alias("start"), F.count("*").alias("n"))


def locate(cfis: DataFrame, index: DataFrame, cfi: str = "cfi") -> DataFrame:
    """cfis (pub_id and a coordinate as text) with location: the 0-based position that holds it. A range's parent counts; null for chapters without positions and for text that is no coordinate. The place in a chapter is its first content step below the body, clamped."""
    parent = F.regexp_extract(F.trim(cfi), r"^epubcfi\(([^,]*?)[,)]", 1)
    step = F.regexp_extract(parent, r"^/\d+(?:\[[^\]]*\])?/(\d+)", 1).try_cast("long")
    inner = F.regexp_extract(parent, r"!/\d+(?:\[[^\]]*\])?/(\d+)", 1).try_cast("long")
    keyed = cfis.withColumns({"s_": F.when(step >= 2, F.floor(step / 2) - 1), "c_": F.coalesce(F.floor(inner / 2), lit(0))})
    own = index.select(F.col("pub_id").alias("p_"), F.col("spine_index").cast("long").alias("i_"), "start", "n")
    joined = keyed.join(own, (F.col("pub_id") == F.col("p_")) & (F.col("s_") == F.col("i_")), "left")
    return joined.withColumn("location", F.col("start") + F.least("c_", F.col("n") - 1)).drop("p_", "i_", "s_", "c_", "start", "n")


def position_at(locations: DataFrame, found: DataFrame, location: str = "location") -> DataFrame:
    """locations (pub_id and a 0-based position) with the position's row; none outside."""
    own = found.withColumn("at_", F.col("global_position") - 1).withColumnRenamed("pub_id", "p_")
    return locations.join(own, (F.col("pub_id") == F.col("p_")) & (F.col(location) == F.col("at_")), "left").drop("p_", "at_")


def location_of_progression(progression: Column | str, n: Column | str) -> Column:
    """The 0-based position at a share of the publication, in single precision; null without positions."""
    count = string(n)
    p = F.greatest(F.least(string(progression).cast("float"), lit(1.0).cast("float")), lit(0.0).cast("float"))
    return F.when(count > 0, F.least((p * count.cast("float")).cast("float").cast("long"), count - 1))


def missing_items(spine: DataFrame, items: DataFrame) -> DataFrame:
    """pub_id, kind, message of linear spine items without a manifest item: strict reading refuses such a publication, lenient reading leaves the item out."""
    lost = spine.where("linear").join(items.select("pub_id", F.col("id").alias("idref")), ["pub_id", "idref"], "left_anti")
    return lost.select("pub_id", lit("invalid_format").alias("kind"), F.concat(lit("spine item without a manifest item: "), "idref").alias("message"))


def strict(spine: DataFrame, items: DataFrame) -> DataFrame:
    """The spine without the publications that missing_items() names."""
    return spine.join(missing_items(spine, items).select("pub_id").distinct(), "pub_id", "left_anti")
