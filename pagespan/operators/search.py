"""Search and corpus measures over chapters(pub_id, spine_index, idref, linear, html)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.coords import spine_base
from ..functions.types import lit
from .html import html_search

PER_CHAPTER, TOTAL = 12, 80


def search_chapters(chapters: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Every match of a regular expression: pub_id, spine_index, manifest_id, hit_ord, excerpt, cfi."""
    found = chapters.select("pub_id", "spine_index", F.col("idref").alias("manifest_id"), F.posexplode(html_search("html", spine_base("spine_index", "idref"), lit(pattern), lit(ignore_case))).alias("hit_ord", "hit"))
    return found.select("pub_id", "spine_index", "manifest_id", "hit_ord", "hit.excerpt", "hit.cfi")


def search_literal(chapters: DataFrame, text: str) -> DataFrame:
    """Every place of a text as it is written, case and all; an empty text is nowhere."""
    return search_chapters(chapters if text else chapters.limit(0), re.escape(text))


def search_books(chapters: DataFrame, query: str, per_chapter: int = PER_CHAPTER, total: int = TOTAL, case_insensitive: bool = True, include_non_linear: bool = False) -> DataFrame:
    """Literal search with limits: the first hits of each chapter and then of each publication, in spine order. 0 is the default limit; a blank query finds nothing."""
    wanted = query.strip()
    read = chapters if include_non_linear else chapters.where("linear")
    hits = search_chapters(read.where(F.col("html").isNotNull()) if wanted else read.limit(0), re.escape(wanted), case_insensitive)
    kept = hits.where(F.col("hit_ord") < (per_chapter or PER_CHAPTER))
    rank = F.row_number().over(W.partitionBy("pub_id").orderBy("spine_index", "hit_ord"))
    return kept.withColumn("rank_", rank).where(F.col("rank_") <= (total or TOTAL)).drop("rank_")


def media_type_histogram(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("pub_id", "media_type").agg(F.count("*").alias("n"))


def corpus_audit(outcomes: DataFrame) -> DataFrame:
    """outcomes(pub_id, outcome in ok, retry, fail): counts and usable percentage for each publication and, with pub_id null, for all."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    sums = outcomes.rollup("pub_id").agg(n("ok"), n("retry"), n("fail"), F.count("*").alias("chapters"), F.grouping("pub_id").cast("int").alias("is_total"))
    return sums.withColumn("usable_pct", F.round(100.0 * (F.col("ok") + F.col("retry")) / F.col("chapters"), 2))
