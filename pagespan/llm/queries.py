"""The registered query of each operator: thin digests of what the operator returns, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linetemplates, mixing, nearduplicates, ogg, packing, quality, rules, sharding, warc
from .common import held_out, store, table

SHARDS, SHARD_SEED = 8, 20_240_229


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Ogg samples and read back."""
    media = ogg.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ogg.decode_column(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bad_pages", "lost_packets")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "n_letters")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text; the length in characters is the metadata that goes in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(), meta=("chars",))
    return quality.score(docs, model, meta=("chars",)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard WARC archives, which are stored and read back."""
    archives = store(warc.write(table(spark, sf_dir, "pages")), "archives")
    r = warc.records(archives, payload=False)
    return r.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "error")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the permutation of row numbers in the order of doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard(rows, ["doc_id", "size", "text_crc32"], SHARDS, SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; every window holds each source in its share of all tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id", "source")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every whole text; the host is the source."""
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")


def op9_nearduplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of similarity 0.75."""
    return nearduplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_linetemplates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses by recurring line templates, and the digest of what it keeps."""
    left = linetemplates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit(""))
    return left.select("doc_id", "n_lines", "dropped_lines", "dropped_tokens", F.octet_length(kept).cast("long").alias("kept_bytes"), F.md5(kept.cast("binary")).alias("kept_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg": op1_ogg,
    "op2_langid": op2_langid,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_rules": op7_rules,
    "op8_mixing": op8_mixing,
    "op9_nearduplicates": op9_nearduplicates,
    "op10_linetemplates": op10_linetemplates,
}
