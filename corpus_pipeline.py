"""From documents to packed training sequences: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes all that the one before it kept; run() writes every stage's result as Parquet in the shared folder and
reads it back for the next.

Nulls in any column, empty and very long texts, repeated rows, ties and clashing names are handled as the stages' operators
say in their modules: a document without text fails the rules; rows without a doc_id are told apart by their texts and are
kept by near_dedup; copies that repeat a doc_id stand for one document. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagespan.llm import linetemplates, mixing, nearduplicates, packing, rules
from pagespan.llm.common import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many documents of their source share. Depleted ones go."""
    return rules.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; the first document of each template keeps its lines, one that has none left goes."""
    return linetemplates.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Documents without words have no duplicates."""
    return nearduplicates.dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or up to three times, as whole rows."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids; every row is packed as often as it comes."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("pack_sequences", pack_sequences)]

#: Tokens have no SQL form; every stage before them is tested against a plain version, on what the stage before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
