"""Every operator and stage on nulls in any column, empty and very long texts, repeated rows, an empty table, and further columns whose names clash with outputs or helpers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagespan.llm import langid, linetemplates, mixing, nearduplicates, ogg, packing, quality, rules, sharding, warc
from pagespan.llm.common import held_out

CLASHES = ["text_", "host_", "words_", "lines_", "hashes_", "placed_", "again_", "gone_", "slots_", "lost_", "name_", "cls_", "bin_", "below_", "whole_", "k", "t", "q", "queue", "v", "c", "d", "h", "n", "line", "leaf", "hash", "at_", "pos", "part", "part_", "n_", "row_number", "shard", "slot", "position_", "size", "target", "times", "taken", "source_size", "kept", "n_words", "score", "predicted", "media", "n_bytes", "payload_bytes", "feature", "component_id", "n_shingles", "salt_", "first_", "payload_", "refers_to", "payload_digest", "y_", "copy_", "m0__"]


def docs(spark, clash=True):
    long = "long words and more of them 12 " * 30_000
    rows = [(1, "one two three four five six\nseven", "en", "a", 5), (1, "one two three four five six\nseven", "en", "a", 5), (2, "", "en", None, 0), (3, None, None, "a", None), (None, "no id here at all", "de", "b", 3), (4, long, "en", "b", 9), (5, "one two three four five six\nseven", None, None, None), (6, "\n\n \n", "en", "a", 1), (7, "\u0000퟿ é 漢字 <|endoftext|>", "fr", "a", 1), (None, None, None, None, None)]
    rows += [(100 + i, f"the line number {i} of the page\nshared line of all the pages here\n" + "w%d " % i * 60, ["en", "de"][i % 2], "a", 7) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]) if clash else df


def pages(df):
    return df.drop("n_chars").withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})


OPERATORS = {
    "ogg": lambda df: ogg.decode_column(ogg.encode_column(df)),
    "langid": lambda df: langid.predict(df, langid.fit(df, ~held_out())),
    "quality": lambda df: quality.score(df, quality.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), ~held_out(), meta=("n_chars",)), meta=("n_chars",)),
    "warc": lambda df: warc.records(warc.write(pages(df))),
    "sharding": lambda df: sharding.shard(df, ["doc_id", "text"], 8, 1),
    "rules": rules.judge,
    "mixing": mixing.mix,
    "nearduplicates": nearduplicates.near_duplicates,
    "linetemplates": linetemplates.drop_templates,
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("clash", [False, True])
def test_operator(spark, name, clash):
    df = docs(spark, clash)
    out = OPERATORS[name](df)
    assert out.count() == df.count()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_results_do_not_depend_on_clashes(spark):
    for name in ("rules", "mixing", "linetemplates", "nearduplicates", "sharding"):
        a, b = OPERATORS[name](docs(spark, False)), OPERATORS[name](docs(spark))
        own = [c for c in a.columns if c in b.columns]
        assert len(own) == len(a.columns)
        key = lambda df: sorted(map(str, df.select(*own).collect()))
        assert key(a) == key(b), name


def test_packing(spark):
    for clash in (False, True):
        df = docs(spark, clash)
        out = packing.pack(df)
        assert out.groupBy("doc_id", "start").count().agg(F.sum("count")).first()[0] == out.count() and out.where("start = 0").count() == df.count()


def test_pipeline(spark):
    for df in (docs(spark), docs(spark, False), docs(spark).limit(0)):
        got = df
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, "")
            if name != "pack_sequences":
                assert got.columns == df.columns
        got.count()
