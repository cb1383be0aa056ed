"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules fail a text with under MIN_WORDS words or with more than MAX_REPEAT percent of its words in repeated 3-word
windows. Then lines (lower case, blanks squeezed; every line that holds a word) are hashed and counted by host: a line in
more than MAX_DOCS distinct documents of a host is removed from all of them. A document that keeps under MIN_LEFT words,
or under half of its words, is depleted and rejected.

A document is a key with a text; rows that repeat both are one document and get the same verdict, rows without a key are
told apart by their texts. With copies=False equal texts of a host are one document whatever their keys, so that copies
alone never make a line frequent. Null texts have no words and fail; empty texts and texts without a word likewise; a null
host is a host of its own; an empty table stays empty. A very long text is one row of arrays as long as its words and
lines, nothing is cut. Further columns pass through, those named as an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, identity, join_hot, small, store, words

MIN_WORDS, MAX_REPEAT, MAX_DOCS, MIN_LEFT = 50, 50, 20, 25
_BLANKS = r"[\x20\x09-\x0D]+"
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_SLOTS = 256


def base(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base counts and base_failed. Repeated windows: sort the windows' hashes with their places (only where any repeats), keep places of equal neighbours, add up the words that they cover."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words_")
    window = lambda i: F.xxhash64(F.get("words_", i), F.get("words_", i + 1), F.get("words_", i + 2))
    same = lambda x, i: (F.get("placed_", i - 1)["h"] == x["h"]) | (F.get("placed_", i + 1)["h"] == x["h"])
    covered = F.aggregate(
        "again_", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    out = (
        df.drop(*OUT)
        .withColumns({"words_": words(F.col(text)), "lines_": lines})
        .withColumn("hashes_", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)))
        .withColumn("placed_", F.when(F.size(F.array_distinct("hashes_")) < F.size("hashes_"), F.sort_array(F.transform("hashes_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("again_", F.sort_array(F.transform(F.filter("placed_", same), lambda x: x["i"])))
    )
    # each interval of three words adds what lies beyond the one before it
    out = out.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join("words_", "")).cast("long"), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"), "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    out = out.drop("words_", "lines_", "hashes_", "placed_", "again_")
    # the last term is always false; as it isn't deterministic, no filter is pushed below, where the counts would be computed once more for each of their uses
    never = F.monotonically_increasing_id() < 0
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")) | never)


def normal(line: Column) -> Column:
    """The line in lower case with single blanks between its words. Most lines have them, which one look tells."""
    return F.lower(F.trim(F.when(line.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(line, _BLANKS, " ")).otherwise(line)))


def _keyed(df: DataFrame, text: str, host: str, key: str, copies: bool) -> DataFrame:
    """df with host_ and id_, the digest that tells documents apart."""
    return df.withColumns({"host_": F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("null")), "id_": identity(text, key, copies)})


def removed_lines(df: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", max_docs: int = MAX_DOCS, copies: bool = True) -> DataFrame:
    """By host_ and id_: lost_ (words in the lines to remove) and gone_ (their hashes). Sums by host, line and document come before any row of a frequent line meets another, and the lines that are removed meet their documents salted."""
    docs = _keyed(df.where(F.col(text).isNotNull()), text, host, key, copies)
    # normalised inside an array, so that neither the hash nor the count repeats the work
    plain = F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")
    lines = F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("w")))
    found = docs.select("host_", "id_", F.explode(lines).alias("x")).groupBy("host_", "x.h", "id_").agg(F.sum("x.w").alias("w"))
    with Scratch() as scratch:
        found = store(found, "lines")
        frequent = found.groupBy("host_", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("host_", "h")
        hit = store(join_hot(found, store(frequent, "frequent"), ["host_", "h"], "id_"), "hit")
        # a document that several rows hold has its lines counted as often
        again = store(docs.groupBy("host_", "id_").agg(F.count("*").alias("rows_")).where("rows_ > 1"), "again")
        gone = hit.groupBy("host_", "id_").agg(F.sum("w").alias("lost_"), F.collect_list("h").alias("gone_")).join(small(again), ["host_", "id_"], "left")
        return scratch.keep(store(gone.select("host_", "id_", (F.col("lost_") / F.coalesce("rows_", F.lit(1))).cast("long").alias("lost_"), "gone_"), "gone"))


def _verdict() -> Column:
    left = F.col("n_words") - F.coalesce(F.col("lost_"), F.lit(0))
    return ~F.col("base_failed") & (left >= MIN_LEFT) & (2 * left >= F.col("n_words"))


def judge(df: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", max_docs: int = MAX_DOCS, copies: bool = True) -> DataFrame:
    """df without its text, with the base counts, words_removed and kept. Only narrow rows meet the removed lines."""
    docs, back = apart(df, key, text, host)
    lost = removed_lines(docs, text, host, key, max_docs, copies).select("host_", "id_", "lost_")
    rows = base(_keyed(docs, text, host, key, copies), text).drop(text)
    out = rows.join(small(lost), ["host_", "id_"], "left").withColumns({"words_removed": F.coalesce("lost_", F.lit(0)), "kept": _verdict()})
    return back(out, [*OUT, "words_removed", "kept"], [text])


def clean(df: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", max_docs: int = MAX_DOCS, copies: bool = True) -> DataFrame:
    """The kept rows of df with the frequent lines removed from their texts; the columns of df."""
    docs, back = apart(df, key, text, host)
    gone = removed_lines(docs, text, host, key, max_docs, copies)
    rows = base(_keyed(docs, text, host, key, copies), text).where("not base_failed")
    out = rows.join(small(gone), ["host_", "id_"], "left").where(_verdict())
    # hashes in slots, so that a look-up reads a short list; made after the join, which carries plain lists
    slots = F.transform(F.sequence(F.lit(0), F.lit(_SLOTS - 1)), lambda b: F.filter("gone_", lambda h: F.pmod(h, F.lit(_SLOTS)) == b))
    out = out.withColumn("slots_", F.when(F.col("gone_").isNotNull(), slots))
    marked = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), F.xxhash64(normal(x)).alias("h")))
    left = F.transform(F.filter(marked, lambda m: ~F.array_contains(F.get("slots_", F.pmod(m["h"], F.lit(_SLOTS)).cast("int")), m["h"])), lambda m: m["x"])
    return back(out.withColumn(text, F.when(F.col("gone_").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))))
