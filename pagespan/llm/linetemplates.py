"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line goes down the tree by its token count and its first LEADING tokens (all, if it has fewer); a token with a digit is
a variable field and reads as `<*>` everywhere. In a leaf the distinct lines gather round leaders: the line that occurs
most (of equals the last by code points) leads a template, and lines that agree with it in MATCH percent of the tokens
join it; the rest gather round the next leader, until no line of the leaf is left. A round tries several leaders at once,
twice as many as the round before (at most BATCH): the first lines by that order, less those that an earlier one of them
takes. A template that stands in MIN_DOCS distinct documents recurs; its lines are dropped from all of them but the one
with the smallest key (a document without a key comes before the others).

A document is a key with a text; rows that repeat both are one document and lose the same lines, rows without a key are
told apart by their texts. With copies=False equal texts are one document whatever their keys. Null texts have no lines,
lines without a token are never dropped; an empty table stays empty. A very long text is one row of arrays as long as its
lines, nothing is cut. Further columns pass through, those named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, apart, identity, join_hot, small, writer

LEADING, MATCH, MIN_DOCS = 4, 70, 3
#: Most leaders of a leaf that a round tries.
BATCH = 512
VARIABLE = "<*>"
_BLANKS = r"[\x20\x09-\x0D]+"


def masked(line: Column) -> Column:
    """The line's tokens with one blank between them, variable fields masked. Most lines need no change, which a look for single characters and three for blanks tell; one pattern for all four takes several times as long."""
    squeezed = F.trim(F.regexp_replace(line, _BLANKS, " "))
    odd = line.rlike(r"[0-9\x09-\x0D]") | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.regexp_replace(squeezed, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(line)


def _tokens(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def lines_of(df: DataFrame, text: str, key: str, copies: bool) -> DataFrame:
    """d, id_, pos, line (masked), n (tokens), leaf, of lines with a token. Lines are masked and counted inside the array, so that no filter above repeats the work; the digest is a column of its own below, as beside posexplode() it would be computed for every line anew."""
    lines = F.transform(F.transform(F.split("text_", "\n"), masked), lambda x: F.struct(x.alias("line"), _tokens(x).alias("n")))
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("d"), identity(text, key, copies).alias("id_"), F.col(text).alias("text_"))
    rows = texts.select("d", "id_", F.posexplode(lines).alias("pos", "x"))
    rows = rows.where(F.col("x.n") > 0).select("d", "id_", "pos", "x.line", "x.n")
    return rows.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", LEADING)))


def _agree(x: Column, y: Column) -> Column:
    """Percent of the places at which two lines' tokens are the same."""
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return 100 * same / F.size(x)


def _leaders(left: DataFrame, most: int) -> DataFrame:
    """By leaf its next leaders in their order (leaders: hash, w), out of the first lines that are left. The limit holds in each task before a leaf's lines meet."""
    first = left.withColumn("r_", F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("docs"), F.desc("line")))).where(F.col("r_") <= most)
    tried = first.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("r_", "hash", "line"))).alias("x"))
    tried = tried.select("leaf", F.transform("x", lambda v: F.struct(v["hash"].alias("hash"), F.split(v["line"], " ").alias("w"))).alias("x"))
    lead = F.aggregate(F.slice("x", 2, most), F.slice("x", 1, 1), lambda got, v: F.when(F.exists(got, lambda g: _agree(g["w"], v["w"]) >= MATCH), got).otherwise(F.concat(got, F.array(v))))
    return tried.select("leaf", lead.alias("leaders"))


def templates(df: DataFrame, store: Callable[[DataFrame, str], DataFrame], text: str = "text", key: str = "doc_id", copies: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines of leaves that several documents reach (d, id_, pos, n, hash, one: the leaf has that line only), and the template of each line's hash in the other leaves (hash, template); both stored by store. A leaf's hot lines are counted with partial sums before they meet. Lines and leaders always meet by a shuffle, so that the plan is the same at every size."""
    lines = lines_of(df, text, key, copies).withColumn("hash", F.xxhash64("leaf", "line"))
    mark = F.xxhash64("id_")
    leaves = lines.groupBy("leaf").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.min("hash").alias("first"), F.max("hash").alias("last"))
    leaves = store(leaves.where("lo <> hi").select("leaf", (F.col("first") == F.col("last")).alias("one")), "leaves")
    met = lines.join(small(leaves), "leaf")
    met = store(met.select("leaf", "d", "id_", "pos", "n", "hash", "one", F.when(~F.col("one"), F.col("line")).alias("line")), "lines")
    classes = met.where("not one").groupBy("leaf", "hash").agg(F.count("*").alias("docs"), F.first("line").alias("line"))
    left, found, most = store(classes, "classes"), [], 1
    while not found or left.limit(1).count():
        # the line is split inside an array, once for all leaders
        takes = F.flatten(F.transform(F.array(F.split("line", " ")), lambda w: F.filter("leaders", lambda x: _agree(x["w"], w) >= MATCH)))
        tried = left.join(_leaders(left, most).hint("merge"), "leaf").withColumn("template", F.get(takes, F.lit(0))["hash"]).drop("leaders")
        tried = store(tried, "tried")
        found.append(tried.where("template is not null").select("hash", "template"))
        left, most = tried.where("template is null").drop("template"), min(2 * most, BATCH)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return met.drop("line", "leaf"), out


def dropped(df: DataFrame, text: str = "text", key: str = "doc_id", copies: bool = True) -> DataFrame:
    """By id_: the places of the lines to drop (at_) and their tokens (lost_). A template that a great part of the lines has is counted by document before it is counted, and meets its lines salted."""
    with Scratch() as scratch:
        store = writer(df, text)
        met, of = templates(df, store, text, key, copies)
        alone = met.where("one").select(F.col("hash").alias("template"), "id_", "pos", "d", "n")
        placed = store(met.where("not one").join(of.hint("merge"), "hash").select("template", "id_", "pos", "d", "n").unionByName(alone), "placed")
        by_text = placed.groupBy("template", "id_").agg(F.min("d").alias("d"))
        recurs = by_text.groupBy("template").agg(F.count("*").alias("docs"), F.min_by("id_", F.struct("d", "id_")).alias("first_")).where(F.col("docs") >= MIN_DOCS)
        gone = join_hot(placed, store(recurs.select("template", "first_"), "recurring"), ["template"], "id_").where(F.col("id_") != F.col("first_"))
        at = gone.groupBy("id_").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("x"))
        return scratch.keep(store(at.select("id_", F.col("x.pos").alias("at_"), F.aggregate("x.n", F.lit(0).cast("long"), lambda s, n: s + n).alias("lost_")), "gone"))


def _kept_lines() -> Column:
    """The lines_ whose places aren't in at_: as that is sorted, they are the slices between its places."""
    after = lambda i: F.coalesce(F.get("at_", i - 1) + 1, F.lit(0))
    return F.flatten(F.transform(F.concat("at_", F.array(F.size("lines_"))), lambda p, i: F.slice("lines_", after(i) + 1, p - after(i))))


def drop_templates(df: DataFrame, text: str = "text", key: str = "doc_id", copies: bool = True) -> DataFrame:
    """df with the recurring lines dropped from its texts, n_lines (before), dropped_lines and dropped_tokens."""
    docs, back = apart(df, key, text)
    gone = dropped(docs, text, key, copies)
    rows = docs.withColumns({"id_": identity(text, key, copies), "lines_": F.split(text, "\n")})
    out = rows.join(small(gone), "id_", "left").withColumns({
        text: F.when(F.col("at_").isNull(), F.col(text)).otherwise(F.array_join(_kept_lines(), "\n")), "n_lines": F.coalesce(F.size("lines_"), F.lit(0)),
        "dropped_lines": F.coalesce(F.size("at_"), F.lit(0)), "dropped_tokens": F.coalesce("lost_", F.lit(0)).cast("long"),
    })
    return back(out, ["n_lines", "dropped_lines", "dropped_tokens"])


def clean(df: DataFrame, text: str = "text", key: str = "doc_id", copies: bool = True) -> DataFrame:
    """df with the recurring lines dropped; a document that has lost lines and holds no word any more goes."""
    docs, back = apart(df, key, text)
    return back(drop_templates(docs, text, key, copies).where((F.col("dropped_lines") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")))
