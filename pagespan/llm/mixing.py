"""Mixing sources to target weights by capped water-filling, and a seeded sample of whole and fractional repetitions.

Sources share a budget by weight; one whose target would pass MAX_EPOCHS times its size is clamped there, and the excess
goes to the others by weight until none is above. A source's rate is target over size: every document is taken
floor(rate) times, and those drawn by a seeded hash once more. Documents are drawn within classes of like size (powers of
two), largest first: each class's threshold of the hash is put where the taken size comes nearest to the class's share
plus what the classes before have left over, so a source meets its target to about its smallest documents.

The draw depends on the key and, for repeated keys, the text, so reruns and other partitionings agree; identical rows are
taken alike. Where two thresholds come equally near, the lower one is taken. Null texts have size 0; a null source is a
source of its own, the last in order. A very long text is one row like any other. An empty table stays empty. Further
columns pass through, those named as an output are replaced. Sources stay in tables, however many there are: the driver
only sees the level of the water.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, ensure_importable, join_hot, n_words, store
from .sharding import number_rows

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 97
#: Steps of the hash for each class of sizes; a threshold falls on a step.
BINS = 1024


def water_fill(sources: DataFrame, budget: float, cap: float = MAX_EPOCHS) -> DataFrame:
    """sources (n: size, w: weight) with target: by weight with none above cap times its size, as far as the sizes allow. Each round clamps what is above, and shares what is left among the others; a clamped source stays above as the level rises."""
    live = (F.col("n") > 0) & (F.col("w") > 0)
    left, open_ = float(budget), float(sources.agg(F.sum(F.when(live, F.col("w")))).first()[0] or 0)
    while open_:
        over = F.lit(left) * F.col("w") / F.lit(open_) > F.lit(cap) * F.col("n")
        clamped, rest = sources.where(live).agg(F.sum(F.when(over, F.lit(cap) * F.col("n"))), F.sum(F.when(~over, F.col("w")))).first()
        now = budget - float(clamped or 0), float(rest or 0)
        if now == (left, open_) or not now[1]:
            break
        left, open_ = now
    level = F.lit(left) * F.col("w") / F.lit(open_ or 1.0)
    return sources.withColumn("target", F.when(live, F.least(level, (F.lit(cap) * F.col("n")).cast("double"))).otherwise(0.0))


def _name(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def thresholds(bins: pd.DataFrame, share: float) -> list[tuple[int, int]]:
    """(class, first bin that is not drawn) of one source. bins: cls, bin, size; share: the part of each size that is to be drawn."""
    out, carry = [], 0.0
    for c, own in sorted(bins.groupby("cls"), key=lambda x: -x[0]):
        own = own.sort_values("bin")
        reached = np.concatenate([[0], np.cumsum(own["size"].to_numpy(np.float64))])
        ends = np.concatenate([[0], own["bin"].to_numpy(np.int64) + 1])
        goal = carry + share * reached[-1]
        at = int(np.abs(reached - goal).argmin())
        carry = goal - reached[at]
        out.append((int(c), BINS if at == len(reached) - 1 and share >= 1 else int(ends[at])))
    return out


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS, share: float = 1.0, cap: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """df with size (words), source_size, target and times (how often the mix takes the row). weights: by source, or repeating over the sources in the order of their code points, null last; share: of all sizes."""
    ensure_importable(df.sparkSession)
    docs, back = apart(df, key, text, source)
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long")
    rows = docs.withColumns({"size": n_words(F.col(text)), "name_": _name(source)})
    rows = rows.withColumns({"cls_": F.length(F.bin("size")), "bin_": (draw % BINS).cast("int")})
    bins = store(rows.groupBy("name_", "cls_", "bin_").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "bins")
    sources = bins.groupBy("name_").agg(F.sum("size").alias("n")).withColumn("last_", F.col("name_") == "null")
    if isinstance(weights, dict):
        given = [F.struct(F.lit("null" if k is None else f"={k}"), F.lit(float(w))) for k, w in weights.items()]
        w = F.coalesce(F.map_from_entries(F.array(*given))[F.col("name_")], F.lit(0.0)) if given else F.lit(0.0)
    else:
        sources, _ = number_rows(sources, ["last_", "name_"])
        w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("row_number") % len(weights))
    sources = store(sources.select("name_", "n", w.alias("w")), "sources")
    targets = water_fill(sources, share * (sources.agg(F.sum("n")).first()[0] or 0), cap)
    rate = F.when(F.col("n") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("n"))).otherwise(0.0)
    rates = targets.select("name_", F.col("n").alias("source_size"), "target", rate.alias("rate"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        r = float(first["rate"])
        got = thresholds(part.rename(columns={"cls_": "cls", "bin_": "bin"}), r - int(r))
        return pd.DataFrame([(first["name_"], c, b, int(r), int(first["source_size"]), float(first["target"])) for c, b in got], columns=["name_", "cls_", "below_", "whole_", "source_size", "target"])

    chosen = bins.select("name_", "cls_", "bin_", "size").join(rates, "name_").groupBy("name_").applyInPandas(one, "name_ string, cls_ int, below_ int, whole_ int, source_size long, target double")
    chosen = store(chosen, "thresholds")  # for each source at most a row for each power of two
    placed = join_hot(rows, chosen, ["name_", "cls_"], "bin_")
    placed = placed.withColumn("times", F.col("whole_") + (F.col("bin_") < F.col("below_")).cast("int"))
    return back(placed, ["size", "source_size", "target", "times"])


def sample(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Each row of df as often as the mix takes it."""
    docs, back = apart(df, key, text, source)
    mixed = mix(docs, source, text, key, **options).where("times > 0")
    return back(mixed.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times")))))
