"""Connected components of an edge table by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, store, together


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every node links its larger neighbours to the smallest of its neighbourhood. Small star: the others, and itself. The neighbourhood's minimum is a partial aggregate, so a hub's links never meet in one task unsummed."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a"), F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: each node links to one smaller node, which links to none. That is where the steps end, so no further one has to show it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or up = 1 and top = 1").limit(1).count()


def of_stars(edges: DataFrame) -> DataFrame:
    """(node, component) where each a links to one b, the smallest node of its component."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. Loops and repeated edges do no harm; null ends are left out. Few edges take their steps in one task."""
    ends = together(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")))
    now = store(ends.distinct(), "edges")
    for _ in range(max_steps):
        read = together(now)
        if _settled(read):
            return of_stars(read)
        step = store(_star(_star(read, True), False), "edges")
        forget(now)
        now = step
    raise RuntimeError("components did not settle")
