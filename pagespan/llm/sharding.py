"""Sharding by a Feistel permutation with cycle walking over global row numbers: a reproducible shuffle in which the
shard and slot of any row, and the row of any shard and slot, can be computed.

Rows are numbered without gaps by the order columns (nulls first, in any of them); rows that agree in all of them are
interchangeable. Null and empty texts count as any row; a very long text travels through the sort once if it is a column
of the table, so tables of texts are better sharded by their keys and digests, as the registered query does. Counts of the
shards differ by one at most. An empty table stays empty; further columns pass through, those named as an output are
replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import apart, ensure_importable, store

ROUNDS = 6
_M = np.uint64(0xFFFFFFFF)


def round_keys(seed: int) -> list[int]:
    """ROUNDS keys of 32 bits from a seed, by a multiplicative generator modulo 2^31 - 1."""
    keys, x = [], seed % 2147483646 + 1
    for _ in range(ROUNDS):
        x = x * 48271 % 2147483647
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    """Bits of each half: the domain is the smallest power of four that holds n rows."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _f(r: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = ((r ^ np.uint64(key)) * np.uint64(2654435769)) & _M
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(2246822519)) & _M
    return (x ^ (x >> np.uint64(13))) & mask


def _walk(rows: np.ndarray, n: int, keys: list[int], forward: bool) -> np.ndarray:
    h = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(h)) - 1)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        l, r = out[todo] >> h, out[todo] & mask
        if forward:
            for k in keys:
                l, r = r, l ^ _f(r, k, mask)
        else:
            for k in reversed(keys):
                l, r = r ^ _f(l, k, mask), l
        out[todo] = (l << h) | r
        todo = todo[out[todo] >= n]  # outside: walk on along the cycle
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Position of each row number among n."""
    return _walk(rows, n, round_keys(seed), True)


def unpermute(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    return _walk(positions, n, round_keys(seed), False)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with global row numbers from 0 in the given order, and the number of rows. Sorted once by range and stored; then only the partitions' counts are summed up."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    stored = store(sorted_.withColumns({"part_": F.shiftright(at, 33), "at_": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = stored.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.select("part_", (F.sum("n_").over(W.orderBy("part_")) - F.col("n_")).alias("before_"))  # a row for each partition
    total = counts.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    return stored.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("at_")).drop("part_", "at_", "before_"), int(total)


def shard(df: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    """df with row_number, shard and slot (from 0 without gaps in each shard)."""
    ensure_importable(df.sparkSession)
    rows, back = apart(df, *order)
    numbered, n = number_rows(rows, order)

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(np.int64), n, seed))

    placed = numbered.withColumn("position_", position("row_number"))
    out = placed.withColumns({"shard": (F.col("position_") % shards).cast("int"), "slot": F.expr(f"position_ div {shards}")})

    return back(out, ["row_number", "shard", "slot"])


def write_shards(df: DataFrame, path: str, order: list[str], shards: int, seed: int) -> None:
    """df as Parquet in one folder for each shard, sorted by slot in each file; a shard's rows go to several files by ranges of slots."""
    placed = shard(df, order, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


