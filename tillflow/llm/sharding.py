"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 in an order that hangs on their content only; a keyed Feistel network on the next power of four,
walked along its cycle until it falls below n, permutes the numbers. Row with permuted number p goes to shard p mod shards,
slot p div shards: shard sizes differ by one at most, slots have no gap, and a number can be turned back (`unpermute`).
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillflow.llm.common import documents, mix

ROUNDS = 6
BUCKETS = 4096                     # of the numbering: one window task per bucket


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, n: int, keys: np.ndarray, back: bool) -> np.ndarray:
    bits = np.uint64(_half(n))
    mask = np.uint64((1 << int(bits)) - 1)
    left, right = x >> bits, x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix(left + k) & mask), left
        else:
            left, right = right, left ^ (mix(right + k) & mask)
    return (left << bits) | right


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    keys = _keys(seed)
    y = _network(np.asarray(x, np.uint64), n, keys, back)
    while (out := y >= np.uint64(n)).any():
        y[out] = _network(y[out], n, keys, back)
    return y.astype(np.int64)


def permute(x, n: int, seed: int) -> np.ndarray:
    """Place of each row number below n; a bijection on 0 .. n-1."""
    return _walk(x, n, seed, False)


def unpermute(y, n: int, seed: int) -> np.ndarray:
    return _walk(y, n, seed, True)


def number_rows(df: DataFrame) -> DataFrame:
    """`df` with `row_number` (0 ..) and `n_rows`. Equal rows share one block of numbers, so copies of one row never fill a task.

    The order is that of a hash of all columns, then of the columns: it needs no global sort and no single task.
    """
    cols = df.columns
    rows = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
            .withColumn("_hash", F.xxhash64(*cols)).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int")))
    every = Window.orderBy("_bucket")
    sums = rows.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))                        # BUCKETS rows at most
    sums = sums.select("_bucket", (F.sum("_n").over(every) - F.col("_n")).alias("_before"),
                       F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", *cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("_copies").over(inside)).join(F.broadcast(sums), "_bucket")     # BUCKETS rows: a fixed bound
    first = F.col("_before") + F.col("_end") - F.col("_copies")
    return rows.select(*cols, "n_rows", F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("row_number"))


def assign_shards(df: DataFrame, shards: int, seed: int = 20) -> DataFrame:
    """Adds `shard` (0 .. shards-1) and `slot` (0 .., without gaps in a shard) to the rows of `df`.

    Nulls are values like others; repeated rows get places of their own; an empty table stays empty. Same rows, shards and seed:
    same result, whatever the partitioning. Columns named shard, slot, row_number or n_rows are replaced.
    """
    df = df.drop("shard", "slot", "row_number", "n_rows")

    @F.pandas_udf("long")
    def place(number: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), int(n.iloc[0]), seed) if len(number) else number)

    p = number_rows(df).withColumn("_place", place("row_number", "n_rows"))
    return p.select(*df.columns, (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot"))


def shard_table(docs: DataFrame, shards: int = 24, seed: int = 20, keep=()) -> DataFrame:
    """One row per document: its size in bytes plus 8, checksum, shard and slot. A null text has no bytes and checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select("doc_id", *keep, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(thin, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *keep)


def op4_shards(spark, sf_dir):
    return shard_table(documents(spark, sf_dir))
