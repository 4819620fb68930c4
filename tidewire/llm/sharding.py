"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

The rows lie in virtual input partitions (a hash of the row). How many rows of each partition go to each shard is
drawn first, exactly as a uniform permutation would have it: a row of the matrix is a multivariate
hypergeometric draw from what the shards have left. Then every partition is permuted on its own and its ranks
are dealt along its matrix row (the exchange), and every shard is permuted again: its rows get hash-random keys, key
ranges are counted and ranked, and the counts before a range make its ranks slots. No task sees a whole shard.

Main path: DataFrame functions only. The matrix is drawn on the driver from partition counts; it has at most
``max_cells`` cells whatever the input size (65,536 by default, half a megabyte), and so has the table of ranges.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.storage import Scratch, table


_TINY = 2.0**-60


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls taken without replacement are good.

    Probabilities relative to the mode's follow from ratios of neighbours, outward until nothing counts any more
    (below 2**-60 of the mode); they are normalised by their sum, so no logarithm of a large factorial is needed.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    spare = bad - draws
    up, p = [1.0], 1.0
    for x in range(mode, high):
        p *= (good - x) * (draws - x) / ((x + 1) * (spare + x + 1))
        if p < _TINY:
            break
        up.append(p)
    down, p = [], 1.0
    for x in range(mode, low, -1):
        p *= x * (spare + x) / ((good - x + 1) * (draws - x + 1))
        if p < _TINY:
            break
        down.append(p)
    left = rng.random() * (sum(up) + sum(down))
    for x, p in enumerate(up, mode):
        left -= p
        if left <= 0:
            return x
    for x, p in zip(range(mode - 1, low - 1, -1), down, strict=False):
        left -= p
        if left <= 0:
            return x
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Exact counts from each partition to each shard: rows sum to ``counts``, columns to ``sizes``."""
    rng, left, total, out = random.Random(seed), list(sizes), sum(sizes), []
    for n in counts:
        row, others, need = [], total, n
        for cap in left:
            others -= cap
            k = hypergeometric(rng, cap, others, need)
            row.append(k)
            need -= k
        left = [c - k for c, k in zip(left, row, strict=True)]
        total -= n
        out.append(row)
    return out


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shard_rows(
    df: DataFrame,
    n_shards: int = 16,
    *,
    identity: list[str],
    seed: int = 20240229,
    partition_rows: int = 4096,
    max_cells: int = 1 << 16,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (int, counts at most one apart) and ``slot`` (long, gapless from 0).

    ``identity``: the columns whose values stand for the row; rows equal in them are interchangeable, so their order
    does not matter. Nulls are values like others, very long texts are rows like others; an empty table gives an
    empty table; reruns agree. Existing columns named like the two new ones are replaced. Partitions have some
    ``partition_rows`` rows, more where ``max_cells`` would be exceeded.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "shard")
    df = df.drop(shard_col, slot_col)
    salt: Column = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity], *[F.col(c).isNull() for c in identity])
    total = df.count()
    parts = max(1, min(max_cells // n_shards, math.ceil(total / partition_rows)))
    ranges = max(1, min(max_cells // n_shards, math.ceil(total / n_shards / partition_rows)))
    keyed = df.withColumn("__h", salt).withColumn("__p", F.pmod(F.xxhash64("__h", F.lit(1)), F.lit(parts)).cast("int"))

    found = {r["__p"]: r["n"] for r in keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([found.get(p, 0) for p in range(parts)], _even(total, n_shards), seed)
    # ranks from starts[i] on go to shard i
    cells = [(p, list(itertools.accumulate(row[:-1], initial=0))) for p, row in enumerate(matrix)]
    starts = F.broadcast(spark.createDataFrame(cells, "__p int, __starts array<bigint>"))

    tie = ["__h", *identity]
    local = Window.partitionBy("__p").orderBy(F.xxhash64("__h", F.lit(2)), *tie)
    shard = F.size(F.filter("__starts", lambda x: x <= F.col("__r"))) - 1
    unit = F.shiftrightunsigned(F.xxhash64("__h", F.lit(3)).bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53))
    dealt = (
        keyed.withColumn("__r", F.row_number().over(local).cast("long") - 1)
        .join(starts, "__p")
        .withColumn(shard_col, shard.cast("int"))
        .withColumn("__b", F.floor(unit * ranges).cast("int"))
        .drop("__starts", "__r", "__p")
    )
    dealt = scratch.put(dealt)

    before = Window.partitionBy(shard_col).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy(shard_col, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counted.select(F.col(shard_col).alias("__s"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    offsets = F.broadcast(scratch.put(offsets, narrow=True))  # n_shards x ranges rows at most
    again = Window.partitionBy(shard_col, "__b").orderBy(F.xxhash64("__h", F.lit(3)), *tie)
    return (
        dealt.withColumn("__k", F.row_number().over(again).cast("long") - 1)
        .join(offsets, (F.col(shard_col) == F.col("__s")) & (F.col("__b") == F.col("__c")))
        .withColumn(slot_col, F.col("__o") + F.col("__k"))
        .drop("__b", "__k", "__o", "__h", "__s", "__c")
    )


def op9(spark, sf_dir):
    """Every document dealt to one of 16 shards under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = Scratch(spark, "shard").put(
        table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    )
    dealt = shard_rows(narrow, 16, identity=["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
