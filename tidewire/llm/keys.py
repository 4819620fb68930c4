"""Names for texts that are short, agree between scans, and are never shared by two different texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(df: DataFrame, row_id: str, text: str, bits: int = 64) -> Column:
    """A 64-bit hash of id and text that no two different rows of ``df`` share; rows equal in id and text share it.

    Keys that different rows share (told by a second hash) get a new hash of their rows, those alone, until none is left.
    Some n * n / 2**65 keys are shared at first: none in small tables, a dozen among 2 * 10**10 rows, which is what the
    driver sees of them. ``bits`` below 64 force collisions, for tests.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    of = lambda salt: F.xxhash64(F.lit(salt), F.col(row_id), F.col(row_id).isNull(), value)
    other = F.xxhash64(value, F.lit(-1), F.col(row_id), F.col(row_id).isNull())
    key, salt = F.shiftrightunsigned(of(0), 64 - bits) if bits < 64 else of(0), 0
    while True:
        pairs = df.select(key.alias("k"), other.alias("o")).groupBy("k").agg(F.min("o").alias("a"), F.max("o").alias("b"))
        shared = [r["k"] for r in pairs.where("a <> b").select("k").collect()]
        if not shared:
            return key
        salt += 1
        key = F.when(key.isin(shared), of(salt)).otherwise(key)
