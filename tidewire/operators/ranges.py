"""Ranks and running sums over a whole table without a task that sees it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.storage import Scratch


def running(df: DataFrame, order: list[Column], sums: list[str], scratch: Scratch, rank: str = "rank") -> DataFrame:
    """``df`` plus ``rank`` (from 1, in ``order``) and ``<sum>_before`` (sum over all rows before) for each column of ``sums``.

    The rows are dealt to key ranges and written; each range is ranked on its own, and what lies before a range is a
    running sum over one row per range. ``order`` has to tell rows apart for reruns to agree; the sums should be whole
    numbers, which add up alike in any grouping.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    by = [F.col(c).asc_nulls_first() for c in names]
    at = scratch.put(keyed.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    totals = at.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = totals.select(F.col("__range"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b{c}") for c in ("__n", *[f"__t_{s}" for s in sums])])
    own = Window.partitionBy("__range").orderBy(*by)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = at.withColumns({"__r": F.row_number().over(own), **{f"__s_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums}})
    out = placed.join(scratch.put(base, narrow=True), "__range")
    return out.select(*df.columns, (F.col("__b__n") + F.col("__r")).cast("long").alias(rank), *[(F.col(f"__b__t_{c}") + F.col(f"__s_{c}")).alias(f"{c}_before") for c in sums])


def rank_in_groups(df: DataFrame, group: list[str], order: list[Column], scratch: Scratch, rank: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` plus ``rank`` (from 1, in ``order`` within its group) and, if named, the group's ``size``, however large a group is.

    Rows are dealt to ranges of group and order; each range ranks what it has of a group, and what lies before it comes from
    one row per range and group. ``order`` may have descending columns, and has to tell rows apart for reruns to agree.
    """
    by = [F.col(g).asc_nulls_first() for g in group]
    at = scratch.put(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    here = at.groupBy("__range", *group).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*group)
    before = along.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = here.select(F.col("__range").alias("__at"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"), F.sum("__n").over(along).alias("__k"))
    base = scratch.put(base, narrow=True)
    placed = at.withColumn("__r", F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order)))
    same = F.col("__range") == F.col("__at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = placed.join(base, same)
    more = [F.col("__k").alias(size)] if size else []
    return out.select(*[c for c in df.columns if c not in (rank, size)], (F.col("__b") + F.col("__r")).cast("int").alias(rank), *more)
