"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.storage import Scratch


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(u, v)`` of a task -> each of its nodes with the smallest node it is connected to there."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = sorted((root(u), root(v)))
            up[v] = u
    stars = [(x, root(x)) for x in up]
    stars = [s for s in stars if s[0] != s[1]]
    if stars:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stars, strict=True), schema, strict=True)], schema=schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its smallest node.

    Large star: every node hands its larger neighbours its smallest one. Small star: the same with its
    smaller neighbours. The edges converge to stars around the smallest nodes in about log(n) rounds. Hubs
    are aggregated before the shuffle, and each round's tables are written, so a lost executor costs one
    round at most and skewed joins can be split. Loops and null ends are ignored. Components that are not
    settled after ``max_rounds`` rounds, which takes a chain of some 2**max_rounds nodes, are an error. Up to ``at_once``
    edges are one task's work, without rounds; above that, tasks first replace what they hold by stars.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    at = scratch.put(ends.distinct(), narrow=True)

    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        return r["n"], r["h"]

    was = mark(at)
    if at_once:
        kinds = f"u {at.schema['u'].dataType.simpleString()}, v {at.schema['v'].dataType.simpleString()}"
        stars = scratch.put((at.coalesce(1) if was[0] <= at_once else at).mapInArrow(_forest, kinds).distinct(), narrow=True)
        at, max_rounds = stars, 0 if was[0] <= at_once else max_rounds
        was = mark(at) if max_rounds else was
    for _ in range(max_rounds):
        both = at.union(at.select(F.col("v"), F.col("u")))
        low = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), narrow=True)
        large = scratch.put(both.hint("merge").join(low.hint("merge"), "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")), narrow=True)
        low2 = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")), narrow=True)
        small = large.hint("merge").join(low2.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.put(small.union(low2.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), narrow=True)
        scratch.drop(at, low, large, low2)
        at, now = new, mark(new)
        if now == was:
            break
        was = now
    else:
        if max_rounds:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v"), F.col("v")).distinct())


def merge_components(labels: DataFrame, edges: DataFrame, scratch: Scratch, at_once: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Stored ``labels(node, component)`` and a batch's ``edges(a, b)`` -> all labels, and ``moved(was, component)``.

    Only the components that the batch touches are looked at: its edges are drawn between stored components (or new
    nodes), the components of that small graph are found, and what they say is carried back.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    known = scratch.put(ends.hint("merge").join(labels.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("was")), narrow=True)
    one, other = (known.select(F.col("node").alias(x), F.col("was").alias(f"w{x}")) for x in "ab")
    drawn = edges.select("a", "b").hint("merge").join(one.hint("merge"), "a").hint("merge").join(other.hint("merge"), "b")
    found = connected_components(scratch.put(drawn.select(F.col("wa").alias("a"), F.col("wb").alias("b")), narrow=True), at_once=at_once)
    moved = scratch.put(found.select(F.col("node").alias("was"), "component"), narrow=True)
    new = known.join(labels.select("node"), "node", "left_anti")
    old = labels.withColumnRenamed("component", "was")
    both = old.unionByName(new).hint("merge").join(moved.hint("merge"), "was", "left")
    return scratch.put(both.select("node", F.coalesce("component", "was").alias("component")), narrow=True), moved
