"""Mixing sources to target weights by a hash-random order, distributed prefix sums and one cut per source.

Every row gets a hash-random key; within each source the key space is range-split into buckets of a few
hundred rows. Sums of groups of buckets, then of one group's buckets give prefix sums, the bucket where a source's
budget runs out is found from them, and only that bucket is sorted row by row. The cut is a key per source, so the rows themselves are never
shuffled: a row below the cut is taken once more than a row above it, the row at the cut in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.ranges import running
from tidewire.storage import Scratch, table

#: Buckets summed together in the first of two steps.
_GROUP = 4096

#: A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, n_rows)`` -> the same plus ``target`` (double).

    Sources in code-point order, null last, get the weights in turn and share the total size; a target stops
    at ``max_epochs`` times its source's size and the excess is reshared by weight. In order of size / weight
    that is one pass: the first source that its share does not exceed fixes the level of all later ones. Both orders
    are made range by range, so any number of sources will do.
    """
    first = running(sizes, [F.col("source").isNull(), F.col("source")], [], scratch, "__at")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.element_at(turn, (F.pmod(F.col("__at") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    capped = scratch.put(first.select("source", "source_size", "n_rows", weight.alias("w"), (F.col("source_size") * max_epochs).alias("cap")), narrow=True)
    ordered = scratch.put(running(capped, [F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")], ["cap", "w"], scratch), narrow=True)
    whole = F.broadcast(capped.agg(F.sum("source_size").alias("all"), F.sum("w").alias("ws")))  # one row
    level = (F.col("all") - F.col("cap_before")) / (F.col("ws") - F.col("w_before"))
    fits = F.when(level * F.col("w") <= F.col("cap"), F.struct("rank", level.alias("level")))
    found = F.broadcast(ordered.crossJoin(whole).agg(F.min(fits)["level"].alias("level")))  # one row
    share = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return capped.crossJoin(found).select("source", "source_size", "n_rows", share.alias("target"))


def mix_sources(
    df: DataFrame,
    *,
    source: str = "source",
    text: str = "text",
    row_id: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
    bucket_rows: int = 500,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all by default) of ``df`` plus ``size, source_size, target, taken, copies``.

    ``taken``: words of the row in the mix, repeats counted; per source they add up to the target's whole
    part (rows equal in id and text share what is left at the cut). ``copies``: the same decided for whole
    rows, for a mix that does not cut texts: every row that begins below the budget counts in full.
    A null or empty text has size 0 and is taken 0 times; a null source is a source; a null id is an id; very long
    texts are rows like others; equal rows have one key and are taken alike; an empty table gives an empty table;
    columns of ``df`` with the names above are replaced. Equal inputs give equal mixes.
    """
    scratch = Scratch(df.sparkSession, "mix")
    made = ["size", "source_size", "target", "taken", "copies"]
    keep = [c for c in (keep or df.columns) if c not in made]
    key = F.xxhash64(F.lit(seed), F.col(row_id), F.coalesce(F.col(text), F.lit("\x00")))
    rows = df.select(*keep, F.col(source).alias("__source"), key.alias("__key"), word_count(F.col(text)).alias("size"))
    narrow = scratch.put(rows.select(F.col("__source").alias("source"), F.col("__key").alias("key"), "size"))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goal = F.floor("target")
    targets = scratch.put(
        source_targets(scratch.put(sizes, narrow=True), scratch, weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.when(F.col("source_size") > 0, goal - F.col("epochs") * F.col("source_size")).otherwise(0).cast("long"))
        .withColumn("buckets", F.ceil(F.col("n_rows") / bucket_rows).cast("long"))
    )

    # the bucket in which each source's budget runs out, then the row in it
    unit = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53))
    t = targets.select(F.col("source").alias("s"), "budget", "buckets")
    placed = narrow.join(t, narrow["source"].eqNullSafe(t["s"])).select("source", "key", "size", "budget", F.floor(unit * F.col("buckets")).alias("bucket"))
    sums = scratch.put(placed.groupBy("source", "budget", "bucket").agg(F.sum("size").alias("n")), narrow=True)

    def cross(parts: DataFrame, at: str, start: Column | None = None) -> DataFrame:
        """The part of each source in which its budget runs out, and what comes before it."""
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(at)) + (start if start is not None else F.lit(0))
        over = parts.withColumn("upto", upto).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
        return over.select(F.col("source").alias("s"), F.col(at).alias("b"), (F.col("upto") - F.col("n")).alias("start"))

    # groups of buckets first, then the buckets of one group
    group = F.floor(F.col("bucket") / _GROUP)
    outer = scratch.put(cross(sums.groupBy("source", "budget", group.alias("g")).agg(F.sum("n").alias("n")), "g"), narrow=True)
    inner = sums.join(outer, sums["source"].eqNullSafe(outer["s"]) & (group == outer["b"])).select("source", "budget", "bucket", "n", "start")
    edge = scratch.put(cross(inner, "bucket", F.col("start")), narrow=True)
    near = placed.join(edge, placed["source"].eqNullSafe(edge["s"]) & (placed["bucket"] == edge["b"])).groupBy("source", "budget", "start", "key").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("ties"))
    run = Window.partitionBy("source").orderBy("key")
    cut = near.withColumn("upto", F.col("start") + F.sum("n").over(run)).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
    cut = cut.select(F.col("source").alias("cs"), F.col("key").alias("cut_key"), F.floor((F.col("budget") - (F.col("upto") - F.col("n"))) / F.col("ties")).alias("cut_words"))
    plan = scratch.put(targets.join(cut, targets["source"].eqNullSafe(cut["cs"]), "left").select(*[F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "epochs", "cut_key", "cut_words")]).withColumnRenamed("__source", "__s"))

    below, at = F.col("__key") < F.col("__cut_key"), F.col("__key") == F.col("__cut_key")
    extra = F.when(below, F.col("size")).when(at, F.least("size", "__cut_words")).otherwise(0)
    whole = F.when(below | (at & (F.col("__cut_words") > 0)), 1).otherwise(0)
    return rows.join(plan, rows["__source"].eqNullSafe(plan["__s"])).select(
        *keep,
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__epochs") * F.col("size") + extra).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("__epochs") + whole).otherwise(0).cast("int").alias("copies"),
    )


def op3(spark, sf_dir):
    """All documents mixed by source; one row per document with the words the mix takes of it."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
