"""Exact removal of byte strings that occur more than once, over all texts.

A string of ``length`` bytes is represented by its smallest k-gram (by hash), so equal strings have equal
representatives at equal offsets, and neighbouring strings mostly share one: a run of strings with one
representative is a tuple (representative, content of the run, where). Tuples of a representative that
occurs once are settled; equal runs are settled as repeated; where different runs share a representative,
one text stretch for each distinct run is taken up again with a larger k, and at last with the strings
themselves. Every level reduces its input to a few hundredths, as the recursion of induced suffix sorting
does, and every level's order is made by Spark's external sort and shuffle; README.md says why the tuples
are not carried through one priority queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import Rolling, chunks, mix, sliding_min
from tidewire.llm.keys import text_key
from tidewire.storage import Scratch, table

_SEGMENT = 1 << 21
_RUNS = "a long, run long, owner long, at long"


def runs(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive strings with one representative k-gram: its hash, the run's hash, text, start, count."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(data) < length:
        return none
    one, two = Rolling(data), Rolling(data, 1)
    grams = one.windows(k)
    low = np.uint64(_SEGMENT * 2 - 1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    rep = (best & low).astype(np.int64)
    start = np.arange(len(rep))
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(rep)]
    inside = start + length <= off[text + 1]
    start, rep, text = start[inside], rep[inside], text[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (rep[1:] != rep[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, p = start[first], start[last], rep[first]
    content = two.of(lo, hi + length) ^ mix((p - lo).astype(np.uint64))
    return one.of(p, p + k), content, text[first], lo - off[text[first]], hi - lo + 1


def _runs(column: str, length: int, k: int):
    """Tuples ``(a, run, owner, at)``; ``at`` packs the start in the owner's text and the count of strings."""

    def rows(owner, base, data, off):
        a, run, text, lo, n = runs(data, off, length, k)
        at = (base[text] + lo) * 4096 + n
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(run.view(np.int64)), pa.array(owner[text]), pa.array(at)], names=["a", "run", "owner", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in chunks(b, column, 1_000_000):
                owner = part.column("owner").to_numpy()
                base = part.column("base").to_numpy()
                if len(data) <= _SEGMENT:
                    yield rows(owner, base, data, off)
                else:  # one very long text: segments whose strings do not overlap
                    for s in range(0, len(data), _SEGMENT - length):
                        piece = data[s : s + _SEGMENT - 1]
                        yield rows(owner, base + s, piece, np.array([0, len(piece)]))

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text, with where they begin."""
    for b in batches:
        owner, base, out = [], [], []
        for part, data, off in chunks(b, "text"):
            for i, want in enumerate(part.column("want").to_pylist()):
                for w in want:
                    s = int(off[i]) + w["lo"]
                    owner.append(w["owner"])
                    base.append(w["lo"])
                    out.append(data[s : s + w["size"]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(base, pa.int64()), pa.array(out, pa.binary())], names=["owner", "base", "bytes"])


def _settle(scratch: Scratch, tuples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated runs, one tuple for each distinct run of a representative that has several)."""
    reps = scratch.put(tuples.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("x"), F.max("run").alias("y")).where("c > 1").select("a", (F.col("x") != F.col("y")).alias("mixed")))
    shared = scratch.put(tuples.hint("merge").join(reps.hint("merge"), "a"))
    mixed = shared.where("mixed")
    kinds = scratch.put(mixed.groupBy("a", "run").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("owner", "at")).alias("one")))
    again = mixed.select("a", "run", "owner", "at").hint("merge").join(kinds.where("c > 1").select("a", "run").hint("merge"), ["a", "run"], "left_semi")
    full = scratch.put(shared.where("not mixed").select("owner", "at").union(again.select("owner", "at")))
    rest = scratch.put(kinds.select("one.owner", "one.at"))
    scratch.drop(reps, shared, kinds)
    scratch.collect_garbage()
    return full, rest


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each text and drop their bytes."""
    import hashlib

    for b in batches:
        ids, size, removed, spans, digest = b.column("id"), [], [], [], []
        for part, data, off in chunks(b, "text"):
            for i, (want, whole) in enumerate(zip(part.column("spans").to_pylist(), part.column("whole").to_pylist(), strict=True)):
                text = data[off[i] : off[i + 1]]
                cover = np.zeros(len(text) + 1, np.int32)
                if whole:
                    cover[0] = 1
                for s in want or ():
                    cover[s["lo"]] += 1
                    cover[s["hi"]] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                size.append(len(text))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()))
                digest.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        cols = [ids, *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest)]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", length: int = 200, levels: tuple[int, ...] = (100, 180)) -> tuple[DataFrame, DataFrame]:
    """``(texts, spans)``: ``df`` as (id, uid, text, whole) and the covered byte intervals (owner, lo, hi) by uid.

    ``whole``: the text occurs in several rows and has ``length`` bytes, so all of it is covered. Every other
    byte that a repeated string covers lies in some interval; intervals may overlap. Null is empty.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "substrings")
    text_ = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(row_id).alias("id"), text_key(df, row_id, text).alias("uid"), text_.alias("text"))
    keys = scratch.put(docs.where(F.octet_length("text") >= length).select("uid", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2")))
    same = keys.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("first")).where("c > 1")
    copies = scratch.put(keys.hint("merge").join(scratch.put(same).hint("merge"), ["h", "h2"]).select("uid", (F.col("uid") == F.col("first")).alias("first")).groupBy("uid").agg(F.max("first").alias("first")))

    long = docs.where(F.octet_length("text") >= length).select(F.col("uid").alias("owner"), F.lit(0).cast("long").alias("base"), "text")
    found = []
    tuples = scratch.put(long.mapInArrow(_runs("text", length, levels[0]), _RUNS))
    for k in (*levels[1:], length):
        full, rest = _settle(scratch, tuples)
        found.append(full)
        if len(found) == 1:
            scratch.drop(tuples)
            want = rest.select("owner", F.shiftright("at", 12).alias("lo"), (F.col("at") % 4096 + length - 1).cast("int").alias("size"))
            want = scratch.put(want.groupBy("owner").agg(F.collect_list(F.struct("owner", "lo", "size")).alias("want")))
            stretches = long.select("owner", "text").hint("merge").join(want.hint("merge"), "owner").select("text", "want").mapInArrow(_cut_out, "owner long, base long, bytes binary")
        else:
            where = rest.select("owner", F.shiftright("at", 12).alias("lo"), (F.col("at") % 4096 + length - 1).cast("int").alias("size"))
            stretches = where.hint("merge").join(pieces.withColumnRenamed("owner", "o").hint("merge"), (F.col("owner") == F.col("o")) & (F.col("base") <= F.col("lo")) & (F.col("lo") + F.col("size") <= F.col("base") + F.octet_length("bytes")))
            stretches = stretches.select("owner", F.col("lo").alias("base"), F.expr("substring(bytes, cast(lo - base + 1 as int), size)").alias("bytes")).dropDuplicates(["owner", "base"])
        pieces = scratch.put(stretches)
        scratch.collect_garbage()
        tuples = pieces.mapInArrow(_runs("bytes", length, k), _RUNS)
    found.append(_settle(scratch, tuples)[0])
    spans = None
    for f in found:
        s = f.select("owner", F.shiftright("at", 12).alias("lo"), (F.shiftright("at", 12) + F.col("at") % 4096 + length - 1).alias("hi"))
        spans = s if spans is None else spans.union(s)
    texts = docs.hint("merge").join(copies.select(F.col("uid").alias("u"), F.lit(True).alias("whole")).hint("merge"), F.col("uid") == F.col("u"), "left").drop("u")
    return texts, spans


def remove_repeats(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", length: int = 200, levels: tuple[int, ...] = (100, 180)) -> DataFrame:
    """``(row_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``df``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed; strings do
    not cross texts, overlapping ones count, and all are judged on the input. A null or empty text has no
    bytes. Equal rows are separate texts, each a repeat of the other; rows with a null id are rows like others; very
    long texts are taken in segments; an empty table gives an empty one; other columns are not looked at.
    """
    texts, spans = repeated_spans(df, row_id=row_id, text=text, length=length, levels=levels)
    scratch = Scratch(df.sparkSession, "substrings")
    gathered = scratch.put(spans.groupBy("owner").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    both = texts.hint("merge").join(gathered.hint("merge"), F.col("uid") == F.col("owner"), "left")
    both = both.select("id", "text", F.when(F.coalesce("whole", F.lit(False)), None).otherwise(F.col("spans")).alias("spans"), F.coalesce("whole", F.lit(False)).alias("whole"))
    kind = texts.schema["id"].dataType.simpleString()
    return both.mapInArrow(_apply, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", row_id)


def op4(spark, sf_dir):
    """Every document without its repeated strings of 200 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))
