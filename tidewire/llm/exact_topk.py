"""Exact top-k inner products by columnar branch and bound.

Vectors are stored in vertical layout: blocks of rows, dimension by dimension. A task takes one block of
candidates against one block of queries, adds up scores a few dimensions at a time, and after every step
drops the candidates whose score cannot reach the query's k-th best any more: what is missing is at most the
product of the remaining masses (norms over the dimensions to come, Cauchy-Schwarz). Survivors are compacted
before the next step. The bar a candidate has to reach is a true lower bound: the k-th best exact score
against a first sample of rows, then the k-th best within the block itself. Arithmetic is exact: components
are integers, sums stay below 2**53 in float64 or else run in int64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.storage import Scratch, table


def _valid(vector: str):
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return c.isNotNull() & fine


def quantise(df: DataFrame, row_id: str, vector: str, scale: int) -> DataFrame:
    """``(id, v array<long>)`` of the rows that take part: floor(scale * x), x as double."""
    return df.where(_valid(vector) & F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Rows x dimensions; a shorter vector counts as zero beyond its end."""
    lists = batch.column(i)
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0))
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else []] = flat
    return out


def _top(key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score descending, then the smaller id."""
    if len(score) > 4 * k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= bar)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((key[near], -score[near].astype(float) if score.dtype != np.int64 else ~score[near]))[:k]]


def _floor(x: float) -> float:
    """A little less than a sum of floats, by more than its rounding."""
    return x - 1 - abs(x) * 1e-12


def search_block(qkey, q, ckey, c, bar, k: int, step: int):
    """For each query the k best candidates of the block that reach ``bar``: (query, id, score) triples."""
    dims = max(q.shape[1], c.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    q, c = pad(q), pad(c)
    wide = np.abs(q.astype(float)).max(initial=0) * np.abs(c.astype(float)).max(initial=0) * dims
    kind = np.float64 if wide < 2**53 else np.int64 if wide < 2**63 else object
    q, c = q.astype(kind), np.asfortranarray(c.astype(kind))
    rest = lambda m: np.sqrt(np.cumsum((m.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]) if dims else np.zeros((len(m), 0))
    mass_q, mass_c = rest(q), rest(c)
    first = q[:, :step] @ c[:, :step].T  # the first block of dimensions for all pairs at once
    out = []
    for i in range(len(qkey)):
        own, low = ckey != qkey[i], bar[i]
        live, score, d = np.arange(len(ckey)), first[i], min(step, dims)
        if not own.all():
            live = np.flatnonzero(own)
            score = score[live]
        while d < dims and len(live) > k:
            bound = mass_q[i, d] * mass_c[live, d]
            # the k-th largest of what each candidate reaches at least is a bar too
            low = max(low, _floor(np.partition((score - bound).astype(float), len(live) - k)[len(live) - k])) if d < 2 * step or low == -np.inf else low
            stay = np.flatnonzero(score + bound * (1 + 1e-9) + np.abs(score).astype(float) * 1e-12 + 1 >= low)
            if len(stay) < len(live):
                live, score = live[stay], score[stay]
            score = score + c[live, d : d + step] @ q[i, d : d + step]
            d += step
        while d < dims:
            score = score + c[live, d : d + step] @ q[i, d : d + step]
            d += step
        if kind is object:
            score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], np.int64)
        stay = np.flatnonzero(score >= low)
        best = stay[_top(ckey[live[stay]], score[stay], k)]
        out.append((np.full(len(best), qkey[i]), ckey[live[best]], score[best].astype(np.int64)))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ()))]


def _search(shared, k: int, step: int, rows: int, block: int):
    """A task's k best candidates for each query; the bar rises as the task goes on. ``block`` queries at a time
    meet ``rows`` candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qkey, q, bar = shared.value
        bar = bar.copy()
        best = [np.zeros(0, np.int64)] * 3
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ckey, c = part.column(0).to_numpy().astype(np.int64), _matrix(part, 1)
                got = [search_block(qkey[i : i + block], q[i : i + block], ckey, c, bar[i : i + block], k, step) for i in range(0, len(qkey), block)]
                best = [np.concatenate(x) for x in zip(best, *got, strict=True)]
                order = np.lexsort((best[1], ~best[2], best[0]))
                best = [x[order] for x in best]
                starts = np.flatnonzero(np.concatenate(([True], best[0][1:] != best[0][:-1]))) if len(order) else np.zeros(0, np.int64)
                place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
                full = place == k - 1
                at_query = np.searchsorted(qkey, best[0][full])
                bar[at_query] = np.maximum(bar[at_query], best[2][full])
                best = [x[place < k] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best], names=["query_id", "vec_id", "score"])

    return run


def _load(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the matrix of a bounded table, by id."""
    found = rows.select("id", "v").toArrow().sort_by("id").combine_chunks()
    batches = found.to_batches()
    if not batches:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    return batches[0].column(0).to_numpy().astype(np.int64), _matrix(batches[0], 1)


def top_k(df: DataFrame, queries: DataFrame, *, row_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, query_rows: int = 16_384, query_block: int = 2048, block_rows: int = 4096, sample_rows: int = 2048, step: int = 16) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` rows of largest integer inner product.

    The query's own id is no candidate; ties go to the smaller id; vectors that are null or hold a
    null or non-finite component take no part, nor do rows without an id; a shorter vector, an empty one too, counts as
    zero beyond its end; equal ids are separate candidates but one query (the first by its vector). A component beyond
    64 bits counts as the last number within, and so does a score. Empty tables give an empty one; other columns are
    not looked at. A job takes some ``query_rows`` queries (what goes to all tasks) against all candidates, in blocks
    of ``query_block`` against ``block_rows``; a task returns k rows a query at most.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "topk")
    cand = scratch.put(quantise(df, row_id, vector, scale))
    first = F.row_number().over(Window.partitionBy("id").orderBy("v"))
    asked = scratch.put(quantise(queries, row_id, vector, scale).withColumn("n", first).where("n = 1").drop("n"))
    jobs = max(1, -(-asked.count() // query_rows))
    skey, sample = _load(cand.limit(sample_rows))
    found = []
    for job in range(jobs):
        qkey, q = _load(asked.where(F.pmod(F.xxhash64("id"), F.lit(jobs)) == job))
        bar = np.full(len(qkey), -np.inf)
        for at in range(0, len(qkey), 64):
            got = search_block(qkey[at : at + 64], q[at : at + 64], skey, sample, bar[at : at + 64], k, step)
            for i in range(at, min(at + 64, len(qkey))):
                own = got[2][got[0] == qkey[i]]
                bar[i] = own.min() if len(own) == k else -np.inf
        shared = spark.sparkContext.broadcast((qkey, q, bar))
        found.append(scratch.put(cand.mapInArrow(_search(shared, k, step, block_rows, query_block), "query_id long, vec_id long, score long")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    merged = reduce(DataFrame.unionAll, found)
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10(spark, sf_dir):
    """Rows of ``embeddings`` with an id divisible by 100 against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
