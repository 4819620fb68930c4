"""Token counts per document from piece counts of distinct pre-tokens, without materialising ids.

A pre-token here is a run between white space, as the tokenizer's own first cut has it (its normaliser
folds all white space and its pieces never span it), so a text has the pieces of its pre-tokens. Every
distinct pre-token is tokenized once. The most frequent ones (a bounded number) reach the tasks as a
dictionary and are summed where the text is read; only the rare rest is joined through a shuffle.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.storage import Scratch, table

#: Unicode White_Space, what the tokenizer's \s+ folds; str.split() takes the controls 28 to 31 as well.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")


def pre_tokens(text: str) -> list[str]:
    """The runs of a text between white space."""
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


def tokenizer_counts(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """A loader (called once per task) of a function texts -> token counts, for a tokenizers .json file."""

    def load():
        tok = _tokenizer(path)
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    return load


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a worker process, loaded once; Spark's tasks are the threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so what a task holds besides the input stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _distinct(column: str, flush: int = 100_000):
    """Distinct pre-tokens of a task with their frequencies; the table is flushed whenever it is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for b in _slices(batches):
            for text in b.column(column):
                if text := text.as_py():
                    seen.update(pre_tokens(text))
                    if len(seen) > flush:
                        yield out()
                        seen = Counter()
        yield out()

    return run


def _pieces(load):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load()
        for b in _slices(batches, 2000):
            n = count(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(1)], names=["word", "pieces", "n"])

    return run


def _per_document(common):
    """Rows ``(row, n_bytes, hot)`` with the rare pre-tokens of each document as two parallel lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for b in _slices(batches):
            size, hot, at, words, counts = [], [], [0], [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                size.append(len(text.encode()))
                total = 0
                for w, k in Counter(pre_tokens(text)).items():
                    p = known.get(w)
                    if p is None:
                        words.append(w)
                        counts.append(k)
                    else:
                        total += p * k
                hot.append(total)
                at.append(len(words))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size, pa.int64()), pa.array(hot, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
                names=["id", "n_bytes", "hot", "words", "counts"],
            )

    return run


def count_tokens(df: DataFrame, load, *, row_id: str = "doc_id", text: str = "text", max_common: int = 200_000) -> DataFrame:
    """``(row_id, n_bytes, n_tokens)``, one row per row of ``df``, in no order.

    ``load``: see ``tokenizer_counts``. ``max_common`` bounds the dictionary sent to the tasks. A null or
    empty text has 0 bytes and 0 tokens; equal ids stay separate rows; very long texts are read whole, one at a time; an
    empty table gives an empty one; other columns, whatever their names, are not looked at.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "tokens")
    docs = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    words = docs.select("text").mapInArrow(_distinct("text"), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    pieces = scratch.put(words.mapInArrow(_pieces(load), "word string, pieces long, n long"))

    # the lowest power of two such that at most max_common pre-tokens are at least as frequent
    steps = {r["e"]: r["k"] for r in pieces.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, room = 64, max_common
    for e in sorted(steps, reverse=True):
        room -= steps[e]
        if room < 0:
            break
        least = e
    common = {r["word"]: r["pieces"] for r in pieces.where(F.col("n") >= math.ldexp(1.0, least)).select("word", "pieces").toLocalIterator()} if least < 64 else {}
    rare = pieces.where(F.col("n") < math.ldexp(1.0, least)).select("word", "pieces")

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, hot long, words array<string>, counts array<long>"
    made = scratch.put(docs.mapInArrow(_per_document(spark.sparkContext.broadcast(common)), schema).withColumn("row", F.monotonically_increasing_id()))
    tail = made.select("row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    summed = scratch.put(tail.hint("merge").join(rare.hint("merge"), "word").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("cold")))
    return made.select("row", "id", "n_bytes", "hot").hint("merge").join(summed.hint("merge"), "row", "left").select(F.col("id").alias(row_id), "n_bytes", (F.col("hot") + F.coalesce("cold", F.lit(0))).alias("n_tokens"))


def op5(spark, sf_dir):
    """Tokens of every document under word_bpe_49k.json."""
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_counts(public_tokenizers.path("word_bpe_49k.json")))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
