"""Language identification by Bayesian evidence fusion.

Per document: the likelihood of its text under each language (hashed byte trigrams, naive Bayes), the
language its metadata and its page's markup declare, the suffix of its page's address, and a prior from its
host, smoothed over host -> domain -> all. How far a declaration or a suffix can be trusted is not assumed:
P(value | language) comes from grouped counts of the text-only posteriors, as do the priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import LOWER, chunks
from tidewire.storage import Scratch, table

BUCKETS = 1 << 14
_LETTER = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of a chunk that have a letter and lie in one text, and their texts."""
    low = LOWER[data]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = low.astype(np.uint32)
    code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
    letter = _LETTER[low]
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:-2]
    ok = (letter[:-2] | letter[1:-1] | letter[2:]) & (np.arange(len(code)) + 3 <= off[text + 1])
    return code[ok].astype(np.int64), text[ok]


def _counts(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), BUCKETS), np.int64)
        for b in batches:
            for part, data, off in chunks(b, "text"):
                lang = np.array([index[x] for x in part.column("lang").to_pylist()])
                code, text = _grams(data, off)
                total += np.bincount(lang[text] * BUCKETS + code, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(total.ravel()[at])], names=["lang", "bucket", "n"])

    return run


def text_models(df: DataFrame, scratch: Scratch, *, row_id: str, text: str = "text", lang: str = "lang", sample_rows: int = 5_000, block: int = 64) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of ``block`` declared languages, in order of their names, with log P(bucket | language).

    Each language is fitted on about ``sample_rows`` of its rows (all, if it has fewer), chosen by a hash of id and
    text, so reruns agree and a rare language is fitted on as much in a large table as in a small one.
    """
    named = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(5), F.col(row_id), F.col(text)).alias("key"))
    named = named.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    often = scratch.put(named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    langs = sorted(r["lang"] for r in often.select("lang").toLocalIterator())
    unit = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    sample = named.join(often, "lang").where(unit * F.col("n") < sample_rows).select("lang", "text")
    if len(langs) > block:
        sample = scratch.put(sample)
    for at in range(0, len(langs), block):
        part = langs[at : at + block]
        index = {x: i for i, x in enumerate(part)}
        of = sample.where(F.col("lang").isin(part)) if len(langs) > block else sample
        rows = of.mapInArrow(_counts(index), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        total = np.full((len(part), BUCKETS), 0.05)
        total[rows["lang"], rows["bucket"]] += rows["n"]
        yield part, np.log(total / total.sum(axis=1, keepdims=True))


def _score(shared, columns: list[str], evidence: float, before: bool):
    """Log likelihoods, tempered: trigrams overlap, so a text counts as ``evidence`` independent ones at most.

    Those of earlier blocks of languages, if any, come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = np.ascontiguousarray(shared.value.T.astype(np.float32))
        for b in batches:
            for part, data, off in chunks(b, "__text"):
                code, text = _grams(data, off)
                n = np.bincount(text, minlength=part.num_rows)
                out = np.stack([np.bincount(text, weights=model[code, i], minlength=part.num_rows) for i in range(model.shape[1])], axis=1).astype(float)
                out *= (np.minimum(n, evidence) / np.maximum(n, 1))[:, None]
                if before:
                    out = np.concatenate([part.column("ll").flatten().to_numpy().reshape(part.num_rows, -1), out], axis=1)
                at = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n, pa.int64()), lists], names=[*columns, "grams", "ll"])

    return run


def page_evidence(pages: DataFrame, *, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """``(doc_id, markup, suffix, host, domain)`` of raw pages whose address ends in a document's number.

    A document with several pages gets the evidence of the lowest page id; pages without a number are left out.
    """
    bare = F.regexp_replace(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^(?:www\.|m\.)?([^/?#:]+)", 1)
    number = F.regexp_extract(F.regexp_replace(bare, r"[?#].*$", ""), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    markup = F.lower(F.regexp_extract(F.col(html), r"""(?i)<html[^>]*\blang=["']?([A-Za-z]+)""", 1))
    one = F.struct(F.col(page_id).alias("p"), F.nullif(markup, F.lit("")).alias("markup"), F.nullif(F.element_at(F.split(host, r"\."), -1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"))
    return pages.where(number != "").groupBy(number.cast("long").alias("doc_id")).agg(F.min(one).alias("e")).select("doc_id", "e.markup", "e.suffix", "e.host", "e.domain")


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, by: list[str], post: str, n: int, name: str, few: int = 64) -> DataFrame:
    """Sums of the ``n`` places of the arrays ``post`` by group, as one array: one aggregate a place, or, where that
    would be a very wide plan, one row a place."""
    if n <= few:
        return rows.groupBy(*by).agg(F.array(*[F.sum(F.col(post)[i]) for i in range(n)]).alias(name))
    long = rows.select(*by, F.posexplode(post).alias("__i", "__x")).groupBy(*by, "__i").agg(F.sum("__x").alias("__x"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda v: v["__x"]).alias(name))


def _total(rows: DataFrame, post: str, n: int) -> list[float]:
    found = _sums(rows, [], post, n, "t").collect()
    return [float(x or 0.0) for x in (found[0]["t"] if found else None) or [0.0] * n]


def identify(df: DataFrame, pages: DataFrame | None = None, *, row_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", evidence: float = 60.0, smooth: float = 5.0, min_confidence: float = 0.5, sample_rows: int = 5_000, block: int = 64) -> DataFrame:
    """``(row_id, text_hash, language, confidence, text_language, grams, kept)``, one row per row of ``df``.

    ``lang`` and ``source`` name the columns with the declared language and, for rows without a page, the
    host; every declared language is a candidate, ``block`` of them at a time (what the tasks are sent is ``block``
    times 16,384 numbers). ``kept``: the text has letters and the fused posterior reaches ``min_confidence``. A
    text that is null, empty or without letters has no language (null, confidence 0) and is not kept. Null
    declarations are no evidence. Equal posteriors go to the first language by name. Equal rows stay separate rows
    with equal results; rows with a null id are rows like others, without a page; very long texts and pages are read
    whole. An empty table, or one without any declaration, has no languages and keeps nothing. Other columns of
    ``df`` are not looked at.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "lang")
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    own = df.select(F.col(row_id).alias("id"), hashed.alias("text_hash"), F.col(lang).cast("string").alias("declared"), F.col(source).cast("string").alias("source"), F.col(text).alias("__text"))
    columns = ["id", "text_hash", "declared", "source"]
    kinds = f"id {own.schema['id'].dataType.simpleString()}, text_hash long, declared string, source string"
    models = text_models(df, scratch, row_id=row_id, text=text, lang=lang, sample_rows=sample_rows, block=block)
    langs: list[str] = []
    model = next(models, None)
    if model is None:
        return own.select(F.col("id").alias(row_id), "text_hash", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("grams"), F.lit(False).alias("kept"))
    scored = own
    while model is not None:
        after = next(models, None)
        passed, more = (columns, "") if after is None else ([*columns, "__text"], ", __text string")
        shared = spark.sparkContext.broadcast(model[1])
        scored = scored.mapInArrow(_score(shared, passed, evidence, bool(langs)), f"{kinds}{more}, grams long, ll array<double>")
        scored = scratch.put(scored) if after is not None or pages is not None else scored
        langs, model = langs + model[0], after
    n = len(langs)
    if pages is not None:
        seen = scratch.put(page_evidence(pages))
        scored = scored.hint("merge").join(seen.withColumnRenamed("doc_id", "__d").hint("merge"), F.col("id") == F.col("__d"), "left").drop("__d")
    else:
        scored = scored.withColumns({c: F.lit(None).cast("string") for c in ("markup", "suffix", "host", "domain")})
    rows = scratch.put(
        scored.withColumn("host", F.coalesce("host", F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))))).withColumn("domain", F.coalesce("domain", F.lit("source:"))).withColumn("post", _softmax(F.col("ll")))
    )
    voters = rows.where(F.col("grams") > 0)

    # priors: host smoothed by its domain, the domain by all
    hosts = scratch.put(_sums(voters, ["host", "domain"], "post", n, "h"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y * smooth)
    norm = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, v: s + v))
    whole = _total(hosts, "h", n)
    base = F.array(*[F.lit((float(x or 0.0) + 1.0) / (sum(v or 0.0 for v in whole) + n)) for x in whole])
    domains = scratch.put(_sums(hosts, ["domain"], "h", n, "d").select(F.col("domain").alias("__domain"), norm(add(F.col("d"), base)).alias("d")))
    prior = scratch.put(hosts.join(domains, F.col("domain") == F.col("__domain")).select(F.col("host").alias("__host"), F.col("domain").alias("__dom"), F.transform(norm(add(F.col("h"), F.col("d"))), lambda x: F.log(x)).alias("prior")))
    fused = rows.join(prior, (F.col("host") == F.col("__host")) & (F.col("domain") == F.col("__dom")), "left").withColumn("sum", F.zip_with("ll", F.coalesce("prior", F.transform(base, lambda x: F.log(x))), lambda a, b: a + b))

    # P(value | language) of each kind of declaration
    for kind in ("declared", "markup", "suffix"):
        seen = scratch.put(_sums(voters.where(F.col(kind).isNotNull()).select(F.col(kind).alias("__v"), "post"), ["__v"], "post", n, "c"))
        k = seen.count()
        per = F.array(*[F.lit(x + 0.5 * (k + 1)) for x in _total(seen, "c", n)])
        values = scratch.put(seen.select("__v", F.zip_with("c", per, lambda a, t: F.log((a + 0.5) / t)).alias("__e")))
        fused = fused.join(values, F.col(kind) == F.col("__v"), "left").withColumn("sum", F.when(F.col("__e").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "__e", lambda a, b: a + b))).drop("__v", "__e")

    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    known = F.col("grams") > 0
    final = _softmax(F.col("sum"))
    return fused.select(
        F.col("id").alias(row_id),
        "text_hash",
        F.when(known, best(F.col("sum"))).alias("language"),
        F.when(known, F.array_max(final)).otherwise(0.0).alias("confidence"),
        F.when(known, best(F.col("ll"))).alias("text_language"),
        "grams",
        (known & (F.array_max(final) >= min_confidence)).alias("kept"),
    )


def keep_identified(df: DataFrame, pages: DataFrame | None = None, *, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose language is identified, unchanged; rows equal in id and text go or stay together.

    Null and empty texts go, very long ones are read whole, an empty table stays empty; other columns pass as they are.
    """
    found = identify(df, pages, row_id=row_id, text=text, **options)
    gone = Scratch(df.sparkSession, "lang").put(found.where(~F.col("kept")).select(F.col(row_id).alias("__id"), F.col("text_hash").alias("__h")).distinct())
    return df.join(gone, F.col(row_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__h")), "left_anti")


def op8(spark, sf_dir):
    """Every document, with the evidence of the raw pages that carry it."""
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
