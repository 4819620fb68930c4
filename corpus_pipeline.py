"""Raw documents to training shards: five stages, each of which works on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stages are written as Parquet in the shared folder and read back, so a lost executor never
costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.decontamination import decontaminate
from tidewire.llm.language_id import keep_identified
from tidewire.llm.minhash import deduplicate
from tidewire.llm.mixing import mix_sources
from tidewire.llm.sharding import shard_rows
from tidewire.storage import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or with an uncertain language go.

    Null and empty texts go; null declarations and ids are no hindrance; equal rows go or stay together; very long texts
    are read whole; an empty table, or one without declared languages, keeps nothing; other columns pass as they are.
    """
    return keep_identified(docs, table(spark, sf_dir, "pages"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, null first.

    A null, empty or wordless text is like no other and stays; of rows equal in id and text one stays; very long texts
    are compared whole; an empty table stays empty; other columns pass as they are.
    """
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut from texts; documents that are mostly benchmark go.

    Clean rows, null and empty texts among them, pass as they are, but for ``n_chars``, which counts the text that is
    left (null for a null text); equal rows fare alike; an empty table stays empty; other columns pass as they are.
    """
    cut = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a row appears as often as the mix takes it, three times at most.

    Null and empty texts have no words and are not taken; a null source is a source; equal rows are taken alike; an
    empty table stays empty; other columns, whatever their names, pass as they are.
    """
    own = {c: f"__doc_{c}" for c in ("size", "source_size", "target", "taken", "copies") if c in docs.columns}
    mixed = mix_sources(docs.withColumnsRenamed(own)).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return mixed.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into 16 shards with counts at most one apart, and the slot in the shard.

    Nulls are values, equal rows stay separate rows, very long texts are rows like others; an empty table stays empty;
    columns named shard and slot are replaced, others pass as they are.
    """
    return shard_rows(docs, 16, identity=docs.columns)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No stage but the last is within reach of SQL on whole tables; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
