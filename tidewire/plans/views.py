"""The library's tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.storage import table


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rounds: customer = company, total / 1000 = millions, priority = stage."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("link"), F.col("o_custkey").cast("string").alias("slug"), (F.col("o_totalprice") / 1000).alias("amount_m"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("lead"), F.when(F.col("o_orderstatus") == "F", "USD").otherwise("EUR").alias("currency"), F.concat(F.lit("desk"), (F.col("o_orderkey") % 7).cast("string")).alias("source"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their market and kind."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_name").alias("name"), F.col("n_name").alias("market"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("kind"))


def stories(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stories about their customer."""
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderkey").alias("link"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as mentions: supplier in an order."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slug"), F.col("l_orderkey").alias("link"), F.col("l_partkey").alias("part"))


def deals(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as deals: customer buys supplier, price unknown for returned ones."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("link"), F.concat(F.lit("C"), F.col("o_custkey")).alias("acquirer"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("target"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / 1000).alias("amount_m"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.concat(F.lit("desk"), (F.col("l_orderkey") % 5).cast("string")).alias("source"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: first line = title, one hour apart."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("link"), F.substring_index(t, "\n", 1).alias("title"), "source", "lang", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("published_at"), F.col("doc_id").alias("pos"), "n_chars")


SQL = {
    "rounds": "rounds AS (SELECT o_orderkey AS link, CAST(o_custkey AS VARCHAR) AS slug, o_totalprice / 1000 AS amount_m, o_orderdate AS published_at, o_orderpriority AS stage, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS lead, CASE WHEN o_orderstatus = 'F' THEN 'USD' ELSE 'EUR' END AS currency, concat('desk', o_orderkey % 7) AS source FROM orders)",
    "companies": "companies AS (SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, n_name AS market, r_name AS region, c_mktsegment AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "stories": "stories AS (SELECT CAST(o_custkey AS VARCHAR) AS slug, o_orderkey AS link FROM orders)",
    "mentions": "mentions AS (SELECT l_suppkey AS slug, l_orderkey AS link, l_partkey AS part FROM lineitem)",
    "deals": "deals AS (SELECT l_orderkey * 100 + l_linenumber AS link, concat('C', o_custkey) AS acquirer, concat('S', l_suppkey) AS target, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS amount_m, o_orderdate AS published_at, concat('desk', l_orderkey % 5) AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "articles": "articles AS (SELECT doc_id AS link, split_part(coalesce(text, ''), chr(10), 1) AS title, source, lang, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published_at, doc_id AS pos, n_chars FROM documents)",
}


def with_views(*names: str) -> str:
    """``WITH`` and the named views in SQL."""
    return "WITH " + ", ".join(SQL[n] for n in names)
