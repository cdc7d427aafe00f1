"""The tables that queries start from, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.sequence import from_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, domain, study, sequence) of all documents, whole texts."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("parent"), F.col("lang").alias("domain"), F.col("source").alias("study"), from_text(F.coalesce("text", F.lit(""))).alias("sequence"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, sequence) of the benchmark's items: the reference set."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("parent"), from_text(F.coalesce("text", F.lit(""))).alias("sequence"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, sequence) of all turns of the conversations, whole texts."""
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("parent"), from_text(F.coalesce("text", F.lit(""))).alias("sequence"))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, start, end, risk, confidence): line items as windows of their order, the highest values of equal windows."""
    li = table(spark, sf_dir, "lineitem")
    each = li.groupBy(F.col("l_orderkey").alias("parent"), (F.col("l_linenumber") * 3).cast("int").alias("start")).agg((F.max("l_discount") * 10).alias("risk"), (F.max("l_tax") * 12.5).alias("confidence"))
    return each.select("parent", "start", (F.col("start") + 9).alias("end"), "risk", "confidence")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, label, score, activity): line items as scored outcomes, with ties: scores are 110,000ths of prices to three digits, rounded half up in whole cents."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_linenumber").alias("grp"), (F.col("l_returnflag") == "R").alias("label"), (F.floor((F.round(F.col("l_extendedprice") * 100) + 5500) / 11000) / 1000).alias("score"), F.col("l_quantity").cast("double").alias("activity"))


SEQUENCES = "(SELECT doc_id AS parent, lang AS domain, source AS study, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BJOUXZ', '') AS sequence FROM documents)"
ITEMS = "(SELECT item_id AS parent, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BJOUXZ', '') AS sequence FROM benchmark)"
TURNS = "(SELECT conv_id * 1000 + turn AS parent, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BJOUXZ', '') AS sequence FROM conversations)"
SCORED_WINDOWS = "(SELECT l_orderkey AS parent, (l_linenumber * 3)::INT AS start, (l_linenumber * 3 + 9)::INT AS \"end\", max(l_discount) * 10 AS risk, max(l_tax) * 12.5::DOUBLE AS confidence FROM lineitem GROUP BY ALL)"
OUTCOMES = "(SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS id, l_linenumber AS grp, l_returnflag = 'R' AS label, floor((round(l_extendedprice * 100) + 5500) / 11000) / 1000 AS score, l_quantity::DOUBLE AS activity FROM lineitem)"
