"""The training-data pipeline: five stages over documents, each written as Parquet and read again.

Null and empty texts pass every stage and end in no bin. Rows without a doc_id are judged for
toxicity, lines and contamination and always pass near dedup; rows that share one go or stay
together there. An empty table passes as an empty one. Extra columns are carried to the last stage,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm import decontaminate, labelled, line_dedup, near_dedup, packing, toxicity
from windloom.llm.common import unused
from windloom.session import landed

TOXIC_AT = 0.3
#: Words of a shingle, and the least Jaccard likeness in a hundred.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. The lexicon is learned from the stage's own documents and their labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(labelled.training_rows(docs, labels, "toxic"))
    judged = unused("toxicity", docs)
    scored = toxicity.matched(docs, lexicon, out=judged)
    return scored.where(F.col(f"{judged}.score") < TOXIC_AT).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines, short ones too, that an earlier document keeps; n_chars follows the text."""
    left = line_dedup.remove_boilerplate(docs, min_chars=line_dedup.EVERY_LINE)
    return with_length(left, docs)


def with_length(found: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars of the present text, where the documents have that column."""
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; rows without a doc_id stay."""
    gone = near_dedup.near_duplicates(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves."""
    judged = unused("contamination", docs)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=judged)
    return found.where(~decontaminate.is_contaminated(F.col(judged))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, row, piece, word_start, n_words, bin_id, bin_offset."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", contamination_stage),
    ("packing", packing_stage),
]

#: A learned lexicon, components and best-fit order are beyond plain SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
