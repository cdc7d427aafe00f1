"""Bounded samples of labelled rows for the trained operators.

Training reads at most about SAMPLE_ROWS labelled documents, chosen by a hash of doc_id: a
documented bound, the same rule at every size. Everything scored covers all rows. Rows whose
crc32(doc_id as text) mod 4 is 2 are never read for their labels.

A doc_id with different labels has none that counts; one with several equal labels has one. Of the
rows that share a doc_id one is read, that with the least text, so the bound holds. Null ids and
null labels are left out; a null text is an empty one; empty tables give an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.session import landed

SAMPLE_ROWS = 16_000
_PARTS = 1_000_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc, text, label) of the sample, written out once. The chosen labels are few by construction, so they are broadcast and only the sample's texts are shuffled."""
    label = F.col(f"`{label_col}`").cast("int")
    usable = labels.select(F.col(f"`{id_col}`").alias("doc"), label.alias("label")).where(F.col("doc").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc")))
    usable = usable.groupBy("doc").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc", "label")
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(_PARTS)) < int(share * _PARTS))
    found = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc")
    return landed(found.groupBy("doc").agg(F.min("text").alias("text"), F.min("label").alias("label")), "sample")
