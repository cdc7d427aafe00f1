"""Tabular sources and sinks with their checks (S-06 to S-09, S-11, S-12, S-14, S-15, P-09, X-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.scores import score_or_ic50
from windloom.functions.sequence import canonical
from windloom.operators.quality import coverage


class ContractError(ValueError):
    pass


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """X-01's stop: missing columns are an error; extra ones are left alone."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def read_cohort(spark: SparkSession, path: str, required: list[str], sequence: str = "sequence") -> DataFrame:
    """S-08: a CSV cohort with its required columns, control rows (no sequence) left out."""
    return require(spark.read.csv(path, header=True, escape='"'), required).where(F.col(sequence).isNotNull())


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """S-09: landed provider responses (TSV): 1-based inclusive spans become 0-based half-open, the score comes from the score or the IC50."""
    raw = spark.read.csv(path, sep="\t", header=True, escape='"')
    for c in ("score", "ic50"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    num = lambda c: F.col(c).try_cast("double")
    return raw.withColumns({"hit_start": F.col("start").cast("int") - 1, "hit_end": F.col("end").cast("int"), "value": score_or_ic50(num("score"), num("ic50"))})


def load_parents(df: DataFrame, parent: str = "parent", sequence: str = "sequence") -> DataFrame:
    """P-09: parents in upper case; repeated ids or other letters are an error, found in one pass."""
    up = require(df, [parent, sequence]).withColumn(sequence, F.upper(sequence))
    n, ids, bad = up.agg(F.count(F.lit(1)), F.count_distinct(parent), F.count_if(~F.coalesce(canonical(F.col(sequence)), F.lit(False)))).first()
    if n != ids or bad:
        raise ContractError(f"{n - ids} repeated parents, {bad} with other residues")
    return up


def runs(spark: SparkSession, path: str) -> DataFrame:
    """S-12: a JSONL run manifest (target, elapsed_s) summed by target."""
    return spark.read.schema("target string, elapsed_s double").json(path).groupBy("target").agg(F.count(F.lit(1)).alias("chunks"), F.sum("elapsed_s").alias("elapsed_s"))


def write_dataset(df: DataFrame, path: str, by: str = "split") -> None:
    """S-14: Parquet, partitioned; rows of a partition value may go to several files."""
    df.write.partitionBy(by).parquet(path)


def card(df: DataFrame, labels: list[str], groups: list[str]) -> DataFrame:
    """X-04: (section, name, value) of a dataset: rows, counts by group, coverage of labels. One small table for S-15."""
    out = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("section"), F.lit("all").alias("name"), "value")
    for g in groups:
        out = out.unionByName(df.groupBy(F.coalesce(F.col(g).cast("string"), F.lit("null")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(g).alias("section"), "name", "value"))
    cov = coverage(df, labels)
    for c in ("present", "missing", "mean", "std", "min", "max"):
        out = out.unionByName(cov.select(F.lit(c).alias("section"), "name", F.col(c).cast("double").alias("value")))
    return out


def report(found: DataFrame) -> str:
    """S-15: a card as Markdown; a card has a few rows for each group value."""
    lines = ["| section | name | value |", "| --- | --- | --- |"]
    lines += [f"| {r['section']} | {r['name']} | {r['value']:.6g} |" if r["value"] is not None else f"| {r['section']} | {r['name']} | |" for r in found.orderBy("section", "name").collect()]
    return "\n".join(lines)


def sequence_map(rows: DataFrame, column: str = "value") -> DataFrame:
    """S-11: (accession, sequence) from JSON objects {accession: sequence}, one in each row; a landed table takes the place of a cache file."""
    return rows.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("accession", "sequence"))


def read_sequence_map(spark: SparkSession, path: str) -> DataFrame:
    """S-11: the same from files that hold one object each."""
    return sequence_map(spark.read.text(path, wholetext=True))


def contract_order(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """P-13: the contract's columns in its order, from the columns named for them; missing ones are an error."""
    return require(df, list(columns.values())).select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
