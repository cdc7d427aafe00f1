"""FASTA in and out, PDB atoms and assay exports (S-01 to S-05, S-13, S-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.sequence import clean_or_reject


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, ord): records split at line starts; only a file's first one keeps its >. ord ascends through each file and from file to file by name."""
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), order.alias("ord"))


def _parsed(records: DataFrame, *more: str) -> DataFrame:
    records = records.where(F.col("value").rlike(r"\S"))
    record = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.split_part(record, F.lit("\n"), F.lit(1)))
    body = F.when(F.instr(record, "\n") > 0, F.substr(record, F.instr(record, "\n") + 1)).otherwise("")
    out = records.select(header.alias("header"), F.regexp_replace(body, r"\s", "").alias("sequence"), *more)
    accession = F.when(F.contains("header", F.lit("|")), F.split_part("header", F.lit("|"), F.lit(2))).otherwise(F.col("header"))
    return out.select("header", F.element_at(F.split("header", r"\s+"), 1).alias("id"), accession.alias("accession"), "sequence", *more)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """S-01, S-03, S-04: (header, id, accession, sequence); a > inside a header stays. The accession is what stands between the first bars, or the whole header. Gzipped files are read whole and spread afterwards. Text in front of a file's first header comes as a record; `headless` names such files."""
    return _parsed(_records(spark, path).repartition(max(1, spark.sparkContext.defaultParallelism)))


def headless(spark: SparkSession, path: str) -> DataFrame:
    """S-02: files that begin with something else than a header; one row a file is compared, never its records."""
    starts = _records(spark, path).select("file", "ord", F.col("value").rlike(r"^\s*(>|$)").alias("ok"))
    return starts.groupBy("file").agg(F.min_by("ok", "ord").alias("ok")).where("not ok").select("file")


def read_clean_fasta(spark: SparkSession, path: str) -> DataFrame:
    """S-02: (id, sequence): cleaned sequences by the first token of their header, the last of equal ids that has a sequence.

    Records without an id, without a sequence or with other letters are left out. A sequence in front of
    the first header of a file, or a path without a record, is an error.
    """
    bad = headless(spark, path).limit(5).collect()
    if bad:
        raise ValueError(f"a sequence stands before its header in {[r['file'] for r in bad]}")
    records = _records(spark, path)
    if records.where(F.col("value").rlike(r"\S")).isEmpty():
        raise ValueError(f"no FASTA records in {path}")
    found = _parsed(records, "ord").where("id <> '' and sequence <> ''")
    last = found.groupBy("id").agg(F.max_by("sequence", "ord").alias("sequence"))
    return last.withColumn("sequence", clean_or_reject(F.col("sequence"))).where("sequence <> ''")


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq: str = "sequence", width: int | None = None, compression: str = "none") -> None:
    """S-16: one record a row, in the table's order; lines of `width` letters, or one line."""
    body = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n") if width else F.col(seq)
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), body).alias("value")).write.option("compression", compression).text(path)


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """S-13: (file, line, name, residue, chain, number, x, y, z, element) by fixed columns of ATOM and HETATM lines; a number that cannot be read is null."""
    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    atoms = files.where(F.substring("text", 1, 6).isin("ATOM  ", "HETATM"))
    cut = lambda a, n: F.trim(F.substring("text", a, n))
    return atoms.select("file", "line", cut(13, 4).alias("name"), cut(18, 3).alias("residue"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("number"), *[cut(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))], cut(77, 2).alias("element"))


#: The columns of the assay export, by position.
ASSAY_COLUMNS = {10: "object_type", 11: "peptide", 19: "source_molecule", 23: "source_organism", 43: "host", 122: "qualitative", 141: "mhc_allele", 145: "mhc_class"}


def read_assays(spark: SparkSession, path: str) -> DataFrame:
    """S-05, P-06: the export's named columns as strings, and `ord`, which ascends in file order; human class-II linear peptides with a positive or negative outcome. The two header rows meet none of these conditions. Quotes inside fields are doubled; a field holds no line break, so files split."""
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    df = spark.read.csv(path, header=False, escape='"').select(*[F.col(f"_c{i}").alias(c) for i, c in ASSAY_COLUMNS.items()], order.alias("ord"))
    return df.where((F.col("object_type") == "Linear peptide") & (F.col("mhc_class") == "II") & F.contains("host", F.lit("Homo sapiens")) & (F.startswith("qualitative", F.lit("Positive")) | F.startswith("qualitative", F.lit("Negative"))))


def read_predictions(spark: SparkSession, path: str, row: str = "start int, end int, score double") -> DataFrame:
    """S-10: a JSON artefact {predictions_by_sha256: {hash: [rows]}} as one row per hash and prediction."""
    df = spark.read.json(path, multiLine=True, schema=f"predictions_by_sha256 map<string, array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in row.split(','))}>>>")
    return df.select(F.explode("predictions_by_sha256").alias("sha256", "rows")).select("sha256", F.inline("rows"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """S-17: (path, sha256, length) of files; join to a manifest to find changed and missing ones."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
