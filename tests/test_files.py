"""Readers, sinks, identity columns and pooling on odd files and rows."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from windloom.operators import collapse, identity, structure, tile
from windloom.sources import fasta, tables

# ---- FASTA -----------------------------------------------------------------------------------


def test_clean_fasta_keeps_the_last_sequence_of_each_name(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("\n>x one\nacd\n EFG \n>y\nACDX\n>z\n\n>w\nMGSACDHHHHHH\n>\nACD\n>v\nAA\n")
    (tmp_path / "b.fasta").write_text(">x two\nWWW\n>v\n\n>y again\nACB\n")
    got = {r["id"]: r["sequence"] for r in fasta.read_clean_fasta(spark, str(tmp_path)).collect()}
    assert got == {"x": "WWW", "w": "ACD", "v": "AA"}


def test_a_sequence_before_its_header_is_an_error(spark, tmp_path):
    (tmp_path / "good.fasta").write_text(">x\nACD\n")
    with gzip.open(tmp_path / "bad.fasta.gz", "wt") as f:
        f.write("ACD\n>y\nEFG\n")
    with pytest.raises(ValueError, match="bad.fasta.gz"):
        fasta.read_clean_fasta(spark, str(tmp_path))
    assert fasta.headless(spark, str(tmp_path / "good.fasta")).count() == 0


def test_a_file_without_records_is_an_error(spark, tmp_path):
    (tmp_path / "empty.fasta").write_text("\n \n")
    with pytest.raises(ValueError, match="no FASTA records"):
        fasta.read_clean_fasta(spark, str(tmp_path))


def test_names_repeated_across_splits_of_one_file(spark, tmp_path):
    n = 3000
    (tmp_path / "a.fasta").write_text("".join(f">n{i % 7}\n{'ACDEFGHIKL'[i % 10]}{'A' * 20}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["id"]: r["sequence"] for r in fasta.read_clean_fasta(spark, str(tmp_path)).collect()}
        count = fasta.read_fasta(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"n{i % 7}": "ACDEFGHIKL"[i % 10] + "A" * 20 for i in range(n)} and count == n


@pytest.mark.parametrize("compression,suffix", [("none", ".txt"), ("gzip", ".txt.gz")])
def test_wrapped_lines_come_back_whole(spark, tmp_path, compression, suffix):
    rows = [("a b", "A" * 10), ("b", "C" * 11), ("c", ""), ("d", "D" * 5), ("e", "E" * 30)]
    path = tmp_path / "out"
    fasta.write_fasta(spark.createDataFrame(rows, "id string, sequence string"), str(path), width=10, compression=compression)
    assert any(p.name.endswith(suffix) for p in path.iterdir())
    found = fasta.read_fasta(spark, str(path)).collect()
    assert sorted((r["header"], r["sequence"]) for r in found) == rows
    assert {r["accession"] for r in found if r["header"] == "a b"} == {"a b"}


# ---- assays, cohorts, models -----------------------------------------------------------------


def line(**cells):
    row = [""] * 146
    for i, name in fasta.ASSAY_COLUMNS.items():
        row[i] = cells.get(name, {"object_type": "Linear peptide", "mhc_class": "II", "host": "Homo sapiens", "qualitative": "Negative"}.get(name, ""))
    return ",".join('"' + x.replace('"', '""') + '"' if x else "" for x in row)


def test_assays_roll_up_in_file_order(spark, tmp_path):
    p = "ACDEFGHIKLMNP"
    lines = [
        ",".join(["Assay"] * 146), ",".join(["Object Type"] * 146),
        line(peptide=p, source_organism='the "first", known'),
        line(peptide=p.lower(), qualitative="Positive-Low", source_molecule="m", source_organism="later"),
        line(peptide=p, qualitative="Unknown", source_molecule="unseen"),
        line(peptide=p, host="Mus musculus"), line(peptide=p, mhc_class="I"), line(peptide=p, object_type="Other"),
        line(peptide="C" * 12), line(peptide="C" * 22), line(peptide="C" * 14 + "X"), line(peptide=""),
        line(peptide="C" * 21),
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = {r["peptide"]: tuple(r)[1:] for r in collapse.assay_peptides(fasta.read_assays(spark, str(tmp_path / "a.csv"))).collect()}
    assert got == {p: (1, 1, True, "m", 'the "first", known'), "C" * 21: (0, 1, False, "", "")}


def test_the_first_known_value_follows_the_files(spark, tmp_path):
    p = "ACDEFGHIKLMNP"
    (tmp_path / "2.csv").write_text(line(peptide=p, source_molecule="second") + "\n")
    (tmp_path / "1.csv").write_text((line(peptide=p) + "\n") * 50 + line(peptide=p, source_molecule="first") + "\n")
    row = collapse.assay_peptides(fasta.read_assays(spark, str(tmp_path))).first()
    assert (row["source_molecule"], row["source_organism"], row["n_neg"]) == ("first", "", 52)


def test_a_cohort_lacks_a_column_or_holds_controls(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,sequence,note\n1,ACD,"a ""b"", c"\n2,,control\n')
    got = tables.read_cohort(spark, str(tmp_path / "c.csv"), ["id", "sequence"]).collect()
    assert [(r["id"], r["note"]) for r in got] == [("1", 'a "b", c')]
    with pytest.raises(tables.ContractError, match="arm"):
        tables.read_cohort(spark, str(tmp_path / "c.csv"), ["id", "arm"])


def test_model_lines_that_cannot_be_read(spark, tmp_path):
    atom = "ATOM      1  CA  MET A  ??      11.000   nan    -3.250  1.00 20.00           C\nHETATM\nREMARK\n"
    (tmp_path / "m.pdb").write_text(atom)
    got = fasta.read_pdb_atoms(spark, str(tmp_path / "m.pdb")).orderBy("line").collect()
    assert len(got) == 2 and got[0]["number"] is None and got[0]["x"] == 11.0 and got[1]["x"] is None and got[1]["chain"] == ""


def test_hotspots_by_status(spark):
    residues = spark.createDataFrame([("A", 5, "MET"), ("A", -3, "GLY"), ("B", 7, "SER"), ("B", 7, "ALA"), ("1", 2, "LEU")], "chain string, number int, residue string")
    asked = spark.createDataFrame([(x,) for x in ("A5", " A-3 ", "B7", "12", "A6", "AB7", "A", "", "A99999999999", None)], "hotspot string")
    got = {r["hotspot"]: (r["residue"], r["status"]) for r in structure.hotspots(asked, residues, "A").collect()}
    bad = (None, "invalid")
    assert got == {"A5": ("MET", "ok"), " A-3 ": ("GLY", "ok"), "B7": ("ALA", "other chain"), "12": ("LEU", "other chain"), "A6": (None, "absent"), "AB7": bad, "A": bad, "": bad, "A99999999999": bad, None: bad}
    assert structure.hotspots(asked, residues).where("status = 'ok'").count() == 4
    assert structure.hotspots(asked.limit(0), residues).count() == 0


# ---- identity and pooling --------------------------------------------------------------------


def test_identity_columns_by_domain(spark):
    rows = [("uniprot_P1", 1, 10, "ACDEFGHIK", "A", None, "natural_human"), ("rcsb_1abc_A", 2, 11, "CDEFGHIKL", None, "W", "de_novo"), ("p", 3, 12, "DEFGHIKLM", "", "", None), ("uniprot_Q", 4, 13, "EFGHIKLMN", "", "", "natural_fungal")]
    df = spark.createDataFrame(rows, "parent string, start int, end int, peptide string, n_flank string, c_flank string, domain string")
    got = {r["parent"]: r for r in identity.finish(df.withColumn("mhc_percentile", F.lit(0.5))).collect()}
    assert {p: (r["row_id"], r["study_id"], r["source_uri"]) for p, r in got.items()} == {
        "uniprot_P1": ("uniprot_P1:1-10", "uniprot_human_reference_v1", "https://www.uniprot.org/uniprotkb/P1"),
        "rcsb_1abc_A": ("rcsb_1abc_A:2-11", "rcsb_de_novo_v1", "https://www.rcsb.org/structure/1abc"),
        "p": ("p:3-12", "rcsb_de_novo_v1", "https://www.rcsb.org/structure/p"),
        "uniprot_Q": ("uniprot_Q:4-13", "rcsb_de_novo_v1", "https://www.uniprot.org/uniprotkb/Q"),
    }
    assert got["uniprot_P1"]["embedding_cache_key"] == hashlib.sha256(b"esm2_t33_650M_UR50D|A|ACDEFGHIK|").hexdigest()[:24]
    assert got["p"]["mhc_percentile"] == 0.5 and got["p"]["cleave_n_prob"] is None and got["p"]["license"] == identity.LICENSE_DESIGNED and got["uniprot_Q"]["license"] == identity.LICENSE_NATURAL


def test_pooling_keeps_the_first_source(spark):
    a = spark.createDataFrame([("a2", 2, "MACDEFGHIKL"), ("a1", 1, "MMACDEFGHIKX")], "parent string, n int, sequence string")
    b = spark.createDataFrame([("b1", 1, "WACDEFGHIKLMNP"), ("b2", 2, None), ("b3", 3, "")], "parent string, n int, sequence string")
    got = {r["peptide"]: (r["parent"], r["start"], r["domain"]) for r in tile.pool_sources({"first": a, "second": b}, "n").collect()}
    assert got["ACDEFGHIK"] == ("a2", 1, "first")  # the other parent's window has an X in its flank
    assert got["CDEFGHIKL"] == ("a2", 2, "first") and got["DEFGHIKLM"] == ("b1", 3, "second")
    swapped = {r["peptide"]: r["parent"] for r in tile.pool_sources({"second": b, "first": a}, "n").collect()}
    assert swapped["ACDEFGHIK"] == "b1" and set(swapped) == set(got)
