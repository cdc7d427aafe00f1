"""Identity and provenance columns of candidate windows (P-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.functions.sequence import digest

# Licenses, studies by domain, addresses, the encoder, and label columns that are filled in later.
NATURAL, LICENSE_NATURAL, LICENSE_DESIGNED = "natural_", "CC-BY-4.0 (UniProt)", "CC0-1.0 (RCSB PDB, public domain)"
STUDIES = {"natural_human": "uniprot_human_reference_v1", "natural_viral": "uniprot_viral_reference_v1", "natural_bacterial": "uniprot_bacterial_reference_v1"}
STUDY_DESIGNED = "rcsb_de_novo_v1"
URI_NATURAL, URI_DESIGNED = "https://www.uniprot.org/uniprotkb/", "https://www.rcsb.org/structure/"
ALLELE, ENCODER = "HLA-A*02:01", "esm2_t33_650M_UR50D"
LABELS = ("cleave_n_prob", "cleave_c_prob", "tap_log_ic50_relative", "mhc_affinity_nm", "mhc_percentile")


def cache_key(peptide: Column, n_flank: Column, c_flank: Column, encoder: str = ENCODER) -> Column:
    """P-08: the key of a window's embedding: 24 digits over encoder, flank, peptide and flank."""
    return digest(24, F.lit(encoder), n_flank, peptide, c_flank)


def finish(windows: DataFrame, allele: str = ALLELE, generated: Column | None = None) -> DataFrame:
    """P-07: windows (parent, start, end, peptide, n_flank, c_flank, domain) with row id, license, study, address, encoder key, constants, and null labels where there are none yet.

    A domain that is null or unknown counts as designed. Everything is an expression of the row: no join, no shuffle.
    """
    c = F.col
    natural = F.coalesce(F.startswith("domain", F.lit(NATURAL)), F.lit(False))
    study = F.lit(STUDY_DESIGNED)
    for domain, name in STUDIES.items():
        study = F.when(c("domain") == domain, name).otherwise(study)
    entry = F.split_part(F.regexp_replace("parent", "^rcsb_", ""), F.lit("_"), F.lit(1))
    made = {
        "row_id": F.concat(c("parent"), F.lit(":"), c("start").cast("string"), F.lit("-"), c("end").cast("string")),
        "hla_allele": F.lit(allele),
        "label_origin": F.lit("teacher"),
        "label_model_version": F.lit(""),
        "license": F.when(natural, LICENSE_NATURAL).otherwise(LICENSE_DESIGNED),
        "study_id": study,
        "source_uri": F.when(natural, F.concat(F.lit(URI_NATURAL), F.regexp_replace("parent", "^uniprot_", ""))).otherwise(F.concat(F.lit(URI_DESIGNED), entry)),
        "generated_at": F.current_timestamp() if generated is None else generated,
        "encoder_model_id": F.lit(ENCODER),
        "pooling_recipe": F.lit("mean_9mer"),
        "embedding_cache_key": cache_key(c("peptide"), c("n_flank"), c("c_flank")),
        "has_structure_track": F.lit(False),
    }
    return windows.withColumns(made | {x: F.lit(None).cast("double") for x in LABELS if x not in windows.columns})
