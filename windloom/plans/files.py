"""Queries through files: tables are written in a source's format into the shared folder and read back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import sequence as S
from windloom.operators import collapse, identity, structure, tile
from windloom.plans.views import ITEMS, TURNS, items, table
from windloom.session import workspace
from windloom.sources import fasta, tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


c = F.col


def folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


_HEADER = "CASE WHEN lang IS NULL THEN 'doc' || doc_id || ' of ' ELSE 'sp|D' || doc_id || '|' || lang || ' a > b ' END || coalesce(source, '')"


@query(f"""SELECT header, regexp_extract(header, '^\\S+') AS id, 'uniprot_' || CASE WHEN contains(header, '|') THEN split_part(header, '|', 2) ELSE header END AS accession, length(s)::INT AS length, sha256(s) AS digest
    FROM (SELECT trim({_HEADER}) AS header, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS s FROM documents)""")
def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    """S-01, S-04, S-16: whole documents as FASTA in lines of sixty letters, read back: headers, first tokens, accessions and joined sequences."""
    docs, path = table(spark, d, "documents"), folder(spark, "fasta")
    number = c("doc_id").cast("string")
    head = F.when(c("lang").isNull(), F.concat(F.lit("doc"), number, F.lit(" of "))).otherwise(F.concat(F.lit("sp|D"), number, F.lit("|"), c("lang"), F.lit(" a > b ")))
    rows = docs.select(F.concat(head, F.coalesce("source", F.lit(""))).alias("id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("sequence"))
    fasta.write_fasta(rows, path, width=60)
    found = fasta.read_fasta(spark, path)
    return found.select("header", "id", F.concat(F.lit("uniprot_"), "accession").alias("accession"), F.char_length("sequence").alias("length"), F.sha2("sequence", 256).alias("digest"))


_RAW = "CASE WHEN c_acctbal < 0 THEN '' WHEN c_nationkey % 3 = 0 THEN 'mgs' || lower(c_mktsegment) || 'hhhhhh' ELSE c_mktsegment || repeat('ACD', c_nationkey) END"


@query(f"""WITH r AS (SELECT 'n' || floor(c_acctbal / 10)::BIGINT AS id, arg_max({_RAW}, c_custkey) AS raw FROM customer WHERE {_RAW} <> '' GROUP BY 1), k AS (SELECT id, regexp_replace(upper(trim(raw)), '{S.TAGS}', '', 'g') AS sequence FROM r)
    SELECT * FROM k WHERE regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+')""")
def fasta_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """S-02, S-03: gzipped FASTA with repeated names, tags, empty and invalid sequences: the last of each name, cleaned, invalid ones left out."""
    n, path = c("c_nationkey"), folder(spark, "fasta")
    raw = F.when(c("c_acctbal") < 0, "").when(n % 3 == 0, F.concat(F.lit("mgs"), F.lower("c_mktsegment"), F.lit("hhhhhh"))).otherwise(F.concat("c_mktsegment", F.expr("repeat('ACD', c_nationkey)")))
    named = F.concat(F.lit("n"), F.floor(c("c_acctbal") / 10).cast("string"), F.lit(" of "), "c_name")
    fasta.write_fasta(table(spark, d, "customer").orderBy("c_custkey").select(named.alias("id"), raw.alias("sequence")), path, compression="gzip")
    return fasta.read_clean_fasta(spark, path)


_PEPTIDE = "substr(repeat('ACDEFGHIKLMNPQRSTVWY', 3), (1 + o_custkey % 20)::INT, (10 + o_custkey % 13)::INT) || CASE WHEN o_custkey % 11 = 0 THEN 'X' ELSE '' END"


@query(f"""WITH a AS (SELECT o_orderkey, upper({_PEPTIDE}) AS peptide, CASE WHEN o_orderkey % 4 > 0 THEN 'molecule ' || o_orderkey END AS m, CASE WHEN o_custkey % 20 > 2 THEN 'organism, "' || o_orderstatus || '"' END AS o, o_orderpriority < '3' AS pos FROM orders WHERE o_custkey % 17 > 0 AND o_orderstatus <> 'P' AND o_custkey % 13 > 1 AND o_orderpriority < '5')
    SELECT peptide, count(*) FILTER (WHERE pos)::BIGINT AS n_pos, count(*) FILTER (WHERE NOT pos)::BIGINT AS n_neg, bool_or(pos) AS label, coalesce(arg_min(m, o_orderkey) FILTER (WHERE m IS NOT NULL), '') AS source_molecule, coalesce(arg_min(o, o_orderkey) FILTER (WHERE o IS NOT NULL), '') AS source_organism
    FROM a WHERE regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]+') AND length(peptide) BETWEEN 13 AND 21 GROUP BY peptide""")
def assay_export(spark: SparkSession, d: str) -> DataFrame:
    """S-05, P-06, A-04: orders as an assay export of 146 columns, read by position, filtered, cleaned and rolled up to peptides with the first known molecule and organism in file order."""
    o, cust = table(spark, d, "orders"), c("o_custkey")
    cut = F.substr(F.lit("ACDEFGHIKLMNPQRSTVWY" * 3), (1 + cust % 20).cast("int"), (10 + cust % 13).cast("int"))
    peptide = F.concat(cut, F.when(cust % 11 == 0, "X").otherwise(""))
    outcome = {"1": "Positive-High", "2": "Positive", "3": "Negative", "4": "Negative"}
    qualitative = F.lit(None).cast("string")
    for first, name in outcome.items():
        qualitative = F.when(F.startswith("o_orderpriority", F.lit(first)), name).otherwise(qualitative)
    made = {
        "object_type": F.when(cust % 17 > 0, "Linear peptide").otherwise("Discontinuous"),
        "peptide": F.when(c("o_orderkey") % 2 == 0, F.lower(peptide)).otherwise(peptide),
        "source_molecule": F.when(c("o_orderkey") % 4 > 0, F.concat(F.lit("molecule "), c("o_orderkey").cast("string"))),
        "source_organism": F.when(cust % 20 > 2, F.concat(F.lit('organism, "'), "o_orderstatus", F.lit('"'))),
        "host": F.when(cust % 13 == 0, "Mus musculus").when(cust % 13 > 1, "Homo sapiens (human)"),
        "qualitative": qualitative,
        "mhc_class": F.when(c("o_orderstatus") != "P", "II").otherwise("I"),
    }
    cells = [made.get(fasta.ASSAY_COLUMNS.get(i, ""), F.lit(None).cast("string")).alias(f"column {i}") for i in range(146)]
    path = folder(spark, "assays")
    o.orderBy("o_orderkey").select(*cells).write.option("escape", '"').csv(path, header=True)
    return collapse.assay_peptides(fasta.read_assays(spark, path))


@query("SELECT c_custkey::VARCHAR AS id, lower(c_mktsegment) AS sequence, c_nationkey::VARCHAR AS grp FROM customer WHERE c_acctbal >= 0")
def cohort(spark: SparkSession, d: str) -> DataFrame:
    """S-08: a CSV cohort with its required columns; rows without a sequence are controls."""
    path = folder(spark, "cohort")
    table(spark, d, "customer").select(c("c_custkey").alias("id"), F.when(c("c_acctbal") >= 0, F.lower("c_mktsegment")).alias("sequence"), c("c_nationkey").alias("grp"), "c_name").write.csv(path, header=True)
    return tables.read_cohort(spark, path, ["id", "sequence", "grp"]).select("id", "sequence", "grp")


@query("""SELECT l_orderkey AS id, l_linenumber - 1 AS hit_start, l_linenumber + 8 AS hit_end, round(CASE WHEN l_returnflag = 'A' THEN l_discount ELSE least(1, greatest(0, 1 - ln(greatest(l_extendedprice, 1)) / ln(50000))) END, 6) AS value FROM lineitem""")
def provider_responses(spark: SparkSession, d: str) -> DataFrame:
    """S-09: line items as a provider's answers, some with a score and some with an IC50 alone; 1-based spans become half-open."""
    path, n, scored = folder(spark, "responses"), c("l_linenumber"), c("l_returnflag") == "A"
    table(spark, d, "lineitem").select(c("l_orderkey").alias("id"), n.alias("start"), (n + 8).alias("end"), F.when(scored, c("l_discount")).alias("score"), F.when(~scored, c("l_extendedprice")).alias("ic50")).write.csv(path, header=True, sep="\t")
    return tables.read_responses(spark, path).select(c("id").cast("long").alias("id"), "hit_start", "hit_end", F.round("value", 6).alias("value"))


@query("SELECT o_orderkey, (l_linenumber * 3)::INT AS start, (l_linenumber * 3 + 9)::INT AS \"end\", l_discount AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def hashed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """S-10: artefacts of predictions by the hash of their sequence, a few thousand orders a file, joined back to the sequences."""
    path, text = folder(spark, "predictions"), lambda k: F.sha2(F.concat(F.lit("seq"), c(k).cast("string")), 256)
    li, start = table(spark, d, "lineitem"), (c("l_linenumber") * 3).cast("int")
    each = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(start.alias("start"), (start + 9).alias("end"), c("l_discount").alias("score"))).alias("rows"))  # lines of one order
    made = each.groupBy(F.floor(c("l_orderkey") / 2000).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(text("l_orderkey"), "rows"))).alias("predictions_by_sha256"))
    made.select("part", F.to_json(F.struct("predictions_by_sha256")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    found = fasta.read_predictions(spark, path)
    return table(spark, d, "orders").select("o_orderkey", text("o_orderkey").alias("sha256")).join(found.hint("merge"), "sha256").drop("sha256")


@query("SELECT o_orderpriority AS target, count(*) AS chunks, round(sum(CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 1000, 1) END), 3) AS elapsed_s FROM orders GROUP BY 1")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """S-12: a manifest of JSON lines, some without a time, summed by target."""
    path = folder(spark, "runs")
    table(spark, d, "orders").select(c("o_orderpriority").alias("target"), c("o_orderkey").alias("chunk"), F.when(c("o_orderstatus") != "P", F.round(c("o_totalprice") / 1000, 1)).alias("elapsed_s")).write.json(path)
    return tables.runs(spark, path).withColumn("elapsed_s", F.round("elapsed_s", 3))


@query("""SELECT l_suppkey // 10 AS model, CASE WHEN l_linenumber % 2 = 0 THEN 'CA' ELSE 'N' END AS name, ['ALA', 'GLY', 'LEU', 'SER'][(l_partkey % 4 + 1)::INT] AS residue, l_returnflag AS chain, CASE WHEN l_partkey % 50 > 0 THEN (l_partkey % 1000 - 20)::INT END AS number,
    round(l_quantity, 3) AS x, round(l_discount * 10, 3) AS y, round(-l_tax * 100, 3) AS z, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'N' END AS element FROM lineitem WHERE l_linenumber < 6""")
def model_atoms(spark: SparkSession, d: str) -> DataFrame:
    """S-13: line items as atoms of models in fixed columns, among lines of other kinds; numbers that cannot be read are null."""
    li, n, even = table(spark, d, "lineitem"), c("l_linenumber"), c("l_linenumber") % 2 == 0
    number = F.when(c("l_partkey") % 50 > 0, F.lpad((c("l_partkey") % 1000 - 20).cast("string"), 4, " ")).otherwise("  ??")
    residue = F.element_at(F.array(*[F.lit(x) for x in ("ALA", "GLY", "LEU", "SER")]), (c("l_partkey") % 4 + 1).cast("int"))
    atom = F.concat(F.when(n < 5, "ATOM  ").otherwise("HETATM"), F.lit("    1 "), F.when(even, " CA ").otherwise(" N  "), F.lit(" "), residue, F.lit(" "), "l_returnflag", number, F.lit("    "), *[F.format_string("%8.3f", x) for x in (c("l_quantity"), c("l_discount") * 10, c("l_tax") * -100)], F.lit("  1.00 20.00" + " " * 10), F.when(even, " C").otherwise(" N"))
    path = folder(spark, "models")
    li.select(F.floor(c("l_suppkey") / 10).alias("model"), F.when(n < 6, atom).otherwise("REMARK  ATOM counts").alias("value")).repartition("model").write.partitionBy("model").text(path)
    atoms = fasta.read_pdb_atoms(spark, path)
    return atoms.select(F.regexp_extract("file", "model=([0-9]+)", 1).cast("long").alias("model"), "name", "residue", "chain", "number", "x", "y", "z", "element")


@query("""WITH r AS (SELECT l_returnflag AS chain, l_partkey % 1000 AS number, min(l_shipdate)::VARCHAR AS residue FROM lineitem GROUP BY ALL), a AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'A-' || p_brand ELSE ['A', 'N', 'R', 'X'][p_size % 4 + 1] || (p_partkey % 1100 - 3) END AS hotspot FROM part),
    q AS (SELECT hotspot, CASE WHEN regexp_full_match(hotspot, '[A-Za-z0-9]-?[0-9]+') THEN hotspot[1] END AS chain, CASE WHEN regexp_full_match(hotspot, '[A-Za-z0-9]-?[0-9]+') THEN hotspot[2:]::BIGINT END AS number FROM a)
    SELECT hotspot, q.number::INT AS number, CASE WHEN q.chain IS NULL THEN 'invalid' WHEN r.chain IS NULL THEN 'absent' WHEN q.chain <> 'A' THEN 'other chain' ELSE 'ok' END AS status FROM q LEFT JOIN r ON r.chain = q.chain AND r.number = q.number""")
def requested_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """J-27: requests for residues against those of a structure: present, absent, on another chain than the target's, or not a residue."""
    res = table(spark, d, "lineitem").select(c("l_returnflag").alias("chain"), (c("l_partkey") % 1000).cast("int").alias("number"), c("l_shipdate").cast("string").alias("residue"))
    chain = F.element_at(F.array(*[F.lit(x) for x in "ANRX"]), c("p_size") % 4 + 1)
    asked = table(spark, d, "part").select(F.when(c("p_size") % 10 == 0, F.concat(F.lit("A-"), "p_brand")).otherwise(F.concat(chain, (c("p_partkey") % 1100 - 3).cast("string"))).alias("hotspot"))
    return structure.hotspots(asked, res, "A").select("hotspot", "number", "status")


@query("""SELECT vec_id AS id, round(sum(v) / count(*), 6) AS interface_pae FROM (SELECT vec_id, i, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i, 1 + vec_id % 7 AS n FROM embeddings) WHERE i < 64 AND (i // 8 < n) <> (i % 8 < n) GROUP BY vec_id""".replace("vec_id, i, unnest", "vec_id, unnest"))
def interface_error(spark: SparkSession, d: str) -> DataFrame:
    """A-33: mean of both off-diagonal blocks of eight by eight matrices."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda v: v.cast("double")))
    m = table(spark, d, "embeddings").select(c("vec_id").alias("id"), (1 + c("vec_id") % 7).alias("n_first"), rows.alias("pae"))
    return structure.interface_pae(m).withColumn("interface_pae", F.round("interface_pae", 6))


@query("SELECT parent, sequence, left(sha256(sequence), 16) AS parent_hash, novelty FROM (SELECT c_custkey AS parent, upper(translate(lower(min(c_name) || min(c_mktsegment)), 'bjouxz#0123456789', '')) AS sequence, min(c_nationkey) AS novelty FROM customer GROUP BY c_custkey)")
def loaded_parents(spark: SparkSession, d: str) -> DataFrame:
    """P-08, P-09: parents in lower case pass the load's contract, keep their metadata and get their hash."""
    text = F.translate(F.lower(F.concat(F.min("c_name"), F.min("c_mktsegment"))), "bjouxz#0123456789", "")
    rows = table(spark, d, "customer").groupBy(c("c_custkey").alias("parent")).agg(text.alias("sequence"), F.min("c_nationkey").alias("novelty"))
    return tables.load_parents(rows).select("parent", "sequence", S.digest(16, c("sequence")).alias("parent_hash"), "novelty")


_POOLED = TURNS.replace("FROM conversations", "FROM conversations WHERE {0}")
_SOURCES = f"(SELECT 0 AS src, parent AS ord, 'rcsb_' || parent || '_A' AS parent, 'de_novo' AS domain, sequence FROM {ITEMS} UNION ALL SELECT 1, parent, 'uniprot_' || parent, 'natural_human', sequence FROM {_POOLED.format("role = 'user'")} UNION ALL SELECT 2, parent, 'uniprot_' || parent, 'natural_viral', sequence FROM {_POOLED.format("role IS NULL OR role <> 'user'")})"


@query(f"""WITH w AS (SELECT src, ord, parent, domain, i::INT AS start, substr(sequence, i + 1, 9) AS peptide, substr(sequence, greatest(i - 4, 0) + 1, least(i, 4)) AS nf, substr(sequence, i + 10, 4) AS cf FROM {_SOURCES}, unnest(range(1, length(sequence) - 8)) t(i)), k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY src, ord, start) = 1)
    SELECT peptide, parent || ':' || start || '-' || (start + 9) AS row_id, 'HLA-A*02:01' AS hla_allele, CASE WHEN src > 0 THEN 'CC-BY-4.0 (UniProt)' ELSE 'CC0-1.0 (RCSB PDB, public domain)' END AS license, ['rcsb_de_novo_v1', 'uniprot_human_reference_v1', 'uniprot_viral_reference_v1'][src + 1] AS study_id,
    CASE WHEN src > 0 THEN 'https://www.uniprot.org/uniprotkb/' || ord ELSE 'https://www.rcsb.org/structure/' || ord END AS source_uri, left(sha256('esm2_t33_650M_UR50D|' || nf || '|' || peptide || '|' || cf), 24) AS embedding_cache_key, NULL::DOUBLE AS mhc_percentile FROM k""")
def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    """T-07, P-07: windows of three sources, the first row of each peptide by source, parent and start, with identity and provenance columns."""
    t = table(spark, d, "conversations").select("role", (c("conv_id") * 1000 + c("turn")).alias("n"), S.from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    natural = lambda which: t.where(which).select(F.concat(F.lit("uniprot_"), c("n").cast("string")).alias("parent"), "n", "sequence")
    designed = items(spark, d).select(F.concat(F.lit("rcsb_"), c("parent").cast("string"), F.lit("_A")).alias("parent"), c("parent").alias("n"), "sequence")
    pooled = tile.pool_sources({"de_novo": designed, "natural_human": natural("role = 'user'"), "natural_viral": natural("role is null or role <> 'user'")}, "n")
    return identity.finish(pooled).select("peptide", "row_id", "hla_allele", "license", "study_id", "source_uri", "embedding_cache_key", "mhc_percentile")
