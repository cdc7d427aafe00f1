"""Queries on stores, contracts, reviews, providers and sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.functions import sequence as S
from windloom.operators import cache, coded, collapse, contract, join, learn, quality, scorer, split, structure, tile
from windloom.plans.views import ITEMS, SEQUENCES, TURNS, items, sequences, table, turns
from windloom.session import landed, workspace

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


r6 = lambda x: F.round(x, 6)
c = F.col


@query("""WITH k AS (SELECT DISTINCT coalesce(text, '') AS t FROM conversations), half AS (SELECT DISTINCT coalesce(text, '') AS t FROM conversations WHERE role = 'user')
    SELECT step, n_keys, n_hits, round(n_hits::DOUBLE / n_keys, 6) AS rate FROM (SELECT 'first' AS step, count(*) AS n_keys, count(*) FILTER (WHERE t IN (SELECT t FROM half)) AS n_hits FROM k UNION ALL SELECT 'again', count(*), count(*) FROM k)""")
def cached_turns(spark: SparkSession, d: str) -> DataFrame:
    """L-09, J-23: a store that has what users said is asked for all turns, computes what is missing, and is asked again."""
    rows = table(spark, d, "conversations").select("role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    store = cache.Store(spark, f"{workspace(spark)}/cache-{uuid.uuid4().hex}", "key")
    compute = lambda new: new.select("key", (c("n") * 2).alias("made"))
    store.append(compute(store.missing(rows.where("role = 'user'"))), "first")
    before = landed(store.hit_rate(rows).select(F.lit("first").alias("step"), "n_keys", "n_hits", "rate"), "rate")
    store.ensure(rows, compute, "second")
    store.ensure(rows, compute, "third")
    after = store.hit_rate(rows).select(F.lit("again").alias("step"), "n_keys", "n_hits", "rate")
    return before.unionByName(after).withColumn("rate", r6("rate"))


_ROWS = """(SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR AS row_id, CASE WHEN l_partkey % 97 = 0 THEN 'ACDX' ELSE substr('ACDEFGHIK', 1, 2 + l_linenumber) END AS peptide, 2 + l_linenumber AS length, CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE l_linenumber END AS start,
    CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 2 * l_linenumber + 2 END + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS "end", CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'ACD' END AS n_flank, l_orderkey::VARCHAR AS protein_cluster_id, (l_orderkey % 5000)::VARCHAR AS peptide_cluster_id,
    CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' WHEN l_partkey % 31 = 0 THEN 'other' ELSE 'test' END AS split, CASE WHEN l_linenumber <> 4 THEN l_discount END AS label FROM lineitem)"""
_CONTRACT = contract.Contract(flanks=("n_flank",), targets=("label",))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    li, n = table(spark, d, "lineitem"), c("l_linenumber")
    odd = c("l_suppkey") % 7 == 0
    return li.select(
        (c("l_orderkey") * 10 + n).cast("string").alias("row_id"),
        F.when(c("l_partkey") % 97 == 0, "ACDX").otherwise(F.left(F.lit("ACDEFGHIK"), n + 2)).alias("peptide"),
        (n + 2).alias("length"),
        F.when(odd, -1).otherwise(n).alias("start"),
        (F.when(odd, 1).otherwise(2 * n + 2) + F.when(c("l_partkey") % 50 == 0, 1).otherwise(0)).alias("end"),
        F.when(c("l_returnflag") != "A", "ACD").alias("n_flank"),
        c("l_orderkey").cast("string").alias("protein_cluster_id"),
        (c("l_orderkey") % 5000).cast("string").alias("peptide_cluster_id"),
        F.when(c("l_orderkey") % 10 < 8, "train").when(c("l_orderkey") % 10 == 8, "val").when(c("l_partkey") % 31 == 0, "other").otherwise("test").alias("split"),
        F.when(n != 4, c("l_discount")).alias("label"),
    )


@query(f"""WITH r AS MATERIALIZED {_ROWS}, dup AS (SELECT row_id FROM r GROUP BY 1 HAVING count(*) > 1), p AS (SELECT protein_cluster_id AS v FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1), q AS (SELECT peptide_cluster_id AS v FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1),
    f AS (SELECT 'length is not the sequence''s' AS rule, 'error' AS severity, count(*) FILTER (WHERE length <> strlen(peptide)) AS n_bad, '' AS sample FROM r
        UNION ALL SELECT 'end - start is not the length', 'error', count(*) FILTER (WHERE "end" - start <> length), '' FROM r UNION ALL SELECT 'start under 0', 'error', count(*) FILTER (WHERE start < 0), '' FROM r
        UNION ALL SELECT 'peptide: other residues', 'error', count(*) FILTER (WHERE contains(peptide, 'X')), '' FROM r UNION ALL SELECT 'split: value not allowed', 'error', count(*) FILTER (WHERE split = 'other'), '' FROM r
        UNION ALL SELECT 'label: target missing', 'warning', count(*) FILTER (WHERE label IS NULL), '' FROM r
        UNION ALL SELECT 'row_id: repeated', 'error', count(*), coalesce(array_to_string(list_sort(list(row_id))[1:5], ','), '') FROM dup
        UNION ALL SELECT 'protein_cluster_id: in several splits', 'error', count(*), coalesce(array_to_string(list_sort(list(v))[1:5], ','), '') FROM p
        UNION ALL SELECT 'peptide_cluster_id: in several splits', 'error', count(*), coalesce(array_to_string(list_sort(list(v))[1:5], ','), '') FROM q)
    SELECT rule, severity, n_bad, sample FROM f WHERE n_bad > 0""")
def contract_findings(spark: SparkSession, d: str) -> DataFrame:
    """X-01: all findings of a table against its contract, row rules and grouped ones, in one table."""
    return contract.findings(_rows(spark, d), _CONTRACT).withColumn("sample", F.array_join("sample", ","))


@query("SELECT l_returnflag AS name, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_discount) = 1) GROUP BY 1")
def published_card(spark: SparkSession, d: str) -> DataFrame:
    """X-02, X-04, S-14, S-15: a table is written, gated and named in the pass that observes it, read back from its manifest, and summed up by group."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_returnflag", "l_discount")).alias("x"))
    n = c("l_linenumber")
    rows = li.select((c("l_orderkey") * 10 + n).cast("string").alias("row_id"), F.left(F.lit("ACDEFGHIK"), n + 2).alias("peptide"), (n + 2).alias("length"), n.alias("start"), (2 * n + 2).alias("end"), F.lit("train").alias("split"), c("l_orderkey").cast("string").alias("protein_cluster_id"), c("l_orderkey").cast("string").alias("peptide_cluster_id"), c("x.l_returnflag").alias("flag"), c("x.l_discount").alias("label"))
    path = f"{workspace(spark)}/dataset-{uuid.uuid4().hex}"
    contract.publish(rows, path, contract.Contract(flanks=(), targets=("label",), groups=("split", "flag")), {"query": "published_card"})
    return contract.read(spark, path).groupBy(c("flag").alias("name")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("label")).alias("mean"), r6(F.stddev_samp("label")).alias("std"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN p IS NOT NULL THEN (k + e) / length(p)::DOUBLE END, 6) AS charged, CASE WHEN p IS NOT NULL THEN (k - e)::INT END AS charge, CASE WHEN p IS NULL THEN 'ValueError: peptide is null' ELSE 'ok' END AS status FROM (SELECT *, length(p) - length(translate(p, 'KR', '')) AS k, length(p) - length(translate(p, 'DE', '')) AS e FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 41 > 0 THEN substr('ACDEKGHRKDE', 1, 2 + l_linenumber) END AS p FROM lineitem))")
def scored_windows_by_user(spark: SparkSession, d: str) -> DataFrame:
    """§2.12, X-07: rows scored by a registered scorer; those it fails on carry the error as their status."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(c("l_partkey") % 41 > 0, F.left(F.lit("ACDEKGHRKDE"), c("l_linenumber") + 2)).alias("peptide"))
    return scorer.STOCK.score(rows, "composition", ["peptide"], rows=64).select("l_orderkey", "l_linenumber", r6("charged").alias("charged"), "charge", "status")


@query("""WITH a AS (SELECT o_orderkey AS id, 9 + o_custkey % 5 AS n, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS combined FROM orders), p AS (SELECT l_orderkey AS id, max(l_returnflag <> 'R') AS ok, max(l_partkey % 5 > 0) AS full_panel FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
    u AS (SELECT l_orderkey AS id, max(l_linestatus = 'O') AS gone FROM lineitem WHERE l_linenumber = 2 GROUP BY 1), t AS (SELECT l_orderkey AS id, min(9 + l_suppkey % 5) AS lo, max(9 + l_suppkey % 5) AS hi FROM lineitem WHERE l_linenumber > 5 GROUP BY 1), j AS (SELECT * FROM a LEFT JOIN p USING (id) LEFT JOIN u USING (id) LEFT JOIN t USING (id))
    SELECT "check", count(*) AS n, count(*) FILTER (WHERE passed)::BIGINT AS n_passed FROM (SELECT 'primary_ok' AS "check", coalesce(ok, FALSE) AS passed FROM j UNION ALL SELECT 'panel_complete', coalesce(full_panel, FALSE) FROM j UNION ALL SELECT 'unavailable_has_no_rank', NOT coalesce(gone, FALSE) OR combined IS NULL FROM j UNION ALL SELECT 'tracks_aligned', lo = n AND hi = n FROM j WHERE lo IS NOT NULL) GROUP BY 1""")
def assessment_review(spark: SparkSession, d: str) -> DataFrame:
    """X-06: the review's checks over assessments, their providers, responses and tracks."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("id", c("l_orderkey"))
    a = o.select(c("o_orderkey").alias("id"), F.repeat(F.lit("A"), (9 + c("o_custkey") % 5).cast("int")).alias("sequence"), F.when(c("o_orderkey") % 4 > 0, c("o_totalprice")).alias("combined_rank"))
    p = li.where("l_linenumber = 1").select("id", F.lit("primary").alias("provider"), F.when(c("l_returnflag") == "R", "error").otherwise("ok").alias("status"), F.when(c("l_partkey") % 5 > 0, 18).otherwise(17).alias("n_alleles"))
    u = li.where("l_linenumber = 2").select("id", F.when(c("l_linestatus") == "O", "unavailable").otherwise("ok").alias("status"))
    t = li.where("l_linenumber > 5").select("id", (9 + c("l_suppkey") % 5).alias("n_values"))
    return quality.review_assessments(a, p, u, t, "primary").groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))


@query("""WITH k AS (SELECT o_custkey AS campaign, o_orderstatus = 'F' AS screened, o_orderkey % 11 > 0 AS good, o_orderkey % 5 AS n FROM orders), g AS (SELECT campaign, count(*) FILTER (WHERE screened) AS s, count(*) FILTER (WHERE screened AND NOT good) AS wrong, count(*) FILTER (WHERE n = 0) AS bare FROM k GROUP BY 1), done AS (SELECT o_custkey AS campaign, count(*) AS done FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 20000 GROUP BY 1),
    j AS (SELECT c_custkey AS campaign, CASE WHEN c_custkey % 3 > 0 THEN coalesce(s, 0) END AS claimed, coalesce(s, 0) AS s, coalesce(wrong, 0) AS wrong, bare, coalesce(done, 0) AS done FROM customer LEFT JOIN g ON g.campaign = c_custkey LEFT JOIN done ON done.campaign = c_custkey)
    SELECT campaign, "check", passed FROM (SELECT campaign, 'structural_gate_enforced' AS "check", wrong = 0 AS passed FROM j UNION ALL SELECT campaign, 'counts_reconcile', coalesce(claimed, s) = done FROM j UNION ALL SELECT campaign, 'checks_recorded', bare = 0 FROM j WHERE bare IS NOT NULL)""")
def campaign_review(spark: SparkSession, d: str) -> DataFrame:
    """X-06: screened candidates, counts and checks of campaigns."""
    o = table(spark, d, "orders").withColumn("campaign", c("o_custkey"))
    k = o.select("campaign", F.when(c("o_orderstatus") == "F", "screened").otherwise("new").alias("screening"), F.when(c("o_orderkey") % 11 > 0, "pass").otherwise("fail").alias("validation"), (c("o_orderkey") % 5).alias("n_checks"))
    n = k.groupBy("campaign").agg(F.count_if(c("screening") == "screened").alias("s"))
    camp = table(spark, d, "customer").select(c("c_custkey").alias("campaign")).join(n.hint("merge"), "campaign", "left").select("campaign", F.when(c("campaign") % 3 > 0, F.coalesce("s", F.lit(0))).alias("n_screened"))
    return quality.review_campaigns(camp, k, o.where("o_orderstatus = 'F' and o_totalprice > 20000").select("campaign"))


@query("""WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS found FROM documents WHERE lang IS NULL OR lang <> 'de'), m AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'x' WHEN n_chars > 3000 THEN NULL ELSE sha256(coalesce(text, '')) END AS recorded FROM documents WHERE n_chars >= 300)
    SELECT 'docs/' || coalesce(a.doc_id, m.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unlisted' WHEN found = recorded THEN 'ok' ELSE 'mismatch' END AS status FROM a FULL JOIN m ON a.doc_id = m.doc_id""")
def file_integrity(spark: SparkSession, d: str) -> DataFrame:
    """S-17: recorded and actual hashes of documents as files: one language's files are gone, short ones are not listed, others have another hash or none."""
    docs = table(spark, d, "documents").select("lang", "n_chars", F.concat(F.lit("docs/"), c("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    m = docs.where("n_chars >= 300").withColumn("sha256", F.when(c("lang") == "fr", "x").when(c("n_chars") <= 3000, c("sha256")))
    return quality.file_integrity(docs.where("lang is null or lang <> 'de'"), m).select("path", "status")


@query("""WITH a AS (SELECT o_custkey % 7 AS target, l_orderkey AS file, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'), k AS (SELECT target, file FROM (SELECT DISTINCT target, file FROM a) QUALIFY row_number() OVER (PARTITION BY target ORDER BY file) <= 100),
    r AS (SELECT target, file, sqrt(avg(q)) AS r FROM (SELECT target, file, pow(x - avg(x) OVER f, 2) + pow(y - avg(y) OVER f, 2) + pow(z - avg(z) OVER f, 2) AS q FROM a JOIN k USING (target, file) WINDOW f AS (PARTITION BY target, file)) GROUP BY ALL HAVING count(*) >= 3)
    SELECT target, count(*) AS n_files, round(avg(r), 5) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(r) END, 5) AS deviation FROM r GROUP BY target""")
def gyration_by_target(spark: SparkSession, d: str) -> DataFrame:
    """A-32: radii of gyration of each target's first hundred files."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), (c("o_custkey") % 7).alias("target"))
    atoms = table(spark, d, "lineitem").where("l_returnflag <> 'R'").join(o.hint("merge"), "l_orderkey").select("target", c("l_orderkey").alias("file"), c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (c("l_tax") * 100).alias("z"))
    t = structure.gyration_by_target(atoms, "target", "file")
    return t.select("target", "n_files", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"))


_FACING = (2, 3, 5, 7, 8)
_KEY = " || ".join(f"substr(peptide, {i}, 1)" for i in _FACING)


@query(f"""WITH w AS MATERIALIZED (SELECT substr(sequence, i + 1, 9) AS peptide FROM {SEQUENCES}, unnest(range(0, length(sequence) - 8)) t(i)), k AS (SELECT {_KEY} AS k, count(*) AS n FROM w GROUP BY 1), total AS (SELECT count(*)::DOUBLE AS total FROM w), e AS (SELECT DISTINCT peptide FROM w),
    freq AS MATERIALIZED (SELECT substr(peptide, i, 1) AS r, count(*)::DOUBLE / (SELECT 9 * count(*) FROM w) AS p FROM w, unnest(range(1, 10)) t(i) GROUP BY 1),
    m AS (SELECT parent AS item, substr(sequence, i + 1, 9) AS peptide FROM {ITEMS}, unnest(range(0, length(sequence) - 8)) t(i))
    SELECT item, sum(coalesce(k.n, 0))::BIGINT AS matches, max(coalesce(k.n, 0))::BIGINT AS max_frame, count(k.n) AS frames, count(e.peptide) AS exact, round(sum(total * {' * '.join(f'f{i}.p' for i in _FACING)}), 3) AS expected
    FROM m LEFT JOIN k ON k.k = {_KEY.replace('peptide', 'm.peptide')} LEFT JOIN e ON e.peptide = m.peptide, total, {', '.join(f'freq f{i}' for i in _FACING)} WHERE {' AND '.join(f'f{i}.r = substr(m.peptide, {i}, 1)' for i in _FACING)} GROUP BY item""")
def self_match(spark: SparkSession, d: str) -> DataFrame:
    """A-21, J-12, J-13: every window of the reference items against those of all documents: matches on five positions, the most in a frame, frames with any, exact ones, and what residue frequencies let expect."""
    s = sequences(spark, d)
    key = lambda code: c(code).bitwiseAND(sum(31 << 5 * (9 - i) for i in _FACING))
    mine = tile.with_flanks(items(spark, d), flank=0).select(c("parent").alias("item"), "peptide", S.kmer_code(c("peptide"), 9).alias("code")).withColumn("k", key("code"))
    corpus = coded.code_counts(s, 9).withColumn("k", key("code"))
    asked = corpus.join(join.bounded(mine.select("k").distinct()), "k", "left_semi")
    each = landed(asked.groupBy("k", "code").agg(F.sum("n").alias("n")), "asked")
    counts, exact = each.groupBy("k").agg(F.sum("n").alias("n")), each.select("code").distinct().withColumn("hit", F.lit(1))
    cores = collapse.core_residues(s).collect()  # twenty rows
    share, total = {r["residue"]: r["share"] for r in cores}, sum(r["n"] for r in cores) // 9
    p = F.create_map(*[x for r, v in share.items() for x in (F.lit(r), F.lit(float(v)))]) if share else F.create_map().cast("map<string,double>")
    chance = F.lit(float(total))
    for i in _FACING:
        chance = chance * F.try_element_at(p, F.substring("peptide", i, 1))
    met = mine.join(counts.hint("merge"), "k", "left").join(exact.hint("merge"), "code", "left")
    return met.groupBy("item").agg(F.sum(F.coalesce("n", F.lit(0))).alias("matches"), F.max(F.coalesce("n", F.lit(0))).alias("max_frame"), F.count("n").alias("frames"), F.count("hit").alias("exact"), F.round(F.sum(chance), 3).alias("expected"))
