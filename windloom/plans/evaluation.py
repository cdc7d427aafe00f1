"""Queries on evaluation, provenance and preparation: metric bundles, arms, input checks, collapse, acceptance, stored heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.functions import sequence as S
from windloom.operators import collapse, join, learn, metrics, quality, rank, rollup, split, structure, tile
from windloom.plans.views import OUTCOMES, SEQUENCES, TURNS, outcomes, sequences, table, turns
from windloom.sources import tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)


def _auc(source: str, score: str, label: str) -> str:
    return f"(SELECT (sum(r) FILTER (WHERE y) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * sum((NOT y)::INT)) FROM (SELECT {label} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM {source}))"


def _ap(source: str, score: str, label: str) -> str:
    return f"(SELECT sum(pos * tp::DOUBLE / flagged) / sum(pos) FROM (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged FROM (SELECT {score} AS s, sum(({label})::INT) AS pos, count(*) AS n FROM {source} GROUP BY 1) WINDOW w AS (ORDER BY s DESC)))"


def _rho(source: str, a: str, b: str) -> str:
    return f"(SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {source}))"


# ---- metric bundles and arms -----------------------------------------------------------------

_TAUGHT = "(SELECT l_extendedprice AS price, l_quantity::DOUBLE AS quantity, (l_orderkey * 7 + l_linenumber * 131) % 1000 / 100.0::DOUBLE AS rank FROM lineitem)"


def _taught(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("double").alias("quantity"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1000 / 100.0).alias("rank"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round({_rho(_TAUGHT, c, '-rank')}, 6) AS spearman, round({_auc(_TAUGHT, c, 'rank <= 0.5')}, 6) AS strong_auc, round({_ap(_TAUGHT, c, 'rank <= 0.5')}, 6) AS strong_ap, round({_auc(_TAUGHT, c, 'rank <= 2')}, 6) AS weak_auc, round({_ap(_TAUGHT, c, 'rank <= 2')}, 6) AS weak_ap" for c in ("price", "quantity")))
def agreement_bundle(spark: SparkSession, d: str) -> DataFrame:
    """M-07: two scores against a teacher's ranks."""
    got = metrics.teacher_agreement(_taught(spark, d), ["price", "quantity"], "rank")
    return got.select("name", *[r6(c).alias(c) for c in ("spearman", "strong_auc", "strong_ap", "weak_auc", "weak_ap")])


_CHANNELS = "(SELECT l_returnflag AS split, l_linestatus AS channel, l_discount * 8 AS predicted, 1 - ln(1 + r) / ln(101) AS target, r AS rank FROM (SELECT *, (l_orderkey * 7 + l_linenumber * 131) % 1000 / 50.0::DOUBLE AS r FROM lineitem))"


@query(f"""WITH c AS MATERIALIZED {_CHANNELS}, r AS (SELECT *, rank() OVER (PARTITION BY split, channel ORDER BY predicted) + (count(*) OVER (PARTITION BY split, channel, predicted) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY split, channel ORDER BY -rank) + (count(*) OVER (PARTITION BY split, channel, rank) - 1) / 2.0 AS rb FROM c),
    b AS (SELECT split, channel, count(*) AS n_rows, avg(abs(predicted - target)) AS mae, sqrt(avg((predicted - target) * (predicted - target))) AS rmse, avg((rank <= 2)::INT) AS prevalence, corr(ra, rb) AS spearman FROM r GROUP BY ALL),
    s AS (SELECT split, channel, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged FROM (SELECT split, channel, predicted, sum((rank <= 2)::INT) AS pos, count(*) AS n FROM c GROUP BY ALL) WINDOW w AS (PARTITION BY split, channel ORDER BY predicted DESC))
    SELECT split, channel, n_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(prevalence, 6) AS prevalence, round(spearman, 6) AS spearman, round(ap, 6) AS auprc FROM b JOIN (SELECT split, channel, sum(pos * tp::DOUBLE / flagged) / sum(pos) AS ap FROM s GROUP BY ALL) USING (split, channel)""")
def channel_block(spark: SparkSession, d: str) -> DataFrame:
    """M-10: the metric block of each split and channel."""
    r = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1000 / 50.0
    c = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("channel"), (F.col("l_discount") * 8).alias("predicted"), C.rank_to_propensity(r).alias("target"), r.alias("rank"))
    got = metrics.channel_block(c, "predicted", "target", "rank", ["split", "channel"])
    return got.select("split", "channel", "n_rows", *[r6(x).alias(x) for x in ("mae", "rmse", "prevalence", "spearman", "auprc")])


def _group_auc(score: str) -> str:
    return f"(SELECT g, (sum(r) FILTER (WHERE y) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * sum((NOT y)::INT)) AS auc, count(*) AS n, sum(y::INT) AS pos FROM (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY {score}) + (count(*) OVER (PARTITION BY g, {score}) - 1) / 2.0::DOUBLE AS r FROM x) GROUP BY g)"


@query(f"""WITH x AS MATERIALIZED (SELECT l_suppkey AS g, l_returnflag = 'R' AS y, l_extendedprice AS a, l_quantity::DOUBLE AS b FROM lineitem)
    SELECT count(*) AS n_groups, round(avg(p.auc), 6) AS base_auc, round(avg(q.auc), 6) AS other_auc, count(*) FILTER (WHERE q.auc > p.auc)::BIGINT AS wins FROM {_group_auc("a")} p JOIN {_group_auc("b")} q USING (g) WHERE p.n >= 25 AND p.pos > 0 AND p.pos < p.n""")
def group_wins(spark: SparkSession, d: str) -> DataFrame:
    """M-11: two scores compared on groups of 25 rows or more with both classes."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_returnflag") == "R").alias("y"), F.col("l_extendedprice").alias("a"), F.col("l_quantity").cast("double").alias("b"))
    return metrics.group_wins(x, "a", "b", "y", "g").select("n_groups", r6("base_auc").alias("base_auc"), r6("other_auc").alias("other_auc"), "wins")


@query("""SELECT o.l_returnflag AS metric, round(f.m, 6) AS base, round(o.m, 6) AS other, round(o.m - f.m, 6) AS delta FROM (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) o JOIN (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) f USING (l_returnflag)""")
def arm_deltas(spark: SparkSession, d: str) -> DataFrame:
    """M-12: a metric of two arms, paired by its key."""
    arms = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("arm"), F.col("l_returnflag").alias("metric")).agg(F.avg("l_extendedprice").alias("value"))
    return metrics.paired_deltas(arms, "arm", ["metric"], "value", "F", "O").select("metric", *[r6(c).alias(c) for c in ("base", "other", "delta")])


@query(f"SELECT count(*) FILTER (WHERE activity <= lo) AS n_top, round(count(*) FILTER (WHERE activity <= lo AND score >= hi)::DOUBLE / greatest(1, count(*) FILTER (WHERE activity <= lo)), 6) AS agreement FROM {OUTCOMES}, (SELECT quantile_cont(activity, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM {OUTCOMES})")
def top_percent_agreement(spark: SparkSession, d: str) -> DataFrame:
    """O-12: how many of the lowest true values are among the highest predictions."""
    return metrics.top_percent_agreement(outcomes(spark, d), "activity", "score").select("n_top", r6("agreement").alias("agreement"))


@query("SELECT cutoff::DOUBLE AS cutoff, count(*) FILTER (WHERE l_extendedprice <= cutoff)::BIGINT AS n_at, count(*) FILTER (WHERE l_extendedprice > cutoff)::BIGINT AS n_above FROM lineitem, (VALUES (500.0), (5000.0), (50000.0)) t(cutoff) GROUP BY cutoff")
def range_counts(spark: SparkSession, d: str) -> DataFrame:
    """M-15: rows on both sides of several cutoffs."""
    return metrics.counts_at(table(spark, d, "lineitem"), "l_extendedprice", [500.0, 5000.0, 50000.0])


@query(f"""SELECT s AS threshold, round(flagged / total, 6) AS coverage, round(tp / flagged, 6) AS accuracy, round(tp / flagged / (hits / total), 6) AS enrichment FROM
    (SELECT s, (sum(pos) OVER w)::DOUBLE AS tp, (sum(n) OVER w)::DOUBLE AS flagged, (sum(n) OVER ())::DOUBLE AS total, (sum(pos) OVER ())::DOUBLE AS hits FROM (SELECT score AS s, sum(label::INT) AS pos, count(*) AS n FROM {OUTCOMES} GROUP BY 1) WINDOW w AS (ORDER BY s DESC))""")
def selective_curve(spark: SparkSession, d: str) -> DataFrame:
    """M-16: accuracy and enrichment by coverage."""
    return metrics.selective(outcomes(spark, d), "score", "label").select("threshold", *[r6(c).alias(c) for c in ("coverage", "accuracy", "enrichment")])


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL OR isnan(v) OR isinf(v))::BIGINT AS n_not_finite, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS n_pos, count(*) FILTER (WHERE l_returnflag <> 'R')::BIGINT AS n_neg FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'nan'::DOUBLE WHEN l_linenumber = 5 THEN 'inf'::DOUBLE ELSE l_tax END AS v FROM lineitem)")
def metric_inputs(spark: SparkSession, d: str) -> DataFrame:
    """X-05: what would stop a metric."""
    n = F.col("l_linenumber")
    v = F.when(n == 7, None).when(n == 6, float("nan")).when(n == 5, float("inf")).otherwise(F.col("l_tax"))
    return metrics.inputs(table(spark, d, "lineitem").withColumn("v", v), ["v"], F.col("l_returnflag") == "R")


# ---- collapse, counts, cohorts ---------------------------------------------------------------


@query("SELECT l_partkey, bool_or(l_returnflag = 'R') AS label, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS l_suppkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS l_returnflag FROM lineitem GROUP BY l_partkey")
def window_collapse(spark: SparkSession, d: str) -> DataFrame:
    """A-05: the highest label of each key with the first row's other columns."""
    return collapse.collapse_windows(table(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag") == "R", F.struct("l_orderkey", "l_linenumber"), ["l_suppkey", "l_returnflag"])


@query("SELECT l_suppkey AS component, count(DISTINCT l_partkey) AS weight FROM lineitem GROUP BY l_suppkey")
def component_weights(spark: SparkSession, d: str) -> DataFrame:
    """A-07: distinct members of each component."""
    return collapse.component_weights(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("peptide")))


@query("SELECT count(*) FILTER (WHERE v AND NOT t)::BIGINT AS measured, count(*) FILTER (WHERE v AND t)::BIGINT AS imputed, count(*) FILTER (WHERE NOT v)::BIGINT AS missing FROM (SELECT l_discount > 0 AS v, l_tax > 0.04 AS t FROM lineitem)")
def imputed_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-11: measured, filled and missing values."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("v"), F.when(F.col("l_tax") > 0.04, "tap_ridge=v1").alias("tags"))
    return quality.provenance(rows, "v", "tags", "tap_ridge")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_returnflag")))
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """A-12: distinct values of several columns."""
    return quality.distinct_counts(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"])


@query("SELECT count(*) AS n_flagged, round(avg((l_tax < 0.03)::INT), 6) AS buried, round(1 - avg((l_tax < 0.03)::INT), 6) AS surface FROM lineitem WHERE l_discount >= 0.08")
def flagged_burial(spark: SparkSession, d: str) -> DataFrame:
    """A-17: shares of flagged windows that are buried and on the surface."""
    flagged, buried = F.col("l_discount") >= 0.08, F.col("l_tax") < 0.03
    n = F.count_if(flagged)
    return table(spark, d, "lineitem").agg(n.alias("n_flagged"), r6(F.count_if(flagged & buried) / n).alias("buried"), r6(1 - F.count_if(flagged & buried) / n).alias("surface"))


@query(f"SELECT residue, sum(w)::BIGINT AS n, round(sum(w)::DOUBLE / sum(sum(w)) OVER (), 8) AS share FROM (SELECT substr(sequence, i + 1, 1) AS residue, least(i + 1, 9, length(sequence) - i, length(sequence) - 8) AS w FROM {SEQUENCES}, unnest(range(0, length(sequence))) t(i) WHERE length(sequence) >= 9) GROUP BY residue")
def core_residues(spark: SparkSession, d: str) -> DataFrame:
    """A-22: residues of all 9-mer cores of all documents."""
    return collapse.core_residues(sequences(spark, d)).select("residue", "n", F.round("share", 8).alias("share"))


@query("""WITH m AS (SELECT c_custkey, c_mktsegment AS cohort, count(o_orderkey) AS matches FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT cohort, count(*) AS n_rows, quantile_cont(matches, 0.5)::DOUBLE AS median, round(avg(matches), 6) AS mean, round(avg((matches > 0)::INT), 6) AS fraction, round(quantile_cont(log2((matches + 1) / 11.0::DOUBLE), 0.5), 6) AS median_enrichment FROM m GROUP BY cohort""")
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    """A-23: matches of each customer, summed up by cohort."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    m = table(spark, d, "customer").join(n.hint("merge"), "c_custkey", "left").select(F.col("c_mktsegment").alias("cohort"), F.coalesce("n", F.lit(0)).alias("matches"))
    got = collapse.cohort_summary(m.withColumn("enrichment", C.log2_enrichment(F.col("matches"), F.lit(10.0))), "cohort", "matches", "enrichment")
    return got.select("cohort", "n_rows", "median", r6("mean").alias("mean"), r6("fraction").alias("fraction"), r6("median_enrichment").alias("median_enrichment"))


@query("SELECT l_orderkey, l_linenumber, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 5 > 1), l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def preferred_residues(spark: SparkSession, d: str) -> DataFrame:
    """O-08: three picks of each group, preferred kinds first."""
    return rank.preferred(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_partkey") % 5 <= 1, [F.desc("l_extendedprice"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "rank")


_HITS = "(SELECT l_orderkey AS id, CASE WHEN l_linenumber = 3 THEN 'error' ELSE 'ok' END AS status, l_quantity * 2.0::DOUBLE AS el_rank, CASE WHEN l_linestatus = 'O' THEN l_discount * 1000 END AS ba_rank, CASE WHEN l_orderkey % 2 = 0 THEN 'calibrated_probability' ELSE 'raw' END AS scale, l_tax AS response, CASE WHEN l_returnflag = 'N' THEN l_discount END AS cleavage, CASE WHEN l_returnflag = 'R' THEN l_tax END AS accessibility, CASE WHEN l_partkey % 5 = 0 THEN 'shared' ELSE 'query_only' END AS gate, l_discount AS tolerance FROM lineitem)"


@query(f"""SELECT id, round(max(response) FILTER (WHERE scale = 'calibrated_probability'), 6) AS response, round(max(1 - least(100, greatest(0, el_rank)) / 100) FILTER (WHERE status = 'ok'), 6) AS el, round(max(1 - least(100, greatest(0, ba_rank)) / 100) FILTER (WHERE status = 'ok' AND ba_rank IS NOT NULL), 6) AS ba,
    round(max(greatest(cleavage, accessibility)), 6) AS cleavage_accessibility, round(1 - max(tolerance) FILTER (WHERE gate = 'shared'), 6) AS inverse_tolerance FROM {_HITS} GROUP BY id""")
def component_summary(spark: SparkSession, d: str) -> DataFrame:
    """F-23: the parts that a fused score takes, of each candidate."""
    c = F.col
    hits = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("id"), F.when(c("l_linenumber") == 3, "error").otherwise("ok").alias("status"), (c("l_quantity") * 2.0).alias("el_rank"), F.when(c("l_linestatus") == "O", c("l_discount") * 1000).alias("ba_rank"),
        F.when(c("l_orderkey") % 2 == 0, "calibrated_probability").otherwise("raw").alias("scale"), c("l_tax").alias("response"), F.when(c("l_returnflag") == "N", c("l_discount")).alias("cleavage"), F.when(c("l_returnflag") == "R", c("l_tax")).alias("accessibility"),
        F.when(c("l_partkey") % 5 == 0, "shared").otherwise("query_only").alias("gate"), c("l_discount").alias("tolerance"),
    )
    got = rollup.component_summary(hits, "id")
    return got.select("id", *[r6(x).alias(x) for x in got.columns[1:]])


@query("SELECT l_orderkey AS id, round(CASE WHEN abs(sum(l_discount)) > 1e-9 THEN sum(sqrt(l_extendedprice) * l_discount) / sum(l_discount) ELSE avg(sqrt(l_extendedprice)) END, 6) AS a, round(CASE WHEN abs(sum(l_discount)) > 1e-9 THEN sum(ln(l_extendedprice) * l_discount) / sum(l_discount) ELSE avg(ln(l_extendedprice)) END, 6) AS b, round(avg(sqrt(l_extendedprice) / 7), 6) AS distance FROM lineitem GROUP BY l_orderkey")
def confidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A-31: parts of a confidence weighted by risk, and a mean distance."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("risk"), F.sqrt("l_extendedprice").alias("a"), F.ln("l_extendedprice").alias("b"), (F.sqrt("l_extendedprice") / 7).alias("distance"))
    return rollup.confidence_parts(rows, "id", "risk", ["a", "b"], "distance").select("id", r6("a").alias("a"), r6("b").alias("b"), r6("distance").alias("distance"))


# ---- gates and acceptance --------------------------------------------------------------------


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(plddt >= 80, FALSE) AND p_partkey % 13 <= 10 AND p_partkey % 5 / 4.0 <= 1 AND p_partkey % 3 = 0 AND k = 1 AND p_partkey % 4 > 0 THEN 'pass' ELSE 'fail' END AS status
    FROM (SELECT *, CASE WHEN p_size % 7 > 0 THEN 70 + p_size END AS plddt, count(*) OVER (PARTITION BY p_name) AS k FROM part)) GROUP BY status""")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    """F-25 with all six gates, A-34: candidates by status."""
    p = table(spark, d, "part")
    c = p.select(F.col("p_name").alias("sequence"), F.when(F.col("p_size") % 7 > 0, 70.0 + F.col("p_size")).alias("plddt"), (F.col("p_partkey") % 13).cast("double").alias("interface_pae"), (F.col("p_partkey") % 5 / 4.0).alias("rmsd"), (F.col("p_partkey") % 3).cast("int").alias("clashes"), F.when(F.col("p_partkey") % 4 > 0, 1.5).alias("perplexity"))
    return structure.gates(c).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, round(min(o), 6) AS objective, arg_min(l_linenumber, (o, l_linenumber)) AS l_linenumber FROM (SELECT *, l_discount + 0.25 * l_tax + l_quantity / 100.0 + 0.5 * l_discount * l_tax AS o FROM lineitem) WHERE o < 0.4 AND (l_tax * 30 - l_discount * 20) / greatest(1, l_linenumber) <= 0.5 GROUP BY l_orderkey""")
def likelihood_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """F-28 with its likelihood rule: the accepted candidate with the lowest objective."""
    c = F.col
    li = table(spark, d, "lineitem").withColumn("o", C.objective(c("l_discount"), c("l_tax"), c("l_quantity") / 100.0, c("l_discount") * c("l_tax")))
    ok = li.where(C.accepted(c("o"), F.lit(0.4), c("l_discount") * 20, c("l_tax") * 30, c("l_linenumber")))
    return ok.groupBy("l_orderkey").agg(r6(F.min("o")).alias("objective"), F.min_by("l_linenumber", F.struct("o", "l_linenumber")).alias("l_linenumber"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE f = 'x')::BIGINT AS n_not_integer, count(*) FILTER (WHERE f IS NULL AND l_partkey % 5 > 0)::BIGINT AS n_null, 5 - count(DISTINCT CASE WHEN f <> 'x' THEN f END)::INT AS n_missing FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 'x' WHEN l_linenumber = 6 THEN NULL ELSE (l_orderkey % 4)::VARCHAR END AS f FROM lineitem)")
def fold_checks(spark: SparkSession, d: str) -> DataFrame:
    """G-08: fold numbers of a table that lacks fold 4 and has other faults."""
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").withColumn("f", F.when(n == 7, "x").when(n == 6, None).otherwise((F.col("l_orderkey") % 4).cast("string")))
    return quality.valid_folds(rows, "f", F.col("l_partkey") % 5 == 0)


# ---- preparation -----------------------------------------------------------------------------


@query(f"SELECT domain, count(*) FILTER (WHERE length(sequence) BETWEEN 50 AND 400)::BIGINT AS n_kept, count(*) AS n FROM {SEQUENCES} GROUP BY domain")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    """P-05: sequences of 50 to 400 residues."""
    return sequences(spark, d).groupBy("domain").agg(F.count_if(S.length_between(F.col("sequence"), 50, 400)).alias("n_kept"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS parent, l_linenumber AS start, l_returnflag AS source_domain, l_discount AS score FROM lineitem")
def contract_order(spark: SparkSession, d: str) -> DataFrame:
    """P-13: columns renamed and in the contract's order."""
    return tables.contract_order(table(spark, d, "lineitem"), {"parent": "l_orderkey", "start": "l_linenumber", "source_domain": "l_returnflag", "score": "l_discount"})


@query(f"SELECT parent, (CASE WHEN b <> 'W' THEN '1' || b || 'W,' ELSE '' END || CASE WHEN y <> 'Y' THEN (length(sequence) - 1)::VARCHAR || y || 'Y,' ELSE '' END) AS changes FROM (SELECT *, substr(sequence, 2, 1) AS b, right(sequence, 1) AS y FROM {SEQUENCES} WHERE length(sequence) >= 3)")
def sequence_diff(spark: SparkSession, d: str) -> DataFrame:
    """P-14: where a sequence and its edited form differ."""
    s = sequences(spark, d).where("char_length(sequence) >= 3")
    edits = F.array(F.struct(F.lit(1).alias("pos"), F.lit("W").alias("to")), F.struct((F.char_length("sequence") - 1).alias("pos"), F.lit("Y").alias("to")))
    found = S.differences(F.col("sequence"), S.mutate(F.col("sequence"), edits))
    return s.select("parent", F.array_join(F.transform(found, lambda x: F.concat(x["pos"].cast("string"), x["before"], x["after"], F.lit(","))), "").alias("changes"))


@query(f"SELECT parent::VARCHAR AS accession, sequence FROM {SEQUENCES}")
def accession_map(spark: SparkSession, d: str) -> DataFrame:
    """S-11: sequences read back from JSON objects."""
    objects = sequences(spark, d).select(F.to_json(F.create_map(F.col("parent").cast("string"), F.col("sequence"))).alias("value"))
    return tables.sequence_map(objects)


_RATIO = "CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"


@query(f"WITH r AS (SELECT doc_id, 'row:' || doc_id AS cluster FROM documents), g AS (SELECT cluster, row_number() OVER (ORDER BY sha256('0:' || cluster), cluster) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM r)) SELECT cluster, doc_id, {_RATIO} AS split FROM r JOIN g USING (cluster)")
def row_split(spark: SparkSession, d: str) -> DataFrame:
    """G-04: measured rows are clusters of their own, split row by row."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("row:"), F.col("doc_id").cast("string")).alias("cluster"))
    return rows.join(split.group_split(rows, "cluster").hint("merge"), "cluster")


@query(f"""WITH s AS (SELECT DISTINCT sequence FROM {TURNS}), p AS (SELECT sequence[i + 1:i + k] AS piece FROM s, unnest(range(8, 19)) l(k), unnest(range(0, length(sequence) - k + 1)) t(i) UNION SELECT * FROM (SELECT unnest(regexp_extract_all(sequence, '[^KR]*[KR]|[^KR]+')) AS piece FROM s) WHERE length(piece) BETWEEN 8 AND 25)
    SELECT length(piece)::INT AS length, count(*) AS n FROM p GROUP BY 1""")
def peptide_pool(spark: SparkSession, d: str) -> DataFrame:
    """T-05, U-02: distinct windows of 8 to 18 of the turns and of their fragments, and whole fragments of 8 to 25, counted by length."""
    return tile.pool(turns(spark, d), *tile.cut_behind("sequence", "KR")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


# ---- stored and fitted heads -----------------------------------------------------------------

_HEADS = [[((i * 7 + h * 3) % 11 - 5) / 10.0 for i in range(64)] for h in range(3)]


@query(f"SELECT vec_id, round(({' + '.join(f'list_dot_product(v, {w}::DOUBLE[]) + {0.5 * h}' for h, w in enumerate(_HEADS))}) / 3, 5) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def linear_heads(spark: SparkSession, d: str) -> DataFrame:
    """L-07: the mean of three stored heads."""
    heads = [C.linear(F.col("embedding"), w, 0.5 * h) for h, w in enumerate(_HEADS)]
    return table(spark, d, "embeddings").select("vec_id", F.round(sum(heads) / len(heads), 5).alias("score"))


@query()
def ridge_spread(spark: SparkSession, d: str) -> DataFrame:
    """L-02: ridge scores of the vectors' labels with the spread of bootstrap replicates; no SQL, tests hold the fit against normal equations."""
    e = table(spark, d, "embeddings")
    w, c = learn.ridge_ensemble(e, "vec_id", F.col("embedding"), "label")
    return learn.ensemble_scores(e, "vec_id", F.col("embedding"), w, c)


_HEADED = "(SELECT vec_id, label AS allele, vec_id * 37 % 1000 / 10.0::DOUBLE AS percentile, embedding::DOUBLE[] AS v FROM embeddings)"
_COSINES = f"""(WITH h AS {_HEADED}, x AS (SELECT vec_id, allele, percentile, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM h),
    c AS (SELECT allele, i, coalesce(avg(e) FILTER (WHERE percentile <= 2), avg(e)) AS m FROM x GROUP BY allele, i)
    SELECT vec_id, x.allele, percentile, sum(e * m) / sqrt(sum(e * e) * sum(m * m)) AS cosine FROM x JOIN c ON c.allele = x.allele AND c.i = x.i GROUP BY vec_id, x.allele, percentile)"""


@query(f"""WITH t AS MATERIALIZED (SELECT vec_id, allele, cosine, least(1, greatest(0, 1 - percentile / 100)) AS y FROM {_COSINES}),
    p AS MATERIALIZED (SELECT *, row_number() OVER o AS i, sum(y) OVER o AS s FROM t WINDOW o AS (PARTITION BY allele ORDER BY cosine)),
    m AS (SELECT a.allele, b.vec_id, min((b.s - a.s + a.y) / (b.i - a.i + 1)) OVER (PARTITION BY a.allele, a.i ORDER BY b.i DESC) AS m FROM p a JOIN p b ON a.allele = b.allele AND a.i <= b.i)
    SELECT vec_id, allele, round(cosine, 5) AS cosine, round(propensity, 5) AS propensity FROM t JOIN (SELECT vec_id, max(m) AS propensity FROM m GROUP BY vec_id) USING (vec_id)""")
def allele_heads(spark: SparkSession, d: str) -> DataFrame:
    """L-04: vectors calibrated against the centroid of their label's best percentiles; the SQL takes largest least means."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("allele"), (F.col("vec_id") * 37 % 1000 / 10.0).alias("percentile"))
    return learn.allele_head(e, "allele", "embedding", "percentile").select("vec_id", "allele", F.round("cosine", 5).alias("cosine"), F.round("propensity", 5).alias("propensity"))


@query("SELECT o_orderkey, round(c_acctbal, 2) AS balance, md.kd AS kd FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS kd FROM lineitem GROUP BY l_orderkey) md ON md.l_orderkey = o_orderkey")
def reference_metadata(spark: SparkSession, d: str) -> DataFrame:
    """J-20: rows with their owner's metadata and the upper median of their measurements."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(join.upper_median(F.collect_list("l_extendedprice")).alias("kd"))
    met = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal").hint("merge"), "o_custkey")
    return met.join(li.select(F.col("l_orderkey").alias("o_orderkey"), "kd").hint("merge"), "o_orderkey", "left").select("o_orderkey", F.round("c_acctbal", 2).alias("balance"), "kd")


# ---- joins with their errors, reviews, surrogates --------------------------------------------


@query("SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, el, ba, left(o_orderpriority, 1) AS n_flank FROM (SELECT l_orderkey, l_linenumber, max(l_discount) AS el FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) a FULL JOIN (SELECT l_orderkey, l_linenumber, max(l_tax) AS ba FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber LEFT JOIN orders ON o_orderkey = coalesce(a.l_orderkey, b.l_orderkey)")
def whole_parent_labels(spark: SparkSession, d: str) -> DataFrame:
    """J-03: two label tables joined outer and one to one on their window, then many to one to the parent, a flank cut from it."""
    li = table(spark, d, "lineitem")
    el = li.where("l_returnflag <> 'A'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("el"))
    ba = li.where("l_linestatus = 'F'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("ba"))
    both = join.validated_join(el, ba, ["l_orderkey", "l_linenumber"], "full", "1:1")
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.left("o_orderpriority", F.lit(1)).alias("n_flank"))
    return join.validated_join(both, parents, ["l_orderkey"])


@query("SELECT o_custkey AS component, max(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END)::INT AS priority FROM orders GROUP BY o_custkey")
def component_novelty(spark: SparkSession, d: str) -> DataFrame:
    """J-22: components to parents to their novelty; a parent without metadata is an error."""
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("parent"))
    level = F.when(F.left("o_orderpriority", F.lit(1)).between("1", "4"), 5 - F.left("o_orderpriority", F.lit(1)).cast("int")).otherwise(0)
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("parent"), level.alias("priority"))
    met = join.require_matched(join.validated_join(members, known, ["parent"]), "priority")
    return met.groupBy("component").agg(F.max("priority").alias("priority"))


@query("""SELECT rule, n_bad FROM (SELECT count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05) AS a, count(*) FILTER (WHERE l_linestatus = 'F' AND l_tax > 0) AS b, count(*) FILTER (WHERE l_linenumber > 7) AS c FROM lineitem),
    LATERAL (VALUES ('provider_ok', a), ('unavailable_has_no_rank', b), ('alleles', c)) t(rule, n_bad)""")
def review_gates(spark: SparkSession, d: str) -> DataFrame:
    """X-01: three row rules counted in one pass; `assessment_review` and `campaign_review` hold the review itself."""
    c = F.col
    checks = {
        "provider_ok": ("error", (c("l_returnflag") == "R") & (c("l_discount") > 0.05)),
        "unavailable_has_no_rank": ("error", (c("l_linestatus") == "F") & (c("l_tax") > 0)),
        "alleles": ("error", c("l_linenumber") > 7),
    }
    return quality.rules(table(spark, d, "lineitem"), checks).select("rule", "n_bad")


@query("""SELECT parent, round(avg(r) FILTER (WHERE k <= 5), 6) AS top5, arg_max(s, (r, -s)) AS max_start, round(avg(c), 6) AS confidence, round(max(greatest(r, c)), 6) AS channel_max, ['nonbinder', 'weak', 'strong'][max(level) + 1] AS class
    FROM (SELECT l_orderkey AS parent, l_linenumber AS s, l_discount AS r, sqrt(l_quantity) AS c, CASE WHEN l_tax * 100 <= 0.5 THEN 2 WHEN l_tax * 100 <= 2 THEN 1 ELSE 0 END AS level, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS k FROM lineitem) GROUP BY parent""")
def surrogate_summary(spark: SparkSession, d: str) -> DataFrame:
    """A-29: mean of the five highest windows, where the highest is, mean confidence, the channels' maximum and the highest class."""
    c = F.col
    w = table(spark, d, "lineitem").select(c("l_orderkey").alias("parent"), c("l_linenumber").alias("start"), c("l_discount").alias("risk"), F.sqrt("l_quantity").alias("other"), C.binder_class(c("l_tax") * 100).alias("class"))
    got = rollup.surrogate(w, "parent", "risk", "other", "class")
    return got.select("parent", r6("top5").alias("top5"), "max_start", r6("confidence").alias("confidence"), r6("channel_max").alias("channel_max"), "class")


@query("SELECT l_orderkey AS parent, l_linenumber AS start, l_orderkey::VARCHAR || '_nbhd' || (l_linenumber // 5)::VARCHAR AS cluster FROM lineitem")
def neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    """G-02: clusters of windows that begin near each other."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("start"), split.neighbourhood(F.col("l_orderkey"), F.col("l_linenumber")).alias("cluster"))


@query("SELECT o_orderkey, round(1 + 4 * ((o_orderkey % 9 <= 2)::INT + (o_orderkey % 7 <= 2)::INT) / 2.0, 6) AS weight FROM orders")
def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    """G-16: weights by the channels with a strong or weak rank."""
    return table(spark, d, "orders").select("o_orderkey", r6(split.sample_weight(F.col("o_orderkey") % 9, F.col("o_orderkey") % 7)).alias("weight"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sorted_rows(spark: SparkSession, d: str) -> DataFrame:
    """O-01: a sort with a full tie key, by ranges."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
