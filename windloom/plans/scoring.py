"""Queries on scores: functions, roll-ups, ranking, metrics, splits, quality, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.operators import collapse, join, metrics, quality, rank, rollup, split
from windloom.plans.views import OUTCOMES, SCORED_WINDOWS, outcomes, scored_windows, table

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

# ---- scalar functions ------------------------------------------------------------------------

_RANK = "((l_orderkey * 7 + l_linenumber * 131) % 10000) / 100.0::DOUBLE"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 10000 / 100.0).alias("rank"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


@query(f"""SELECT l_orderkey, l_linenumber, round(p, 6) AS propensity, round(exp((1 - p) * ln(101)) - 1, 4) AS back, round(least(1, greatest(0, 1 - ln(greatest(price, 1)) / ln(50000))), 6) AS affinity,
    round(pow(50000, 1 - d), 4) AS ic50, round(1 - least(100, greatest(0, rank)) / 100, 6) AS support
    FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_discount AS d, {_RANK} AS rank, 1 - ln(1 + {_RANK}) / ln(101) AS p FROM lineitem)""")
def rank_transforms(spark: SparkSession, d: str) -> DataFrame:
    """F-01 to F-04, F-11."""
    t = _ranked(spark, d).withColumn("p", C.rank_to_propensity(F.col("rank")))
    return t.select("l_orderkey", "l_linenumber", r6("p").alias("propensity"), F.round(C.propensity_to_rank(F.col("p")), 4).alias("back"), r6(C.score_or_ic50(F.lit(None).cast("double"), F.col("price"))).alias("affinity"), F.round(C.affinity_to_ic50(F.col("discount")), 4).alias("ic50"), r6(C.rank_support(F.col("rank"))).alias("support"))


@query(f"SELECT CASE WHEN rank <= 0.5 THEN 'strong' WHEN rank <= 2 THEN 'weak' ELSE 'nonbinder' END AS binder_class, count(*) AS n, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (SELECT {_RANK} AS rank FROM lineitem) GROUP BY 1")
def binder_class(spark: SparkSession, d: str) -> DataFrame:
    """F-05, A-16."""
    t = _ranked(spark, d).withColumn("binder_class", C.binder_class(F.col("rank")))
    g = t.groupBy("binder_class").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rank")).alias("mean_rank"))
    g = g.join(metrics.grouped_median(t, "rank", ["binder_class"], "m").withColumn("median_rank", r6("m")).drop("m").hint("merge"), "binder_class")
    return g.withColumn("share", r6(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())))


@query(f"SELECT CASE WHEN rank <= 0.5 + 5.01e-6 THEN 'high' WHEN rank <= 2.00002001 THEN 'moderate' ELSE 'low' END AS risk_band, count(*) AS n, count(*) FILTER (WHERE 1 - ln(1 + rank) / ln(101) >= 0.7892)::BIGINT AS flagged FROM (SELECT {_RANK} AS rank FROM lineitem) GROUP BY 1")
def profile_bands(spark: SparkSession, d: str) -> DataFrame:
    """F-06: how many profiles each risk band has, and how many of them are flagged for screening."""
    p = C.rank_to_propensity(F.col("rank"))
    t = _ranked(spark, d).withColumn("x", C.profile(p, p))
    return t.groupBy("x.risk_band").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.flagged").alias("flagged"))


@query("""SELECT l_orderkey, l_linenumber, round(exp((ln(greatest(l_discount, 1e-6)) + ln(greatest(l_tax, 1e-6)) + ln(greatest(least(l_quantity / 50.0, 1), 1e-6))) / 3), 6) AS risk, round(sqrt(l_discount * l_tax), 6) AS generation,
    round(pow(l_quantity / 50.0, 0.7) * pow(sqrt(l_discount * l_tax), 0.3), 6) AS pathway FROM lineitem""")
def pathway(spark: SparkSession, d: str) -> DataFrame:
    """F-07 to F-09."""
    li = table(spark, d, "lineitem")
    el, gen = F.col("l_quantity") / 50.0, C.generation(F.col("l_discount"), F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", r6(C.geometric_mean(F.col("l_discount"), F.col("l_tax"), el)).alias("risk"), r6(gen).alias("generation"), r6(C.pathway(el, gen)).alias("pathway"))


_AGREE = "sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3)"


@query(f"""SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, 1 - {_AGREE} / 0.4714)), 6) AS agreement, round(abs(b - 0.5) * 2, 6) AS decisiveness, round(CASE WHEN b <= 0 OR b >= 1 THEN 0 ELSE -(b * ln(b) + (1 - b) * ln(1 - b)) END, 6) AS entropy
    FROM (SELECT *, (a + b + c) / 3 AS m FROM (SELECT l_orderkey, l_linenumber, l_discount AS a, l_quantity / 50.0::DOUBLE AS b, l_tax AS c FROM lineitem))""")
def confidence_parts(spark: SparkSession, d: str) -> DataFrame:
    """F-10, F-21."""
    li = table(spark, d, "lineitem")
    b = F.col("l_quantity") / 50.0
    return li.select("l_orderkey", "l_linenumber", r6(C.agreement(F.col("l_discount"), b, F.col("l_tax"))).alias("agreement"), r6(C.decisiveness(b)).alias("decisiveness"), r6(C.entropy(b)).alias("entropy"))


_W = {"response": 0.45, "el": 0.25, "ba": 0.15, "cleavage": 0.1, "tolerance": 0.05}
_PART = "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS response, l_tax AS el, l_quantity / 50.0::DOUBLE AS ba, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount * 2 END AS cleavage, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_tax * 3 END AS tolerance"


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN response IS NOT NULL THEN (0.45 * response + 0.25 * el + 0.15 * ba + coalesce(0.1 * cleavage, 0) + coalesce(0.05 * tolerance, 0)) / (0.85 + CASE WHEN cleavage IS NULL THEN 0 ELSE 0.1 END + CASE WHEN tolerance IS NULL THEN 0 ELSE 0.05 END) END, 6) AS fused,
    round((0.25 * el + 0.15 * ba + coalesce(0.1 * cleavage, 0) + coalesce(0.05 * tolerance, 0)) / (0.4 + CASE WHEN cleavage IS NULL THEN 0 ELSE 0.1 END + CASE WHEN tolerance IS NULL THEN 0 ELSE 0.05 END), 6) AS without_response FROM (SELECT l_orderkey, l_linenumber, {_PART} FROM lineitem)""")
def fusion(spark: SparkSession, d: str) -> DataFrame:
    """F-22."""
    li = table(spark, d, "lineitem")
    p = {
        "response": F.when(F.col("l_linenumber") != 2, F.col("l_discount")),
        "el": F.col("l_tax"),
        "ba": F.col("l_quantity") / 50.0,
        "cleavage": F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 2),
        "tolerance": F.when(F.col("l_linestatus") != "O", F.col("l_tax") * 3),
    }
    need = ["response", "el", "ba"]
    return li.select("l_orderkey", "l_linenumber", r6(C.fuse(p, _W, need)).alias("fused"), r6(C.ablations(p, _W, need)["response"]).alias("without_response"))


@query("SELECT grp, count(*) AS n, round(median(e), 6) AS median_error, round(avg((e <= 2)::INT), 6) AS within_2x, round(avg((e <= 5)::INT), 6) AS within_5x FROM (SELECT l_linenumber AS grp, exp(abs(ln(l_extendedprice) - ln(l_quantity * 1500))) AS e FROM lineitem) GROUP BY grp")
def fold_error(spark: SparkSession, d: str) -> DataFrame:
    """F-27: median fold errors and shares by group."""
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("grp"), C.fold_error(F.col("l_extendedprice"), F.col("l_quantity") * 1500).alias("e"))
    return metrics.grouped_median(li, "e", ["grp"], "m").select("grp", r6("m").alias("median_error")).join(li.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("e") <= 2).cast("int"))).alias("within_2x"), r6(F.avg((F.col("e") <= 5).cast("int"))).alias("within_5x")).hint("merge"), "grp")


@query("""SELECT o_custkey, round(least(100, least(40, n * 8) + least(30, u * 3)), 6) AS risk, CASE WHEN least(100, least(40, n * 8) + least(30, u * 3)) >= 55 THEN 'high' WHEN least(100, least(40, n * 8) + least(30, u * 3)) >= 30 THEN 'moderate' ELSE 'low' END AS band
    FROM (SELECT o_custkey, count(*)::DOUBLE AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT')::DOUBLE AS u FROM orders GROUP BY o_custkey)""")
def additive_risk(spark: SparkSession, d: str) -> DataFrame:
    """F-26."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("u"))
    risk = C.capped_risk([(F.col("n"), 8.0, 40.0), (F.col("u"), 3.0, 30.0)])
    return n.select("o_custkey", r6(risk).alias("risk"), C.risk_band(risk).alias("band"))


@query("""SELECT l_orderkey, round(arg_min(l_discount, (round(o, 9), l_linenumber, l_discount)), 6) AS risk, round(min(o), 6) AS objective FROM (SELECT *, l_discount + 0.25 * l_tax + l_quantity / 100.0 + 0.5 * l_discount * l_tax AS o FROM lineitem) WHERE l_quantity <= 40 GROUP BY l_orderkey""")
def candidate_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """F-28: the accepted candidate with the lowest objective of each parent; of those equal to nine digits the first by line, then by risk."""
    li = table(spark, d, "lineitem").where("l_quantity <= 40")
    o = C.objective(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100.0, F.col("l_discount") * F.col("l_tax"))
    return li.withColumn("o", o).groupBy("l_orderkey").agg(r6(F.min_by("l_discount", F.struct(F.round("o", 9), "l_linenumber", "l_discount"))).alias("risk"), r6(F.min("o")).alias("objective"))


# ---- roll-ups and ranking --------------------------------------------------------------------


@query(f"""SELECT parent, count(*) AS n_windows, round(avg(risk) FILTER (WHERE rn <= 5), 6) AS topk_mean, round(max(risk), 6) AS max_risk, arg_max(start, (risk, -start)) AS max_start, count(*) FILTER (WHERE risk >= 0.5)::BIGINT AS n_high, round(avg(confidence), 6) AS mean_confidence, round(arg_max(confidence, (risk, -start)), 6) AS confidence_at_max
    FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY risk DESC, start) AS rn FROM {SCORED_WINDOWS}) GROUP BY parent""")
def protein_topk(spark: SparkSession, d: str) -> DataFrame:
    """A-24, A-29, O-02."""
    t = rollup.protein_risk(scored_windows(spark, d))
    return t.select("parent", "n_windows", r6("topk_mean").alias("topk_mean"), r6("max_risk").alias("max_risk"), "max_start", "n_high", r6("mean_confidence").alias("mean_confidence"), r6("confidence_at_max").alias("confidence_at_max"))


@query(f"""WITH w AS {SCORED_WINDOWS}, l AS (SELECT parent, max("end") + 2 AS length FROM w GROUP BY parent), spine AS (SELECT parent, p::INT AS pos FROM l, unnest(range(0, length)) t(p))
    SELECT s.parent, s.pos, round(coalesce(max(risk), 0), 6) AS max_value, round_even(coalesce(avg(risk), 0), 6) AS mean_value, count(risk) AS n FROM spine s LEFT JOIN w ON w.parent = s.parent AND s.pos >= w.start AND s.pos < w."end" GROUP BY s.parent, s.pos""")
def residue_heat(spark: SparkSession, d: str) -> DataFrame:
    """A-25, A-26: highest and mean window over each residue, and how many."""
    w = scored_windows(spark, d)
    t = rollup.residue_track(w, w.groupBy("parent").agg((F.max("end") + 2).alias("length")))
    return t.select("parent", "pos", r6("max_value").alias("max_value"), "mean_value", "n")


@query(f"SELECT parent, round(1 - product(1 - least(greatest(risk, 0), 1 - 1e-9)), 6) AS any_risk, round(CASE WHEN sum(risk) > 1e-12 THEN sum(confidence * risk) / sum(risk) ELSE avg(confidence) END + 1e-9, 4) AS confidence FROM {SCORED_WINDOWS} GROUP BY parent")
def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    """A-30, A-31."""
    return scored_windows(spark, d).groupBy("parent").agg(r6(rollup.noisy_or(F.col("risk"))).alias("any_risk"), F.round(rollup.weighted_mean(F.col("confidence"), F.col("risk")) + 1e-9, 4).alias("confidence"))


@query(f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY risk DESC, start) AS rn FROM {SCORED_WINDOWS}),
    step(parent, rn, taken) AS (SELECT DISTINCT parent, 0::BIGINT, []::INT[] FROM w UNION ALL SELECT w.parent, w.rn, CASE WHEN len(list_filter(step.taken, lambda s: s < w."end" AND w.start < s + 9)) > 0 OR len(step.taken) >= 25 THEN step.taken ELSE list_append(step.taken, w.start) END FROM step JOIN w ON w.parent = step.parent AND w.rn = step.rn + 1)
    SELECT parent, array_to_string(arg_max(taken, rn), ',') AS taken FROM step GROUP BY parent""")
def non_maximum(spark: SparkSession, d: str) -> DataFrame:
    """O-03: greedy disjoint windows, highest first."""
    w = scored_windows(spark, d)
    best = F.array_sort(F.collect_list(F.struct((-F.col("risk")).alias("r"), "start", "end")))
    t = w.groupBy("parent").agg(best.alias("w"))
    return t.select("parent", F.array_join(F.transform(rank.spaced_peaks(F.col("w"), 25), lambda x: x["start"].cast("string")), ",").alias("taken"))


@query(f"SELECT parent, start, round(avg(risk) OVER (PARTITION BY parent ORDER BY start ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS mean, count(risk) OVER (PARTITION BY parent ORDER BY start ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS observed FROM {SCORED_WINDOWS}")
def moving_mean(spark: SparkSession, d: str) -> DataFrame:
    """O-06."""
    return rank.moving_mean(scored_windows(spark, d), ["parent"], "start", "risk", 3).select("parent", "start", r6("mean").alias("mean"), "observed")


@query(f"SELECT parent, start, round(CASE WHEN m > 0 THEN risk / m ELSE risk END, 6) AS normalised FROM (SELECT *, max(risk) OVER (PARTITION BY parent) AS m FROM {SCORED_WINDOWS})")
def normalised_track(spark: SparkSession, d: str) -> DataFrame:
    """Risks divided by their parent's largest; `profile_heat` has A-27."""
    return rollup.normalised(scored_windows(spark, d), "parent", "risk").select("parent", "start", r6("normalised").alias("normalised"))


@query("WITH r AS (SELECT l_extendedprice AS v FROM lineitem), n AS (SELECT count(*)::DOUBLE AS n FROM r), q AS (SELECT DISTINCT o_totalprice / 4 AS v FROM orders), u AS (SELECT v, count(*) FILTER (WHERE k = 1) AS c FROM (SELECT v, 1 AS k FROM r UNION ALL SELECT v, 0 FROM q) GROUP BY v), s AS (SELECT v, sum(c) OVER (ORDER BY v) - c AS below FROM u) SELECT o_orderkey, round(100.0 * below / n, 6) AS percentile FROM orders JOIN s ON s.v = o_totalprice / 4, n")
def percentile_vs_ref(spark: SparkSession, d: str) -> DataFrame:
    """O-10: the percentage of reference values below each; `familiarity` has O-11."""
    q = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 4).alias("v"))
    t = rank.percentile_against(q, table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v")), "v")
    return t.select("o_orderkey", r6("percentile").alias("percentile"))


@query("SELECT c_custkey, c_acctbal, rank() OVER (ORDER BY c_acctbal DESC NULLS LAST)::INT AS place FROM customer QUALIFY place <= 100")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """O-09, O-14: the first hundred by score, ties included, nulls last."""
    t = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    edge = t.orderBy(F.desc_nulls_last("c_acctbal")).limit(100).agg(F.min("c_acctbal").alias("edge"))
    few = t.join(F.broadcast(edge), F.col("c_acctbal") >= F.col("edge"))  # edge is one row
    return few.select("c_custkey", "c_acctbal", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c_acctbal"))).alias("place"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 4")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    """O-15."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(4)


# ---- metrics ---------------------------------------------------------------------------------


@query(f"WITH o AS {OUTCOMES}, r AS (SELECT score, activity, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY activity) + (count(*) OVER (PARTITION BY activity) - 1) / 2.0 AS b FROM o) SELECT round(corr(a, b), 6) AS spearman, round(corr(score, activity), 6) AS pearson, count(*) AS n FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """M-01, O-13."""
    return metrics.spearman(outcomes(spark, d), "score", "activity").select(r6("spearman").alias("spearman"), r6("pearson").alias("pearson"), "n")


_AUC = "SELECT {g} sum(label::INT)::BIGINT AS n_pos, sum((NOT label)::INT)::BIGINT AS n_neg, round((sum(r) FILTER (WHERE label) - sum(label::INT) * (sum(label::INT) + 1) / 2.0) / (sum(label::INT) * sum((NOT label)::INT)), 6) AS roc_auc FROM (SELECT *, rank() OVER ({p} ORDER BY score) + (count(*) OVER (PARTITION BY {q} score) - 1) / 2.0::DOUBLE AS r FROM " + OUTCOMES + ") {b}"


@query(_AUC.format(g="", p="", q="", b=""))
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """M-02."""
    return metrics.roc_auc(outcomes(spark, d), "score", "label").withColumn("roc_auc", r6("roc_auc"))


@query(_AUC.format(g="grp,", p="PARTITION BY grp", q="grp,", b="GROUP BY grp"))
def group_auc(spark: SparkSession, d: str) -> DataFrame:
    """M-11."""
    return metrics.roc_auc(outcomes(spark, d), "score", "label", ["grp"]).withColumn("roc_auc", r6("roc_auc"))


_STEPS = f"(SELECT score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER () AS total FROM (SELECT score, sum(label::INT) AS pos, count(*) AS n FROM {OUTCOMES} GROUP BY score) WINDOW w AS (ORDER BY score DESC))"


@query(f"SELECT sum(pos)::BIGINT AS n_pos, round(sum(pos * tp::DOUBLE / flagged) / sum(pos), 6) AS average_precision FROM {_STEPS}")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    """M-03, O-05."""
    return metrics.average_precision(outcomes(spark, d), "score", "label").withColumn("average_precision", r6("average_precision"))


@query(f"SELECT target::DOUBLE AS target, max(score) AS threshold, round(arg_max(tp / total::DOUBLE, score), 6) AS recall, round(arg_max(tp / flagged::DOUBLE, score), 6) AS precision, arg_max(flagged, score)::BIGINT AS flagged FROM {_STEPS}, (VALUES (0.5), (0.8), (0.9), (0.95)) t(target) WHERE tp / total::DOUBLE >= target GROUP BY target")
def recall_points(spark: SparkSession, d: str) -> DataFrame:
    """M-09."""
    return metrics.recall_points(outcomes(spark, d), "score", "label").withColumns({c: r6(c) for c in ("recall", "precision")})


@query(f"SELECT round(avg(abs(score - activity / 50)), 6) AS mae, round(sqrt(avg(pow(score - activity / 50, 2))), 6) AS rmse, round(avg(pow(score - activity / 50, 2)), 6) AS mse, round(avg(((score > 0.5) = (activity / 50 > 0.5))::INT), 6) AS accuracy FROM {OUTCOMES}")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M-04."""
    t = metrics.error_metrics(outcomes(spark, d).withColumn("actual", F.col("activity") / 50), "score", "actual")
    return t.select(*[r6(c).alias(c) for c in t.columns])


@query(f"SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM (SELECT least(floor(score * 15), 14) AS b, count(*) AS n, avg(score) AS c, avg(label::INT) AS a FROM {OUTCOMES} GROUP BY b)")
def ece(spark: SparkSession, d: str) -> DataFrame:
    """M-05."""
    return metrics.calibration(outcomes(spark, d), "score", "label").withColumn("ece", r6("ece"))


@query(f"SELECT grp, count(*) AS n, count(*) FILTER (WHERE score >= 0.5)::BIGINT AS flagged, count(*) FILTER (WHERE (score >= 0.5) = label)::BIGINT AS agree, round(avg(((score >= 0.5) = label)::INT), 6) AS agreement FROM {OUTCOMES} GROUP BY grp")
def agreement_at_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """M-06."""
    o = outcomes(spark, d)
    same = (F.col("score") >= 0.5) == F.col("label")
    return o.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.5).alias("flagged"), F.count_if(same).alias("agree"), r6(F.avg(same.cast("int"))).alias("agreement"))


@query()
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """M-08: statistical, so held against its interval in the tests."""
    return metrics.bootstrap(outcomes(spark, d), "id", "score", 50)


# ---- splits ----------------------------------------------------------------------------------

_SPLIT = "(SELECT {g}, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT {g}, row_number() OVER (ORDER BY sha256('0:' || {g}), {g}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT {g} FROM {t})))"


@query("SELECT * FROM " + _SPLIT.format(g="o_custkey", t="orders"))
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """G-01, G-03."""
    return split.group_split(table(spark, d, "orders"), "o_custkey")


@query("SELECT count(*) FILTER (WHERE n > 1)::BIGINT AS n_leaks, max(n) AS most FROM (SELECT o_custkey, count(DISTINCT split) AS n FROM (SELECT o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM orders) GROUP BY o_custkey)")
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    """A-15."""
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "test").otherwise("train").alias("split"))
    return quality.leaks(o, "o_custkey").agg(F.count(F.lit(1)).alias("n_leaks"), F.max("n_splits").alias("most"))


@query("SELECT rotation::INT AS rotation, split, count(*) AS n FROM (SELECT rotation, CASE WHEN fold IS NULL THEN 'challenge' WHEN fold = rotation THEN 'test' WHEN fold = (rotation + 1) % 5 THEN 'val' ELSE 'train' END AS split FROM (SELECT CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey % 6 END AS fold FROM orders), unnest(range(0, 5)) t(rotation)) GROUP BY ALL")
def fold_rotation(spark: SparkSession, d: str) -> DataFrame:
    """G-06, G-07."""
    f = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 6 != 5, F.col("o_orderkey") % 6).alias("fold"))
    return split.rotations(f).groupBy("rotation", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM orders),
    r AS (SELECT o_orderkey, b, row_number() OVER (PARTITION BY b ORDER BY sha256('0:' || o_orderkey), o_orderkey) AS rn, len(e) - 1 AS bins FROM (SELECT o_orderkey, e, len(list_filter(e[2:-2], lambda x: o_totalprice > x)) AS b FROM orders, e)),
    f AS (SELECT o_orderkey FROM r WHERE rn <= 1005 // bins)
    SELECT o_orderkey FROM f UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM r WHERE rn > 1005 // bins ORDER BY sha256('0t:' || o_orderkey), o_orderkey LIMIT (SELECT 1005 - count(*) FROM f))""")
def qcut_sample(spark: SparkSession, d: str) -> DataFrame:
    """G-09."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return split.quantile_sample(o, 1005, "o_totalprice", "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('0:' || o_orderkey), o_orderkey LIMIT 500")
def subsample(spark: SparkSession, d: str) -> DataFrame:
    """G-11."""
    return split.subsample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


_NOVEL = "(SELECT o_custkey AS component, CASE o_orderkey % 5 WHEN 0 THEN 'unscored' WHEN 1 THEN 'natural_like' WHEN 2 THEN 'similar' WHEN 3 THEN 'distant' ELSE 'novel' END AS novelty FROM orders)"


@query(f"SELECT component, max(p)::INT AS priority, ['exclude', 'train', 'train', 'val', 'test'][max(p) + 1] AS split FROM (SELECT component, list_position(['unscored', 'natural_like', 'similar', 'distant', 'novel'], novelty) - 1 AS p FROM {_NOVEL}) GROUP BY component")
def novelty_split(spark: SparkSession, d: str) -> DataFrame:
    """G-12: the novelty by the order's number, over all orders."""
    n = F.element_at(F.array(*[F.lit(x) for x in split.NOVELTY]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return split.novelty_split(table(spark, d, "orders").select(F.col("o_custkey").alias("component"), n.alias("novelty")))


@query("SELECT component, max(p)::INT AS priority, ['exclude', 'train', 'train', 'val', 'test'][max(p) + 1] AS split FROM (SELECT o_custkey AS component, left(o_orderpriority, 1)::INT - 1 AS p FROM orders) GROUP BY component")
def novelty_split_all(spark: SparkSession, d: str) -> DataFrame:
    """G-12: over all orders, the novelty by the order's priority."""
    n = F.element_at(F.array(*[F.lit(x) for x in split.NOVELTY]), F.left("o_orderpriority", F.lit(1)).cast("int"))
    return split.novelty_split(table(spark, d, "orders").select(F.col("o_custkey").alias("component"), n.alias("novelty")))


@query("SELECT s.o_custkey, min(coalesce(x.split, s.split)) AS split FROM " + _SPLIT.format(g="o_custkey", t="(SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5))") + " s FULL JOIN (SELECT c_custkey, 'train' AS split FROM customer WHERE FALSE) x ON x.c_custkey = s.o_custkey GROUP BY s.o_custkey UNION ALL SELECT DISTINCT o_custkey, 'val' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 5")
def inherit_split(spark: SparkSession, d: str) -> DataFrame:
    """J-09: customers of some nations keep their split, others get one."""
    old = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"), F.lit("val").alias("split"))
    return split.inherit_split(table(spark, d, "orders").select("o_custkey"), old, "o_custkey").distinct()


# ---- joins -----------------------------------------------------------------------------------


@query("""WITH el AS (SELECT l_orderkey AS k, max(l_discount) AS el FROM lineitem WHERE l_returnflag = 'R' GROUP BY k), ba AS (SELECT l_orderkey AS k, max(l_tax) AS ba FROM lineitem WHERE l_returnflag = 'A' GROUP BY k), c AS (SELECT coalesce(el.k, ba.k) AS k, el, ba FROM el FULL JOIN ba ON el.k = ba.k)
    SELECT o_orderstatus, count(*) AS n, count(el) AS n_el, count(ba) AS n_ba, round(sum(el), 6) AS el, round(sum(ba), 6) AS ba FROM orders LEFT JOIN c ON k = o_orderkey GROUP BY o_orderstatus""")
def channel_outer(spark: SparkSession, d: str) -> DataFrame:
    """J-02: two channels joined one to one, then to many rows, with checks."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    el = li.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.max("l_discount").alias("el"))
    ba = li.where("l_returnflag = 'A'").groupBy("o_orderkey").agg(F.max("l_tax").alias("ba"))
    both = join.validated_join(el, ba, ["o_orderkey"], "full", "1:1")
    rows = join.validated_join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), both, ["o_orderkey"], "left", "m:1")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("el").alias("n_el"), F.count("ba").alias("n_ba"), r6(F.sum("el")).alias("el"), r6(F.sum("ba")).alias("ba"))


@query("SELECT row_id, round(avg(score), 6) AS ensemble, round(max(score) FILTER (WHERE head = row_id % 5), 6) AS held_out FROM (SELECT o_orderkey AS row_id, head, (o_totalprice * (head + 1)) % 97 / 97 AS score FROM orders, unnest(range(0, 5)) t(head)) GROUP BY row_id")
def oof_pick(spark: SparkSession, d: str) -> DataFrame:
    """J-19: the head that held the row out, and the mean over heads."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("head"))
    o = o.withColumn("score", (F.col("o_totalprice") * (F.col("head") + 1)) % 97 / 97)
    return o.groupBy("row_id").agg(r6(F.avg("score")).alias("ensemble"), r6(F.max(F.when(F.col("head") == F.col("row_id") % 5, F.col("score")))).alias("held_out"))


@query("SELECT o_custkey, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median_price FROM orders GROUP BY o_custkey")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """J-20."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v")).select("o_custkey", join.upper_median(F.col("v")).alias("median_price"))


@query("""SELECT p_partkey, arg_max(n_name, (i, -n_nationkey)) AS nearest, round(max(i), 6) AS identity, CASE WHEN max(i) >= 0.85 THEN 'self_like' WHEN max(i) <= 0.35 THEN 'foreign_like' ELSE 'unknown' END AS status
    FROM (SELECT p_partkey, n_name, n_nationkey, len(list_filter(range(1, least(length(a), length(n_name)) + 1), lambda k: substr(a, k, 1) = substr(n_name, k, 1)))::DOUBLE / greatest(length(a), length(n_name)) AS i FROM (SELECT p_partkey, upper(p_name) AS a FROM part), nation) GROUP BY p_partkey""")
def identity_nearest(spark: SparkSession, d: str) -> DataFrame:
    """J-17: the nearest of a fixed reference list by positional identity; the list (25 nations) is an array of each row, not a join."""
    from windloom.functions.sequence import identity

    ref = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ref"))
    t = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("a")).crossJoin(F.broadcast(ref))  # ref is one row
    best = F.array_max(F.transform("ref", lambda r: F.struct(F.coalesce(identity(F.col("a"), r["n_name"]), F.lit(0.0)).alias("i"), (-r["n_nationkey"]).alias("k"), r["n_name"].alias("name"))))
    t = t.select("p_partkey", best.alias("b"))
    return t.select("p_partkey", F.col("b.name").alias("nearest"), r6("b.i").alias("identity"), F.when(F.col("b.i") >= 0.85, "self_like").when(F.col("b.i") <= 0.35, "foreign_like").otherwise("unknown").alias("status"))


# ---- quality and description -----------------------------------------------------------------


@query("""SELECT * FROM (SELECT 'text_present' AS rule, 'error' AS severity, count(*) FILTER (WHERE text IS NULL)::BIGINT AS n_bad, count(*) AS n_rows FROM documents UNION ALL SELECT 'length_matches', 'error', count(*) FILTER (WHERE length(text) <> n_chars)::BIGINT, count(*) FROM documents
    UNION ALL SELECT 'known_language', 'error', count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es'))::BIGINT, count(*) FROM documents UNION ALL SELECT 'long_enough', 'warning', count(*) FILTER (WHERE n_chars < 200)::BIGINT, count(*) FROM documents)""")
def rules(spark: SparkSession, d: str) -> DataFrame:
    """X-01."""
    docs = table(spark, d, "documents")
    return quality.rules(docs, {
        "text_present": ("error", F.col("text").isNull()),
        "length_matches": ("error", F.char_length("text") != F.col("n_chars")),
        "known_language": ("error", ~F.col("lang").isin("en", "de", "fr", "es")),
        "long_enough": ("warning", F.col("n_chars") < 200),
    })


@query("SELECT text_hash, n FROM (SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """O-16."""
    return quality.duplicates(table(spark, d, "documents").select(F.md5("text").alias("text_hash")), "text_hash")


@query()
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """X-03: its properties are in the tests."""
    return quality.fingerprint(table(spark, d, "documents"))


@query("SELECT 'value' AS name, count(value) AS present, (count(*) - count(value))::BIGINT AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM events UNION ALL SELECT 'user_id', count(user_id), (count(*) - count(user_id))::BIGINT, round(avg(user_id), 6), round(stddev_samp(user_id), 6), min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A-09, A-10."""
    t = quality.coverage(table(spark, d, "events"), ["value", "user_id"])
    return t.withColumns({"mean": r6("mean"), "std": r6("std")})


@query("SELECT lang, count(*) FILTER (WHERE toxic = 0)::BIGINT AS clean, count(*) FILTER (WHERE toxic = 1)::BIGINT AS toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """A-13."""
    t = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return t.groupBy("lang").pivot("toxic", [0, 1]).agg(F.count(F.lit(1))).select("lang", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-08: counts by several columns in one job."""
    docs = table(spark, d, "documents").select("lang", "source")
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS max FROM documents")
def describe(spark: SparkSession, d: str) -> DataFrame:
    """A-14: quartiles come from counts by value over ranges, the rest from one aggregation."""
    c, docs = "n_chars", table(spark, d, "documents")
    quartiles = [F.lit(q).cast("double").alias(f"q{i + 1}") for i, q in enumerate(rank.exact_quantiles(docs, c, [0.25, 0.5, 0.75]))]
    found = docs.agg(F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return found.select("*", *quartiles)


@query("SELECT user_id, round(avg(value), 6) AS mean_activity, max(value) AS max_response, bool_or(event_type = 'click') AS flagged, count(*) AS n FROM events GROUP BY user_id")
def replicate_collapse(spark: SparkSession, d: str) -> DataFrame:
    """A-20."""
    return table(spark, d, "events").groupBy("user_id").agg(r6(F.avg("value")).alias("mean_activity"), F.max("value").alias("max_response"), F.max(F.col("event_type") == "click").alias("flagged"), F.count(F.lit(1)).alias("n"))


@query("SELECT grp, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std_pop, round(stddev_samp(auc), 6) AS std_samp FROM (SELECT l_returnflag AS grp, l_linenumber AS fold, avg(l_discount) AS auc FROM lineitem GROUP BY ALL) GROUP BY grp")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    """A-18, A-19."""
    f = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("auc"))
    return f.groupBy("grp").agg(r6(F.avg("auc")).alias("mean"), r6(F.stddev_pop("auc")).alias("std_pop"), r6(F.stddev_samp("auc")).alias("std_samp"))


@query("SELECT source, records, sample FROM (SELECT source, count(*) AS records, array_to_string(list_sort(list_transform(list_sort(list(doc_id))[1:3], lambda x: x::VARCHAR)), ',') AS sample FROM documents GROUP BY source)")
def sample_ids(spark: SparkSession, d: str) -> DataFrame:
    """A-35."""
    return collapse.sample_ids(table(spark, d, "documents"), "source", "doc_id")


# ---- sets and vectors ------------------------------------------------------------------------


@query("SELECT c_nationkey, count(*) FILTER (WHERE o)::BIGINT AS both, count(*) FILTER (WHERE NOT o)::BIGINT AS only_customers FROM (SELECT c_nationkey, c_custkey IN (SELECT o_custkey FROM orders) AS o FROM customer) GROUP BY c_nationkey")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """U-04: keys of one side in the other, and not."""
    c, o = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    inside, outside = c.join(o, "c_custkey", "left_semi").withColumn("o", F.lit(True)), c.join(o, "c_custkey", "left_anti").withColumn("o", F.lit(False))
    return inside.unionByName(outside).groupBy("c_nationkey").agg(F.count_if("o").alias("both"), F.count_if(~F.col("o")).alias("only_customers"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i)
    SELECT vec_id, round(sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 5) AS cosine FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY vec_id""")
def centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    """L-04, F-20: cosine of each vector with the centroid of its class."""
    e = table(spark, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))
    return e.join(c, "label").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("centroid")), 5).alias("cosine"))


@query("SELECT label, count(*) AS n, round(sqrt(avg(d2)), 5) AS radius FROM (SELECT vec_id, label, sum(pow(v - m, 2)) AS d2 FROM (SELECT vec_id, label, v, avg(v) OVER (PARTITION BY label, i) AS m FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY vec_id, label) GROUP BY label HAVING count(*) >= 3")
def radius_of_gyration(spark: SparkSession, d: str) -> DataFrame:
    """A-32: the root mean square distance of points from their centroid, null groups under three points left out."""
    x = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    d2 = x.join(m, ["label", "i"]).groupBy("vec_id", "label").agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("d2"))
    return d2.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg("d2")), 5).alias("radius")).where("n >= 3")
