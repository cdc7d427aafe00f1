"""Queries on whole definitions: profiles, confidence, operating points, affinity, fusion, risk factors, tracks, reviews, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.operators import metrics, rank, rollup, sets, structure
from windloom.plans.views import ITEMS, SCORED_WINDOWS, SEQUENCES, TURNS, items, scored_windows, sequences, table, turns
from windloom.session import landed

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
c = F.col

# ---- scores ----------------------------------------------------------------------------------

_SCORED = """(SELECT l_orderkey, l_linenumber, (l_extendedprice % 1000) / 1000 AS el, l_quantity / 50.0::DOUBLE AS ba, CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END AS affinity, l_tax,
    least(1, l_tax * 12.5) AS n_cut, least(1, l_discount * 10) AS c_cut, substr('ACDEFGHIK', 1, l_linenumber) AS n_flank, CASE WHEN l_returnflag <> 'R' THEN substr('LMNP', 1, (l_partkey % 5)::INT) END AS c_flank FROM lineitem)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_tax", (c("l_extendedprice") % 1000 / 1000).alias("el"), (c("l_quantity") / 50.0).alias("ba"), F.when(c("l_linenumber") != 3, c("l_discount") * 10).alias("affinity"),
        F.least(F.lit(1.0), c("l_tax") * 12.5).alias("n_cut"), F.least(F.lit(1.0), c("l_discount") * 10).alias("c_cut"),
        F.left(F.lit("ACDEFGHIK"), c("l_linenumber")).alias("n_flank"), F.when(c("l_returnflag") != "R", F.left(F.lit("LMNP"), (c("l_partkey") % 5).cast("int"))).alias("c_flank"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, round(rank, 5) AS el_rank, round(exp((1 - ba) * ln(101)) - 1, 5) AS ba_rank, kind AS binder_class, CASE kind WHEN 'strong' THEN 'high' WHEN 'weak' THEN 'moderate' ELSE 'low' END AS risk_band, el >= 0.7892 AS flagged, round(pow(50000, 1 - affinity), 3) AS ic50
    FROM (SELECT *, CASE WHEN rank <= 0.5 OR abs(rank - 0.5) <= 1e-8 + 1e-5 * 0.5 THEN 'strong' WHEN rank <= 2 OR abs(rank - 2) <= 1e-8 + 1e-5 * 2 THEN 'weak' ELSE 'nonbinder' END AS kind FROM (SELECT *, exp((1 - el) * ln(101)) - 1 AS rank FROM {_SCORED}))""")
def profiles(spark: SparkSession, d: str) -> DataFrame:
    """F-06: the whole profile of each row."""
    p = _scored(spark, d).withColumn("x", C.profile(c("el"), c("ba"), c("affinity")))
    return p.select("l_orderkey", "l_linenumber", F.round("x.el_rank", 5).alias("el_rank"), F.round("x.ba_rank", 5).alias("ba_rank"), "x.binder_class", "x.risk_band", "x.flagged", F.round("x.ic50", 3).alias("ic50"))


@query(f"""SELECT l_orderkey, l_linenumber, round(tap, 6) AS tap, round(mhc, 6) AS mhc, round(context, 6) AS context, round(agreement, 6) AS agreement, round(exp((ln(greatest(tap, 1e-6)) + ln(greatest(mhc, 1e-6)) + ln(greatest(context, 1e-6)) + ln(greatest(agreement, 1e-6))) / 4), 6) AS confidence
    FROM (SELECT l_orderkey, l_linenumber, 1 / (1 + l_tax) AS tap, least(1, greatest(0, 2 * abs(el - 0.5))) AS mhc, 0.5 * (least(length(n_flank), 4) / 4.0::DOUBLE + least(length(coalesce(c_flank, '')), 4) / 4.0::DOUBLE) AS context,
        least(1, greatest(0, 1 - list_stddev_pop([n_cut, c_cut, el]) / list_stddev_pop([0.0::DOUBLE, 0, 1]))) AS agreement FROM {_SCORED})""")
def window_confidence(spark: SparkSession, d: str) -> DataFrame:
    """F-10: all four parts and their geometric mean."""
    w = _scored(spark, d).withColumn("x", C.window_confidence(c("l_tax"), c("el"), c("n_cut"), c("c_cut"), c("n_flank"), c("c_flank")))
    return w.select("l_orderkey", "l_linenumber", *[r6(f"x.{k}").alias(k) for k in ("tap", "mhc", "context", "agreement", "confidence")])


_WEIGHTS = {"response": 0.45, "el": 0.25, "ba": 0.15, "cleavage": 0.1, "tolerance": 0.05}
_COMPONENTS = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_discount END AS response, CASE WHEN l_partkey % 11 > 0 THEN l_tax END AS el, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity / 50.0::DOUBLE END AS ba, CASE WHEN l_returnflag <> 'R' THEN l_discount * 2 END AS cleavage, CASE WHEN l_linestatus <> 'O' THEN l_tax * 3 END AS tolerance FROM lineitem)"


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN ok THEN total / weight END, 6) AS score, array_to_string(list_filter([CASE WHEN el IS NULL THEN 'el' END, CASE WHEN response IS NULL THEN 'response' END], lambda x: x IS NOT NULL), ',') AS missing, round(weight, 6) AS available_weight,
    round(CASE WHEN ok THEN 0.1 * cleavage / weight END, 6) AS cleavage_part, round(CASE WHEN ok AND ba IS NOT NULL THEN 0.15 / weight END, 6) AS ba_weight, CASE WHEN ok THEN 2 + (ba IS NOT NULL)::INT + (cleavage IS NOT NULL)::INT + (tolerance IS NOT NULL)::INT ELSE 0 END AS n_parts,
    round(CASE WHEN ok THEN response END, 6) AS response_only, round(CASE WHEN ok THEN (0.45 * response + 0.25 * el) / 0.7 END, 6) AS with_el, round(CASE WHEN ok THEN (0.45 * response + 0.25 * el + 0.15 * ba) / 0.85 END, 6) AS with_el_ba
    FROM (SELECT *, response IS NOT NULL AND el IS NOT NULL AS ok, coalesce(0.45 * response, 0) + coalesce(0.25 * el, 0) + coalesce(0.15 * ba, 0) + coalesce(0.1 * cleavage, 0) + coalesce(0.05 * tolerance, 0) AS total,
        0.45::DOUBLE * (response IS NOT NULL)::INT + 0.25::DOUBLE * (el IS NOT NULL)::INT + 0.15::DOUBLE * (ba IS NOT NULL)::INT + 0.1::DOUBLE * (cleavage IS NOT NULL)::INT + 0.05::DOUBLE * (tolerance IS NOT NULL)::INT AS weight FROM {_COMPONENTS})""")
def fusion_detail(spark: SparkSession, d: str) -> DataFrame:
    """F-22: score, missing parts, contributions and ablations."""
    li = table(spark, d, "lineitem")
    parts = {
        "response": F.when(c("l_linenumber") != 2, c("l_discount")),
        "el": F.when(c("l_partkey") % 11 > 0, c("l_tax")),
        "ba": F.when(c("l_suppkey") % 3 > 0, c("l_quantity") / 50.0),
        "cleavage": F.when(c("l_returnflag") != "R", c("l_discount") * 2),
        "tolerance": F.when(c("l_linestatus") != "O", c("l_tax") * 3),
    }
    x = li.withColumn("x", C.fuse_detail(parts, _WEIGHTS, ["response", "el"], {"response_only": ["response"], "with_el": ["response", "el"], "with_el_ba": ["response", "el", "ba"]}))
    part = lambda k, f: F.try_element_at(c("x.contributions"), F.lit(k))[f]
    return x.select(
        "l_orderkey", "l_linenumber", r6("x.score").alias("score"), F.array_join("x.missing", ",").alias("missing"), r6("x.available_weight").alias("available_weight"), r6(part("cleavage", "contribution")).alias("cleavage_part"),
        r6(part("ba", "normalized_weight")).alias("ba_weight"), F.size("x.contributions").alias("n_parts"), *[r6(F.try_element_at(c("x.ablations"), F.lit(k))).alias(k) for k in ("response_only", "with_el", "with_el_ba")],
    )


@query("""WITH m AS (SELECT l_orderkey, 'p' || (l_partkey % 60) AS peptide, l_tax * 100 <= 2 AS binder, l_linenumber AS pos FROM lineitem), t AS (SELECT l_orderkey, 'p' || (l_partkey % 60) AS peptide, CASE WHEN l_returnflag = 'R' THEN 'foreign_like' ELSE 'self' END AS status, l_linenumber AS pos FROM lineitem),
    f AS (SELECT l_orderkey, round(avg(l_discount) * 8, 9) AS rsa, round(avg(l_quantity) / 4, 9) AS dg, round(avg(l_tax) * 12.5, 9) AS disorder FROM lineitem GROUP BY 1),
    s AS (SELECT l_orderkey, least(40, 8 * count(*)) AS binders FROM m WHERE binder GROUP BY 1), n AS (SELECT l_orderkey, least(30, 3 * count(*)) AS foreign_points FROM t WHERE status = 'foreign_like' GROUP BY 1),
    own AS (SELECT l_orderkey, peptide, min(pos) AS own FROM t WHERE status = 'foreign_like' GROUP BY ALL), hit AS (SELECT l_orderkey, peptide, min(pos) AS hit FROM m WHERE binder GROUP BY ALL),
    g AS (SELECT l_orderkey, string_agg(peptide, ',' ORDER BY hit IS NULL, coalesce(hit, own), peptide) AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY hit IS NULL, coalesce(hit, own), peptide) AS k FROM own LEFT JOIN hit USING (l_orderkey, peptide)) WHERE k <= 3 GROUP BY 1)
    SELECT l_orderkey, binders, foreign_points, hyperstable, disorder_points, score, CASE WHEN score >= 55 THEN 'high' WHEN score >= 30 THEN 'moderate' ELSE 'low' END AS band, flagged
    FROM (SELECT *, least(100, binders + foreign_points + hyperstable + disorder_points) AS score FROM (SELECT l_orderkey, coalesce(binders, 0)::INT AS binders, coalesce(foreign_points, 0)::INT AS foreign_points, CASE WHEN rsa < 0.35 AND dg > 6 THEN 15 ELSE 0 END AS hyperstable, CASE WHEN disorder > 0.5 THEN 10 ELSE 0 END AS disorder_points, coalesce(flagged, '') AS flagged FROM f LEFT JOIN s USING (l_orderkey) LEFT JOIN n USING (l_orderkey) LEFT JOIN g USING (l_orderkey)))""")
def factor_risk(spark: SparkSession, d: str) -> DataFrame:
    """F-26: all factors, the band and the flagged peptides (the first three here); means are taken to nine digits, as many of them lie on a cutoff."""
    li = table(spark, d, "lineitem")
    peptide = F.concat(F.lit("p"), (c("l_partkey") % 60).cast("string"))
    hits = li.select("l_orderkey", peptide.alias("peptide"), (c("l_tax") * 100 <= 2).alias("binder"), c("l_linenumber").alias("pos"))
    tolerance = li.select("l_orderkey", peptide.alias("peptide"), F.when(c("l_returnflag") == "R", "foreign_like").otherwise("self").alias("status"), c("l_linenumber").alias("pos"))
    features = li.groupBy("l_orderkey").agg(F.round(F.avg("l_discount") * 8, 9).alias("mean_rsa"), F.round(F.avg("l_quantity") / 4, 9).alias("unfolding"), F.round(F.avg("l_tax") * 12.5, 9).alias("disordered"))
    t = rollup.factor_risk(features, hits, tolerance, "l_orderkey", 3)
    return t.select("l_orderkey", c("binders").cast("int").alias("binders"), c("foreign").cast("int").alias("foreign_points"), "hyperstable", c("disorder").alias("disorder_points"), c("score").cast("int").alias("score"), "band", F.array_join("flagged", ",").alias("flagged"))


# ---- metrics ---------------------------------------------------------------------------------

_POINTS = "(SELECT l_orderkey * 10 + l_linenumber AS id, (l_extendedprice % 1000) / 1000 AS p, (l_extendedprice % 1000) % 7 + 5 * (1000 - l_extendedprice % 1000) / 1000 AS rank FROM lineitem)"


@query(f"""WITH r AS (SELECT *, (rank <= 0.5)::INT AS pos, row_number() OVER (ORDER BY p DESC, id) AS flagged, sum((rank <= 0.5)::INT) OVER (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS tp, sum((rank <= 0.5)::INT) OVER () AS total, exp((1 - p) * ln(101)) - 1 <= 0.5 AS chosen FROM {_POINTS}),
    d AS (SELECT count(*) FILTER (WHERE chosen) AS n, count(*) FILTER (WHERE chosen AND pos = 1) AS tp, max(total) AS total FROM r)
    SELECT target::DOUBLE AS target, round(arg_min(p, r.flagged), 6) AS threshold, round(exp((1 - arg_min(p, r.flagged)) * ln(101)) - 1, 6) AS implied_rank, round(arg_min(r.tp / r.total::DOUBLE, r.flagged), 6) AS recall, round(arg_min(r.tp / r.flagged::DOUBLE, r.flagged), 6) AS precision, min(r.flagged) AS n_flagged,
        max(d.n) AS default_flagged, round(max(d.tp / d.total::DOUBLE), 6) AS default_recall, round(max(d.tp / greatest(1, d.n)::DOUBLE), 6) AS default_precision FROM r, d, (VALUES (0.8), (0.9), (0.95), (0.99)) t(target) WHERE r.tp / r.total::DOUBLE >= target GROUP BY target""")
def operating_points(spark: SparkSession, d: str) -> DataFrame:
    """M-09: recall-driven cutoffs with their implied rank, beside the default rule."""
    li, price = table(spark, d, "lineitem"), c("l_extendedprice") % 1000
    rows = li.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (price / 1000).alias("p"), (price % 7 + 5 * (1000 - price) / 1000).alias("rank"))
    t = metrics.operating_points(rows, "id", "p", "rank")
    return t.select("target", "n_flagged", "default_flagged", *[r6(x).alias(x) for x in ("threshold", "implied_rank", "recall", "precision", "default_recall", "default_precision")])


_AFFINE = "(SELECT l_linenumber AS grp, l_discount * 10 AS p, least(1, greatest(0, l_discount * 7 + l_tax * 3)) AS a FROM lineitem)"


@query(f"""WITH x AS (SELECT *, pow(50000, 1 - a) AS ic, exp(abs(ln(pow(50000, 1 - p)) - ln(pow(50000, 1 - a)))) AS fold, pow(50000, 1 - a) <= 500 AS binder FROM {_AFFINE}),
    r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY grp ORDER BY -ic) + (count(*) OVER (PARTITION BY grp, ic) - 1) / 2.0::DOUBLE AS ra FROM x),
    ap AS (SELECT grp, sum(pos * tp::DOUBLE / flagged) / sum(pos) AS ap FROM (SELECT grp, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged FROM (SELECT grp, p, sum(binder::INT) AS pos, count(*) AS n FROM x GROUP BY ALL) WINDOW w AS (PARTITION BY grp ORDER BY p DESC)) GROUP BY grp)
    SELECT x.grp, count(*) AS n_rows, round(avg(abs(p - a)), 6) AS score_mae, round(avg(binder::INT), 6) AS prevalence, round(avg((fold <= 2)::INT), 6) AS within_2x, round(avg((fold <= 5)::INT), 6) AS within_5x, round(any_value(s.rho), 5) AS spearman, round(median(fold), 5) AS median_fold, round(median(fold) FILTER (WHERE binder), 5) AS median_fold_binders,
        round(CASE WHEN avg(binder::INT) BETWEEN 1e-12 AND 1 - 1e-12 THEN any_value(ap.ap) END, 6) AS auprc FROM x JOIN (SELECT grp, corr(rp, ra) AS rho FROM r GROUP BY grp) s ON s.grp = x.grp JOIN ap ON ap.grp = x.grp GROUP BY x.grp""")
def affinity_block(spark: SparkSession, d: str) -> DataFrame:
    """M-10, M-13: how well affinities are recovered, by group."""
    li = table(spark, d, "lineitem")
    rows = li.select(c("l_linenumber").alias("grp"), (c("l_discount") * 10).alias("p"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("l_discount") * 7 + c("l_tax") * 3)).alias("a"))
    t = metrics.affinity_block(rows, "p", "a", ["grp"])
    return t.select("grp", "n_rows", *[r6(x).alias(x) for x in ("score_mae", "prevalence", "within_2x", "within_5x", "auprc")], *[F.round(x, 5).alias(x) for x in ("spearman", "median_fold", "median_fold_binders")])


# ---- tracks ----------------------------------------------------------------------------------

_SPINE = f"w AS MATERIALIZED {SCORED_WINDOWS}, l AS (SELECT parent, max(\"end\") + 2 AS length FROM w GROUP BY parent), spine AS (SELECT parent, p::INT AS pos FROM l, unnest(range(0, length)) t(p))"


def _lengths(w: DataFrame) -> DataFrame:
    return w.groupBy("parent").agg((F.max("end") + 2).alias("length"))


@query(f"""WITH {_SPINE} SELECT s.parent, s.pos, round(coalesce(arg_max(confidence, (risk, -w.start)), 0), 6) AS confidence, round(coalesce(max(risk), 0), 6) AS max_value FROM spine s LEFT JOIN w ON w.parent = s.parent AND s.pos >= w.start AND s.pos < w."end" GROUP BY s.parent, s.pos""")
def residue_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A-25: the confidence of the first of the highest windows over each residue."""
    w = scored_windows(spark, d)
    return rollup.residue_track(w, _lengths(w), confidence="confidence").select("parent", "pos", r6("confidence").alias("confidence"), r6("max_value").alias("max_value"))


@query(f"""WITH {_SPINE} SELECT s.parent, s.pos, round(coalesce(max(risk), 0), 6) AS risk_max, round(coalesce(avg(confidence), 0), 6) AS presentation_mean, round(coalesce(avg(CASE WHEN w.start % 2 = 0 THEN risk * confidence END), 0), 6) AS binding_mean FROM spine s LEFT JOIN w ON w.parent = s.parent AND s.pos >= w.start AND s.pos < w."end" GROUP BY s.parent, s.pos""")
def surrogate_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A-28: highest risk, mean presentation and mean binding by residue."""
    w = scored_windows(spark, d).withColumn("binding", F.when(c("start") % 2 == 0, c("risk") * c("confidence")))
    t = rollup.surrogate_tracks(w, _lengths(w), "parent", "risk", "confidence", "binding")
    return t.select("parent", "pos", *[r6(x).alias(x) for x in ("risk_max", "presentation_mean", "binding_mean")])


@query(f"""WITH {_SPINE}, cells AS (SELECT parent, start + i AS pos, ((start * 7 + i * 3) % 10 - 4) / 10.0::DOUBLE * risk AS x FROM w, unnest(range(0, 9)) t(i)),
    track AS (SELECT s.parent, s.pos, coalesce(avg(x), 0) AS heat FROM spine s LEFT JOIN cells k ON k.parent = s.parent AND k.pos = s.pos GROUP BY s.parent, s.pos)
    SELECT parent, pos, round(CASE WHEN max(heat) OVER p > 0 THEN heat / max(heat) OVER p ELSE heat END, 9) + 0.0 AS heat, round(CASE WHEN max(abs(heat)) OVER p > 0 THEN heat / max(abs(heat)) OVER p ELSE heat END, 9) + 0.0 AS saliency FROM track WINDOW p AS (PARTITION BY parent)""")
def profile_heat(spark: SparkSession, d: str) -> DataFrame:
    """A-27: windows' profiles, weighted by risk, averaged by residue and divided by the largest value, and by the largest absolute one."""
    w = scored_windows(spark, d).withColumn("profile", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: ((c("start") * 7 + i * 3) % 10 - 4) / 10.0))
    heat = rollup.profile_tracks(w, _lengths(w), "parent", "start", "profile", c("risk"))
    return heat.select("parent", "pos", (F.round("heat", 9) + 0.0).alias("heat"), (F.round("saliency", 9) + 0.0).alias("saliency"))


# ---- structures, segments, sets --------------------------------------------------------------

_CHAINED = f"(SELECT parent, sequence, k AS chain, CASE k WHEN 0 THEN reverse(sequence) WHEN 1 THEN substr(sequence, 3, length(sequence) - 4) WHEN 2 THEN left(sequence, length(sequence) - 2) WHEN 3 THEN right(sequence, length(sequence) - 2) ELSE '' END AS s FROM {TURNS}, unnest(range(0, 5)) t(k) WHERE length(sequence) > 6)"


@query(f"""SELECT parent, chain, (CASE WHEN instr(sequence, s) > 0 THEN instr(sequence, s) - 1 ELSE 1 - instr(s, sequence) END)::INT AS "offset" FROM {_CHAINED} WHERE s <> '' AND (instr(sequence, s) > 0 OR instr(s, sequence) > 0) QUALIFY row_number() OVER (PARTITION BY parent ORDER BY length(s) DESC, chain) = 1""")
def best_chains(spark: SparkSession, d: str) -> DataFrame:
    """J-16: the longest of each design's chains that matches it, the first of equal ones."""
    designs = turns(spark, d).where("char_length(sequence) > 6").withColumn("pdb", c("parent"))
    s, n = c("sequence"), F.char_length("sequence")
    forms = F.array(F.reverse(s), F.substr(s, F.lit(3), n - 4), F.left(s, n - 2), F.right(s, n - 2), F.lit(""))
    chains = designs.select("pdb", F.posexplode(forms).alias("chain", "chain_sequence"))
    return structure.best_chains(landed(chains, "chains"), designs).select("parent", c("chain").cast("long").alias("chain"), "offset")


_HYDROPHOBIC_RUNS = f"(SELECT parent, min(i)::INT AS lo, max(i)::INT AS hi FROM (SELECT parent, i, i - row_number() OVER (PARTITION BY parent ORDER BY i) AS g FROM {TURNS}, unnest(range(0, length(sequence))) t(i) WHERE contains('AILMFVWY', substr(sequence, i + 1, 1))) GROUP BY parent, g)"


@query(f"""SELECT parent, lo, hi, covered::BIGINT AS covered FROM (SELECT r.parent, lo, hi, count(h.pos) AS covered FROM {_HYDROPHOBIC_RUNS} r LEFT JOIN (SELECT parent, i AS pos FROM {TURNS}, unnest(range(0, length(sequence))) t(i) WHERE substr(sequence, i + 1, 1) = 'W') h ON h.parent = r.parent AND h.pos BETWEEN lo AND hi GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY parent ORDER BY covered DESC, hi - lo DESC, lo) = 1""")
def chosen_segment(spark: SparkSession, d: str) -> DataFrame:
    """O-07: of each turn's hydrophobic runs that with most hotspots (here W), then the longest, then the first."""
    p = turns(spark, d).where("sequence <> ''").select("parent", F.posexplode(F.split("sequence", "")).alias("pos", "r"))
    return rank.covering_segment(p.where(c("r").isin(*"AILMFVWY")).select("parent", "pos"), p.where("r = 'W'").select("parent", "pos"), "parent", "pos")


@query("""SELECT c_custkey, list_sort(list_distinct(list(p) FILTER (WHERE p IS NOT NULL)))::VARCHAR AS shared, count(DISTINCT p) AS n FROM customer LEFT JOIN (SELECT DISTINCT a.k, a.p FROM (SELECT o_custkey AS k, 'part-' || l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') a JOIN (SELECT o_custkey AS k, 'part-' || l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R') b USING (k, p)) ON k = c_custkey
    WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_custkey""".replace("list_sort(list_distinct(list(p) FILTER (WHERE p IS NOT NULL)))::VARCHAR", "coalesce(array_to_string(list_sort(list_distinct(list(p) FILTER (WHERE p IS NOT NULL))), ','), '')"))
def shared_sets(spark: SparkSession, d: str) -> DataFrame:
    """U-03, J-11: parts that each customer with an order returned and also kept, by bitmaps of numbered parts."""
    bought = table(spark, d, "orders").join(table(spark, d, "lineitem").hint("merge"), c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("c_custkey"), F.concat(F.lit("part-"), c("l_partkey").cast("string")).alias("p"), "l_returnflag")
    t = sets.shared_names(bought.where("l_returnflag = 'R'"), bought.where("l_returnflag <> 'R'"), "c_custkey", "p")
    buyers = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(c("o_custkey").alias("c_custkey")).hint("merge"), "c_custkey", "left_semi").distinct()
    shared = F.coalesce("shared", F.array().cast("array<string>"))
    return buyers.join(t.hint("merge"), "c_custkey", "left").select("c_custkey", F.array_join(shared, ",").alias("shared"), F.size(shared).cast("long").alias("n"))


@query("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT year(l_shipdate)) = (SELECT count(DISTINCT year(l_shipdate)) FROM lineitem)")
def common_to_all(spark: SparkSession, d: str) -> DataFrame:
    """U-03: suppliers that every year has."""
    return sets.common_to_all(table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate")), "year", "l_suppkey")


@query(f"SELECT DISTINCT substr(sequence, i + 1, 9) AS peptide FROM (SELECT sequence FROM {TURNS} UNION ALL SELECT sequence FROM {ITEMS}), unnest(range(0, length(sequence) - 8)) t(i)")
def window_union(spark: SparkSession, d: str) -> DataFrame:
    """U-02: the windows that turns or reference items have, each once."""
    from windloom.operators import tile

    one, other = (tile.with_flanks(t(spark, d), flank=0).select("peptide") for t in (turns, items))
    return sets.distinct_union(one, other)


_GATE = "(SELECT o_orderkey, list_distinct(['a' || o_orderkey % 5, 'a' || o_orderkey % 7]) AS q, CASE WHEN o_orderkey % 3 > 0 THEN ['a' || o_custkey % 5, 'a' || o_custkey % 4, 'a0'] END AS own, o_orderpriority = '1-URGENT' AS none FROM orders)"


@query(f"SELECT o_orderkey, 'shared' AS gate, array_to_string(list_sort(list_distinct(list_intersect(CASE WHEN none THEN [] ELSE q END, coalesce(own, [])))), ',') AS shared, CASE WHEN none THEN 'not_available' ELSE 'query_only' END AS gate_alone FROM {_GATE}")
def allele_gate(spark: SparkSession, d: str) -> DataFrame:
    """F-13: the gate with a shared map, of which some rows have no entry, and the gate without one."""
    o = table(spark, d, "orders")
    name = lambda k, n: F.concat(F.lit("a"), (c(k) % n).cast("string"))
    q = F.when(c("o_orderpriority") != "1-URGENT", F.array_distinct(F.array(name("o_orderkey", 5), name("o_orderkey", 7))))
    own = F.when(c("o_orderkey") % 3 > 0, F.array(name("o_custkey", 5), name("o_custkey", 4), F.lit("a0")))
    return o.withColumns({"x": C.hla_gate(True, q, own), "y": C.hla_gate(False, q)}).select("o_orderkey", "x.gate", F.array_join("x.shared", ",").alias("shared"), c("y.gate").alias("gate_alone"))


@query(f"""WITH w AS (SELECT DISTINCT parent, substr(sequence, i + 1, 9) AS peptide FROM {TURNS}, unnest(range(0, length(sequence) - 8)) t(i)), corpus AS (SELECT DISTINCT substr(sequence, i + 1, 9) AS peptide FROM {SEQUENCES}, unnest(range(0, length(sequence) - 8)) t(i)), h AS (SELECT left(sha256(sequence), 16) AS h, count(*) AS n FROM {SEQUENCES} GROUP BY 1)
    SELECT t.parent, coalesce(any_value(h.n), 0)::BIGINT AS parent_rows, count(w.peptide) AS sample_windows, count(corpus.peptide) AS overlapping FROM {TURNS} t LEFT JOIN w ON w.parent = t.parent LEFT JOIN corpus ON corpus.peptide = w.peptide LEFT JOIN h ON h.h = left(sha256(t.sequence), 16) GROUP BY t.parent""")
def overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    """J-21: for each turn the corpus rows with the same sequence hash, its distinct windows, and those that the corpus has."""
    from windloom.operators import join

    return join.overlap_audit(turns(spark, d), sequences(spark, d))
