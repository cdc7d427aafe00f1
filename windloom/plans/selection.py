"""Queries on resampling, exact packing, component ids, peaks, isotonic curves and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators import graph, isotonic, neighbours, peaks, resample, split
from windloom.plans.views import TURNS, outcomes, table, turns

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


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """M-08: intervals of AUC, average precision and rank correlation with activity, 200 replicates over all rows; no SQL, the tests hold each replicate against direct weighted metrics."""
    return resample.intervals(outcomes(spark, d), ["id"], "score", "label", "activity", 200)


_FOLD_WEIGHTS = "(SELECT 'c' || o_custkey AS component, count(DISTINCT l_partkey) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)"


@query(f"""WITH RECURSIVE ordered AS MATERIALIZED (SELECT component, weight, row_number() OVER (ORDER BY weight DESC, sha256('0:' || component)) AS rn FROM {_FOLD_WEIGHTS}),
    ties AS MATERIALIZED (SELECT list(tie ORDER BY f) AS t FROM (SELECT f, row_number() OVER (ORDER BY sha256('0:fold:' || f)) AS tie FROM range(5) r(f))),
    step(rn, component, fold, loads) AS (
        SELECT 0::BIGINT, NULL::VARCHAR, NULL::INT, [0, 0, 0, 0, 0]::HUGEINT[]
        UNION ALL
        SELECT o.rn, o.component, s.f::INT, list_transform(range(0, 5), lambda i: (s.loads[i + 1] + CASE WHEN i = s.f THEN o.weight ELSE 0 END)::HUGEINT)
        FROM (SELECT rn, loads, list_sort(list_transform(range(0, 5), lambda i: {{'l': loads[i + 1], 't': t[i + 1], 'f': i}}))[1].f AS f FROM step, ties) s JOIN ordered o ON o.rn = s.rn + 1
    ) SELECT component, fold FROM step WHERE rn > 0""")
def fold_packing(spark: SparkSession, d: str) -> DataFrame:
    """G-05, A-07: customers, weighted by their distinct parts, to five folds; the SQL takes them one by one."""
    bought = table(spark, d, "orders").join(table(spark, d, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("component"), "l_partkey").distinct()
    return split.pack_folds(bought.groupBy("component").agg(F.count(F.lit(1)).alias("weight")))


_SAME = "(SELECT DISTINCT o_custkey AS c, l_partkey AS p, date_trunc('month', l_shipdate) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"""WITH RECURSIVE same AS MATERIALIZED {_SAME}, hubs AS MATERIALIZED (SELECT p, m, min(c) AS hub FROM same GROUP BY p, m),
    pairs AS MATERIALIZED (SELECT DISTINCT hub AS a, c AS b FROM same JOIN hubs USING (p, m) WHERE c <> hub AND c % 9 = hub % 9),
    links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach(node, label) AS (SELECT DISTINCT a, a FROM links UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.node WHERE reach.label < links.b),
    labelled AS (SELECT node, min(label) AS component FROM reach GROUP BY node)
    SELECT component, 'customers:' || left(sha256(string_agg(node::VARCHAR, chr(10) ORDER BY node::VARCHAR)), 16) AS component_id, count(*) AS n_members FROM labelled GROUP BY component""")
def component_ids(spark: SparkSession, d: str) -> DataFrame:
    """A-06: customers linked by a part in the same month, with the digest of each component's sorted members as its id."""
    same = table(spark, d, "orders").join(table(spark, d, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p"), F.trunc("l_shipdate", "month").alias("m")).distinct()
    hubs = same.groupBy("p", "m").agg(F.min("c").alias("hub"))
    pairs = same.join(hubs.hint("merge"), ["p", "m"]).where("c <> hub and c % 9 = hub % 9").select(F.col("hub").alias("a"), F.col("c").alias("b"))
    found = graph.connected_components(pairs)
    return graph.component_digests(found, "component", "id", "customers:")


_SUPPLIED = "(SELECT l_suppkey AS parent, (l_partkey % 4000)::BIGINT AS start, max(l_extendedprice) AS risk FROM lineitem GROUP BY ALL)"


@query(f"""WITH RECURSIVE w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY risk DESC, start) AS rn FROM {_SUPPLIED}),
    step(parent, rn, taken) AS (SELECT DISTINCT parent, 0::BIGINT, []::BIGINT[] FROM w UNION ALL SELECT w.parent, w.rn, CASE WHEN len(list_filter(step.taken, lambda s: s < w.start + 9 AND w.start < s + 9)) > 0 THEN step.taken ELSE list_append(step.taken, w.start) END FROM step JOIN w ON w.parent = step.parent AND w.rn = step.rn + 1 WHERE len(step.taken) < 25)
    SELECT parent, start, "end", round(risk, 6) AS risk, rank FROM (SELECT parent, unnest(taken) AS start, generate_subscripts(taken, 1)::INT AS rank, unnest(taken) + 9 AS "end" FROM (SELECT parent, arg_max(taken, rn) AS taken FROM step GROUP BY parent)) JOIN w USING (parent, start)""")
def spaced_windows(spark: SparkSession, d: str) -> DataFrame:
    """O-03: the best disjoint windows of each supplier, at most 25, by rounds of local decisions; the SQL takes windows one by one."""
    w = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("parent"), (F.col("l_partkey") % 4000).cast("long").alias("start")).agg(F.max("l_extendedprice").alias("risk"))
    return peaks.non_maximum(w, "parent", "start", "risk").withColumn("risk", r6("risk"))


_HEAT = f"(SELECT parent, i AS pos, ((ascii(substr(sequence, i + 1, 1)) * 37 + i * 101) % 1000) / 1000.0::DOUBLE AS heat FROM {TURNS}, unnest(range(0, length(sequence))) t(i))"


@query(f"""WITH RECURSIVE h AS MATERIALIZED {_HEAT},
    step(parent, k, picked) AS (
        SELECT DISTINCT parent, 0, []::BIGINT[] FROM h
        UNION ALL SELECT s.parent, s.k + 1, list_append(s.picked, arg_max(h.pos, (h.heat, -h.pos))) FROM step s JOIN h ON h.parent = s.parent WHERE s.k < 5 AND len(list_filter(s.picked, lambda p: abs(p - h.pos) < 8)) = 0 GROUP BY s.parent, s.k, s.picked
    ), best AS (SELECT parent, unnest(arg_max(picked, k)) AS pos FROM step GROUP BY parent)
    SELECT parent, pos + 1 AS position, substr(sequence, pos + 1, 1) AS residue, round(heat, 4) AS score, substr(sequence, greatest(0, pos - 7) + 1, pos + 8 - greatest(0, pos - 7)) AS context FROM best JOIN h USING (parent, pos) JOIN {TURNS} USING (parent)""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    """O-04: the five highest peaks of each turn's track, at least 8 apart, with seven letters on each side."""
    s = turns(spark, d)
    each = s.where("sequence <> ''").select("parent", F.posexplode(F.split("sequence", "")).alias("pos", "r"))
    heat = each.select("parent", "pos", ((F.ascii("r") * 37 + F.col("pos") * 101) % 1000 / 1000.0).alias("heat"))
    return peaks.hotspots(heat, s, "parent", "pos", "heat", "sequence")


_PRICES = "(SELECT l_suppkey AS g, l_quantity::DOUBLE AS x, avg(l_extendedprice * (1 - l_discount)) AS y, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL)"
#: The least of the means up to each later point, and of these the largest over each earlier one.
_FITTED = f"""(WITH p AS (SELECT g, x, row_number() OVER o AS i, sum(y * w) OVER o AS sy, sum(w) OVER o AS sw, y * w AS yw, w FROM {_PRICES} WINDOW o AS (PARTITION BY g ORDER BY x)),
    m AS (SELECT a.g, a.i AS a, b.i AS i, b.x, min((b.sy - a.sy + a.yw) / (b.sw - a.sw + a.w)) OVER (PARTITION BY a.g, a.i ORDER BY b.i DESC) AS m FROM p a JOIN p b ON a.g = b.g AND a.i <= b.i)
    SELECT g, x, max(m) AS y FROM m GROUP BY g, x)"""


@query(f"""SELECT g, x, round(y, 4) AS y FROM (SELECT *, lag(y) OVER o AS before, lead(y) OVER o AS after FROM {_FITTED} WINDOW o AS (PARTITION BY g ORDER BY x)) WHERE before IS NULL OR after IS NULL OR abs(y - before) > 1e-7 OR abs(after - y) > 1e-7""")
def isotonic_knots(spark: SparkSession, d: str) -> DataFrame:
    """L-06: knots of the isotonic fit of net price on quantity for every supplier, in one plan; the SQL takes largest least means."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    return isotonic.knots(li, "g", "x", "y").withColumn("y", F.round("y", 4))


@query(f"""WITH f AS MATERIALIZED {_FITTED}, q AS (SELECT l_orderkey, l_linenumber, l_suppkey AS g, l_quantity + l_tax * 20 - 0.7 AS x FROM lineitem),
    below AS (SELECT q.*, f.x AS x0, f.y AS y0 FROM q ASOF LEFT JOIN f ON f.g = q.g AND f.x <= q.x), near AS (SELECT below.*, f.x AS x1, f.y AS y1 FROM below ASOF LEFT JOIN f ON f.g = below.g AND f.x >= below.x)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 4) AS y FROM near""")
def calibrated_curves(spark: SparkSession, d: str) -> DataFrame:
    """F-17: each line item on its supplier's fitted curve."""
    li = table(spark, d, "lineitem")
    curves = isotonic.knots(li.select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y")), "g", "x", "y")
    asked = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("g"), (F.col("l_quantity") + F.col("l_tax") * 20 - 0.7).alias("x"))
    return isotonic.interpolate(asked, curves, "g", "x", "y", "value").select("l_orderkey", "l_linenumber", F.round("value", 4).alias("y"))


_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings)"
_NEAREST = f"(SELECT vec_id, label, avg(d) AS distance FROM (SELECT a.vec_id, a.label, 1 - list_dot_product(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.v, b.v)) AS k FROM {_UNIT} a JOIN {_UNIT} b ON a.vec_id <> b.vec_id AND b.label < 3) WHERE k <= 10 GROUP BY ALL)"


@query(f"SELECT round(n, 5) AS near_distance, round(f, 5) AS far_distance, round(f / n, 4) AS ratio FROM (SELECT avg(distance) FILTER (WHERE label = 0) AS n, avg(distance) FILTER (WHERE label = 5) AS f FROM {_NEAREST})")
def ood_gap(spark: SparkSession, d: str) -> DataFrame:
    """M-14, L-05: mean neighbour distance of two labels to the vectors of the labels under 3, and their ratio."""
    e = table(spark, d, "embeddings")
    t = neighbours.cohort_gap(e.withColumn("label", F.col("label").cast("string")), e.where("label < 3"), "vec_id", "embedding", "label", "0", "5")
    return t.select(F.round("near_distance", 5).alias("near_distance"), F.round("far_distance", 5).alias("far_distance"), F.round("ratio", 4).alias("ratio"))


@query(f"SELECT vec_id, round((SELECT count(*) FROM {_NEAREST} b WHERE b.label < 3 AND round(b.distance, 9) >= round(q.distance, 9))::DOUBLE / (SELECT count(*) FROM {_NEAREST} WHERE label < 3), 6) AS familiarity FROM {_NEAREST} q")
def familiarity(spark: SparkSession, d: str) -> DataFrame:
    """O-11, L-05: the share of the reference's own distances that are at least as large as each vector's."""
    e = table(spark, d, "embeddings")
    each = neighbours.knn_distance(e, e.where("label < 3"), "vec_id", "embedding").withColumn("distance", F.round("distance", 9))
    base = each.join(e.where("label < 3").select("vec_id").hint("merge"), "vec_id", "left_semi")
    return neighbours.familiarity(each, base).select("vec_id", r6("familiarity").alias("familiarity"))
