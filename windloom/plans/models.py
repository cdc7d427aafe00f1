"""Queries on structures, vectors and incremental growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.operators import learn, neighbours, quality, structure, tile
from windloom.plans.views import TURNS, table, turns
from windloom.streaming import growing

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


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u),
    d AS (SELECT a.vec_id, 1 - list_dot_product(a.v, b.v) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id), r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d)
    SELECT vec_id, round(avg(d), 5) AS distance FROM r WHERE k <= 10 GROUP BY vec_id""")
def knn_ood(spark: SparkSession, d: str) -> DataFrame:
    """L-05: distance of each vector to its ten nearest others, in blocks against the whole reference."""
    e = table(spark, d, "embeddings")
    return neighbours.knn_distance(e, e, "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@query()
def latent_map(spark: SparkSession, d: str) -> DataFrame:
    """L-03, L-08: two components; signs are arbitrary, so the tests hold lengths and angles."""
    return learn.pca(table(spark, d, "embeddings"), "embedding", 2).select("vec_id", "projected")


@query("SELECT event_id, round(coalesce(try_cast(props->>'$.none.k' AS DOUBLE), try_cast(props->>'$.k' AS DOUBLE), try_cast(props->>'$.x' AS DOUBLE), try_cast(props->>'$.v' AS DOUBLE)), 6) AS metric FROM events")
def json_metrics(spark: SparkSession, d: str) -> DataFrame:
    """F-24: the first of several dotted paths that holds a number."""
    return table(spark, d, "events").select("event_id", r6(quality.json_metric(F.col("props"), "none.k", "k", "x", "v")).alias("metric"))


_CANDIDATES = "(SELECT p_partkey AS id, p_name AS sequence, CASE WHEN p_size % 7 > 0 THEN 70 + p_size::DOUBLE END AS plddt, (p_partkey % 13)::DOUBLE AS interface_pae, (p_partkey % 5) / 4.0::DOUBLE AS rmsd, (p_partkey % 3)::INT AS clashes FROM part)"


@query(f"""SELECT id, coalesce(plddt >= 80, FALSE)::INT + (interface_pae <= 10)::INT + (rmsd <= 1)::INT + (clashes = 0)::INT + (n = 1)::INT AS n_passed, CASE WHEN coalesce(plddt >= 80, FALSE) AND interface_pae <= 10 AND rmsd <= 1 AND clashes = 0 AND n = 1 THEN 'eligible' ELSE 'blocked' END AS selection
    FROM (SELECT *, count(*) OVER (PARTITION BY sequence) AS n FROM {_CANDIDATES})""")
def structural_gates(spark: SparkSession, d: str) -> DataFrame:
    """F-25: the gates of candidates without a perplexity."""
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence"), F.when(F.col("p_size") % 7 > 0, 70.0 + F.col("p_size")).alias("plddt"), (F.col("p_partkey") % 13).cast("double").alias("interface_pae"), (F.col("p_partkey") % 5 / 4.0).alias("rmsd"), (F.col("p_partkey") % 3).cast("int").alias("clashes"))
    g = structure.gates(c)
    return g.select("id", F.size(F.filter("checks", lambda x: x["passed"])).alias("n_passed"), "selection")


_SURFACE = ", ".join(f"('{k}', {v})" for k, v in C.MAX_SURFACE.items())


@query(f"""WITH m(r, area) AS (VALUES {_SURFACE}), res AS (SELECT parent, i AS pos, least(1.5, greatest(0, ((i * 37) % 211)::DOUBLE / area)) AS rsa FROM (SELECT parent, i, substr(sequence, i + 1, 1) AS r FROM {TURNS}, unnest(range(0, length(sequence))) t(i)) JOIN m USING (r) WHERE i % 3 > 0),
    w AS (SELECT parent, i AS start FROM {TURNS}, unnest(range(0, length(sequence) - 8)) t(i))
    SELECT w.parent, w.start::INT AS start, count(rsa) AS observed, round(CASE WHEN count(rsa) >= 5 THEN avg(rsa) END, 6) AS mean_rsa, round(CASE WHEN count(rsa) >= 5 THEN count(*) FILTER (WHERE rsa < 0.25)::DOUBLE / count(rsa) END, 6) AS buried FROM w LEFT JOIN res ON res.parent = w.parent AND pos >= w.start AND pos < w.start + 9 GROUP BY w.parent, w.start""")
def accessibility(spark: SparkSession, d: str) -> DataFrame:
    """J-15, F-15, O-06: windows of the reference set with the residues observed on them."""
    it = turns(spark, d)
    res = it.where("sequence <> ''").select("parent", F.posexplode(F.split("sequence", "")).alias("pos", "r")).where("pos % 3 > 0")
    res = res.select("parent", "pos", C.relative_accessibility(F.col("r"), (F.col("pos") * 37 % 211).cast("double")).alias("rsa"))
    w = tile.with_flanks(it, flank=0).select("parent", "start", "end")
    t = structure.window_accessibility(w, res)
    return t.select("parent", "start", "observed", r6("mean_rsa").alias("mean_rsa"), r6("buried").alias("buried"))


_CHAIN = "CASE parent % 4 WHEN 0 THEN sequence WHEN 1 THEN substr(sequence, 4, length(sequence) - 5) WHEN 2 THEN 'GS' || sequence ELSE reverse(sequence) END"


@query(f"SELECT parent, coalesce(CASE WHEN instr(sequence, c) > 0 THEN instr(sequence, c) - 1 WHEN instr(c, sequence) > 0 THEN 1 - instr(c, sequence) END, 9999)::INT AS \"offset\", CASE WHEN sequence = c THEN 'exact' WHEN instr(sequence, c) > 0 AND length(c) >= 15 AND length(c) >= 0.9 * length(sequence) AND instr(sequence, c) - 1 <= 5 AND length(sequence) - instr(sequence, c) + 1 - length(c) <= 5 THEN 'trimmed' ELSE 'rejected' END AS status FROM (SELECT *, {_CHAIN} AS c FROM {TURNS} WHERE length(sequence) > 5)")
def chain_alignment(spark: SparkSession, d: str) -> DataFrame:
    """J-16, J-26: sequences against chains derived from them."""
    s, n = F.col("sequence"), F.char_length("sequence")
    it = turns(spark, d).where(n > 5)
    chain = F.when(F.col("parent") % 4 == 0, s).when(F.col("parent") % 4 == 1, F.substr(s, F.lit(4), n - 5)).when(F.col("parent") % 4 == 2, F.concat(F.lit("GS"), s)).otherwise(F.reverse(s))
    it = it.withColumn("c", chain)
    return it.select("parent", F.coalesce(structure.chain_offset(F.col("c"), s), F.lit(9999)).alias("offset"), structure.map_sequence(s, F.col("c"))["status"].alias("status"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders), old AS (SELECT *, CASE WHEN o_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM o WHERE o_orderkey % 3 = 0), new AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old) ORDER BY sha256('1:' || o_orderkey), o_orderkey LIMIT 200),
    g AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('0:' || o_custkey), o_custkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM new WHERE o_custkey NOT IN (SELECT o_custkey FROM old))), s AS (SELECT o_custkey, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS fresh FROM g), k AS (SELECT o_custkey, min(split) AS kept FROM old GROUP BY 1)
    SELECT * FROM old UNION ALL SELECT o_orderkey, o_custkey, coalesce(kept, fresh) FROM new LEFT JOIN k USING (o_custkey) LEFT JOIN s USING (o_custkey)""")
def incremental_expand(spark: SparkSession, d: str) -> DataFrame:
    """G-17, J-09, U-01: a dataset grown by at most 200 rows that it does not have, in the split of their parent."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    old = o.where("o_orderkey % 3 = 0").withColumn("split", F.when(F.col("o_custkey") % 10 == 0, "test").otherwise("train"))
    return growing.expand(o, old, "o_orderkey", "o_custkey", 200)
