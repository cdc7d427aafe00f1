"""Queries on sampling, holdouts, panels, scored keys, structures, providers, pooled vectors and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.functions import sequence as S
from windloom.operators import join, learn, quality, split, structure
from windloom.plans.views import TURNS, table, turns
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


r6 = lambda x: F.round(x, 6)
c = F.col


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 / (1 + exp(-(l_discount * 40 - 2))) END, 6) AS tolerance FROM lineitem")
def tolerance_scores(spark: SparkSession, d: str) -> DataFrame:
    """F-12: the sigmoid of an enrichment; what is missing or not finite gives 0."""
    e = F.when(c("l_returnflag") == "R", F.when(c("l_linenumber") > 3, F.lit(float("-inf")))).otherwise(c("l_discount") * 40 - 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(C.tolerance(e)).alias("tolerance"))


@query("SELECT l_orderkey, l_linenumber, ((l_partkey * 31 + l_suppkey) % 1000)::BIGINT AS score FROM lineitem")
def scored_keys(spark: SparkSession, d: str) -> DataFrame:
    """J-05, J-06: each distinct (part, supplier) is scored once and joined back."""
    score = lambda keys: keys.withColumn("score", (c("l_partkey") * 31 + c("l_suppkey")) % 1000)
    return join.score_distinct(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], score).select("l_orderkey", "l_linenumber", "score")


_ATOMS = "(SELECT l_partkey AS file, CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'B' END AS chain, l_linenumber AS number, l_linestatus AS residue, l_orderkey * 10 + l_linenumber AS line, l_quantity AS x, l_discount * 300 AS y, l_tax * 300 AS z FROM lineitem)"


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(c("l_partkey").alias("file"), F.when(c("l_returnflag") == "R", "A").otherwise("B").alias("chain"), c("l_linenumber").alias("number"), c("l_linestatus").alias("residue"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("line"), c("l_quantity").alias("x"), (c("l_discount") * 300).alias("y"), (c("l_tax") * 300).alias("z"), F.lit("C").alias("element"))


_PAIRED = f"(SELECT a.file, a.chain AS ca, a.number AS na, a.residue AS ra, b.chain AS cb, b.number AS nb, b.residue AS rb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM {_ATOMS} a JOIN {_ATOMS} b ON a.file = b.file AND a.chain < b.chain WHERE d <= 4.5)"


@query(f"SELECT file, chain, number, residue, count(*) AS contacts, round(min(d), 5) AS distance FROM (SELECT file, ca AS chain, na AS number, ra AS residue, d FROM {_PAIRED} UNION ALL SELECT file, cb, nb, rb, d FROM {_PAIRED}) GROUP BY ALL")
def chain_contacts(spark: SparkSession, d: str) -> DataFrame:
    """J-24, J-25: residues with atoms of the other chain within the cutoff, by grid cells."""
    return structure.contacts(_atoms(spark, d)).withColumn("distance", F.round("distance", 5))


_QUOTA = "(SELECT *, sha256('0:' || o_orderkey::VARCHAR) AS h, sha256('0t:' || o_orderkey::VARCHAR) AS t FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders))"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, o_orderkey) AS rn, count(*) OVER (PARTITION BY split) AS have FROM {_QUOTA}), q AS (SELECT *, least(have, CASE split WHEN 'train' THEN 800 ELSE 100 END) AS quota FROM r), first AS (SELECT o_orderkey, split FROM q WHERE rn <= quota),
    rest AS (SELECT o_orderkey, split, row_number() OVER (ORDER BY t, o_orderkey) AS k FROM q WHERE rn > quota) SELECT * FROM first UNION ALL SELECT o_orderkey, split FROM rest WHERE k <= 1000 - (SELECT count(*) FROM first)""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """G-10: 1,000 rows with fixed shares of the splits, topped up from the others."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "F", "train").when(c("o_orderstatus") == "O", "val").otherwise("test").alias("split"))
    return split.split_sample(o, 1000, "o_orderkey")


@query("""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('0:' || o_custkey::VARCHAR), o_custkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_orderkey, CASE WHEN rn <= greatest(1, floor(n * 0.3::DOUBLE)) THEN o_totalprice END AS label FROM orders JOIN g USING (o_custkey)""")
def hidden_labels(spark: SparkSession, d: str) -> DataFrame:
    """G-13: labels of three tenths of the groups stay."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", c("o_totalprice").alias("label"))
    return split.hide_labels(o, "o_custkey", "label", 0.3).select("o_orderkey", "label")


@query("""WITH n AS (SELECT c_mktsegment AS category, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'unknown' GROUP BY 1 HAVING count(*) >= 100), top AS (SELECT category, n FROM n ORDER BY n DESC, category LIMIT 4), r AS (SELECT c_mktsegment AS category FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT top.category AS held_out, count(*) AS n, count(*) FILTER (WHERE r.category <> top.category)::BIGINT AS source FROM top, r GROUP BY 1""")
def held_out_categories(spark: SparkSession, d: str) -> DataFrame:
    """G-14: for each of the four largest categories all its rows adapt or test and all others are source; adapting and testing rows are counted together, as their halves follow a hash."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").hint("merge"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "o_custkey", c("c_mktsegment").alias("category"))
    t = split.category_holdout(o, "category", "o_custkey", least_rows=100)
    return t.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("part") == "source").alias("source"))


@query("SELECT o_orderpriority AS panel, o_custkey AS key, count(*) AS n FROM orders JOIN (SELECT p, k FROM (SELECT DISTINCT o_orderpriority AS p, o_custkey AS k FROM orders) QUALIFY row_number() OVER (PARTITION BY p ORDER BY sha256('0:' || k::VARCHAR), k) <= 120) ON p = o_orderpriority AND k = o_custkey GROUP BY ALL")
def panels(spark: SparkSession, d: str) -> DataFrame:
    """G-15: up to 120 customers of each priority, with all their rows."""
    o = table(spark, d, "orders").select(c("o_orderpriority").alias("panel"), c("o_custkey").alias("key"))
    return split.panel_sample(o, "panel", "key").groupBy("panel", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unsupported' WHEN a.k IS NULL THEN 'unavailable' WHEN e IS NOT NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN o_orderpriority <> '1-URGENT' AND a.k IS NOT NULL AND e IS NULL THEN s END AS score,
    array_to_string(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_discount) AS s, CASE WHEN max(l_tax) >= 0.08 THEN 'high tax' END AS e FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) a ON a.k = o_orderkey""")
def provider_answers(spark: SparkSession, d: str) -> DataFrame:
    """X-07, X-08: each request's status, its score where it is ok, and the warnings that hold."""
    asked = table(spark, d, "orders")
    got = table(spark, d, "lineitem").where("l_linenumber = 2").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_discount").alias("score"), F.when(F.max("l_tax") >= 0.08, "high tax").alias("error"))
    t = quality.provider_status(asked, got, ["o_orderkey"], c("o_orderpriority") != "1-URGENT")
    return t.select("o_orderkey", "status", "score", F.array_join(quality.warnings(large=c("o_totalprice") > 200000, pending=c("o_orderstatus") == "P"), ",").alias("warnings"))


@query(f"""WITH s AS (SELECT parent, i + (parent % 3) AS pos, ascii(substr(sequence, i + 1, 1)) / 100.0::DOUBLE AS rsa FROM {TURNS}, unnest(range(0, length(sequence))) t(i) WHERE i % 4 > 0)
    SELECT t.parent, i AS pos, round(s.rsa, 6) AS rsa FROM {TURNS} t, unnest(range(0, length(sequence))) u(i) LEFT JOIN s ON s.parent = t.parent AND s.pos = i""")
def projected_residues(spark: SparkSession, d: str) -> DataFrame:
    """F-16: what was observed on a chain, in the design's coordinates; null where nothing was."""
    s = turns(spark, d).where("sequence <> ''")
    each = landed(s.select("parent", F.posexplode(F.split("sequence", "")).alias("chain_pos", "r")).where("chain_pos % 4 > 0").select("parent", "chain_pos", (F.ascii("r") / 100.0).alias("rsa")), "residues")
    t = structure.project(each, s.select("parent", (c("parent") % 3).alias("offset")), s.select("parent", F.char_length("sequence").alias("length")))
    return t.select("parent", c("pos").cast("long").alias("pos"), r6("rsa").alias("rsa"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_filter(range(0, length(p)), lambda i: contains('ACDEFGHIKLMNPQRSTVWY', substr(p, i + 1, 1))), lambda i: (i * 20 + instr('ACDEFGHIKLMNPQRSTVWY', substr(p, i + 1, 1)) - 1)::VARCHAR), ',') AS at FROM (SELECT l_orderkey, l_linenumber, substr('AWXKLMBYVACD', l_linenumber, 9) AS p FROM lineitem)")
def one_hot_indexes(spark: SparkSession, d: str) -> DataFrame:
    """F-18: the cells of a one-hot peptide that are one; other letters have none."""
    p = F.substr(F.lit("AWXKLMBYVACD"), c("l_linenumber"), F.lit(9))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(S.one_hot_indexes(p), lambda x: x.cast("string")), ",").alias("at"))


@query("SELECT vec_id, round((v[1 + a] + v[2 + a] + v[3 + a]) / 3, 5) AS first, round((v[9 + a] + v[10 + a] + v[11 + a]) / 3, 5) AS second FROM (SELECT vec_id, embedding::DOUBLE[] AS v, (vec_id % 4)::INT AS a FROM embeddings)")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """F-19: the mean of three neighbouring vectors of a row; a row's vectors here are pairs of its numbers eight apart."""
    e = table(spark, d, "embeddings").select("vec_id", (c("vec_id") % 4).cast("int").alias("a"), c("embedding").cast("array<double>").alias("v"))
    cells = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.array(F.element_at("v", i), F.element_at("v", i + 8)))
    t = e.withColumn("m", learn.pooled(cells, c("a"), c("a") + 3))
    return t.select("vec_id", F.round(c("m")[0], 5).alias("first"), F.round(c("m")[1], 5).alias("second"))


@query()
def imputed_values(spark: SparkSession, d: str) -> DataFrame:
    """L-01: missing values filled by ridge on one-hot peptides, and tagged; no SQL, the tests hold the fit against normal equations."""
    li, n = table(spark, d, "lineitem"), c("l_linenumber")
    p = F.concat(*[F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (c(x) % 20 + 1).cast("int"), F.lit(1)) for x in ("l_partkey", "l_suppkey", "l_orderkey")], F.lit("ACDEFG"))
    rows = li.select("l_orderkey", n.alias("n"), p.alias("peptide"), F.when(n != 3, c("l_discount")).alias("value"), F.lit("").alias("tags"))
    return learn.ridge_impute(rows, "peptide", "value", "tags", "ridge").select("l_orderkey", "n", "peptide", "value", "tags")
