"""Metric bundles, heads, pools and checks against plain Python on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.operators import collapse, join, learn, metrics, rank, structure, tile
from windloom.plans.catalogue import QUERIES
from windloom.sources import tables


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_group_wins_leaves_out_small_and_single_class_groups(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(20) / 20, rng.randrange(20) / 20, rng.random() < 0.4) for g in range(6) for _ in range(40)]
    rows += [(7, 0.5, 0.5, True)] * 30 + [(8, 0.1, 0.2, True), (8, 0.2, 0.1, False)]
    got = metrics.group_wins(spark.createDataFrame(rows, "g int, a double, b double, y boolean"), "a", "b", "y", "g").first()
    each = [(brute_auc([(a, y) for h, a, _, y in rows if h == g]), brute_auc([(b, y) for h, _, b, y in rows if h == g])) for g in range(6)]
    assert got["n_groups"] == 6 and got["wins"] == sum(b > a for a, b in each)
    assert abs(got["base_auc"] - np.mean([a for a, _ in each])) < 1e-9 and abs(got["other_auc"] - np.mean([b for _, b in each])) < 1e-9


def test_metrics_reject_bad_inputs(spark):
    rows = [(0.1, 0.2), (float("nan"), 3.0), (0.4, 8.0)]
    df = spark.createDataFrame(rows, "s double, rank double")
    with pytest.raises(metrics.InputError):
        metrics.teacher_agreement(df, ["s"], "rank")
    with pytest.raises(metrics.InputError):
        metrics.teacher_agreement(df.where("rank > 1 and not isnan(s)"), ["s"], "rank")


def test_sums_by_group_and_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), float(rng.randrange(40)), rng.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(sorted(set(rows)), "g int, v double, n long").groupBy("g", "v").agg(F.sum("n").alias("n"))
    data = [(r["g"], r["v"], r["n"]) for r in df.collect()]
    for r in rank.running_sum(df, ["v"], "n", "s", group=["g"]).collect():
        assert r["s"] == sum(n for g, v, n in data if g == r["g"] and v <= r["v"])
    values = [v for _, v, _ in rows]
    x = spark.createDataFrame(rows, "g int, v double, n long")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert abs(rank.exact_quantile(x, "v", q) - np.percentile(values, 100 * q)) < 1e-9
    assert rank.exact_quantile(x.where("false"), "v", 0.5) is None


def test_several_quantiles_in_one_pass(spark):
    values, qs = [float(i * 37 % 101) for i in range(200)], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    x = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert np.allclose(rank.exact_quantiles(x, "v", qs), np.percentile(values, [100 * q for q in qs]), atol=1e-9)
    assert rank.exact_quantiles(x.where("v is null"), "v", qs) == [None] * 6
    assert rank.exact_quantiles(x.where("v = 37"), "v", [0.3, 1.0]) == [37.0, 37.0]


def test_core_residues_equal_a_count_of_windows(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in [0, 5, 8, *range(9, 30), 200, 1000]]
    want = {}
    for s in seqs:
        for i in range(len(s) - 8):
            for r in s[i : i + 9]:
                want[r] = want.get(r, 0) + 1
    got = {r["residue"]: r["n"] for r in collapse.core_residues(spark.createDataFrame([(s,) for s in seqs], "sequence string")).collect()}
    assert got == want


def test_pool_equals_brute_force(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACDEFGK") for _ in range(n)) for n in (0, 7, 8, 30, 120, 400)]
    want = set()
    for s in seqs:
        pieces = re.findall("[^KR]*[KR]|[^KR]+$", s)
        for x in [s, *pieces]:
            want |= {x[i : i + k] for k in range(8, 19) for i in range(len(x) - k + 1)}
        want |= {p for p in pieces if 8 <= len(p) <= 25}
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    got = tile.pool(df, *tile.cut_behind("sequence", "KR")).orderBy("length", "peptide").collect()
    assert [(r["length"], r["peptide"]) for r in got] == sorted((len(p), p) for p in want)


def test_windows_of_slices_with_other_letters(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY" + ("X" if rng.random() < 0.3 else "")) for _ in range(n)) for n in (9, 64, 65, 300, 700)]
    df = spark.createDataFrame(list(enumerate(seqs)), "parent int, sequence string")
    got = sorted((r["parent"], r["start"]) for r in tile.with_flanks(df, first=1, only_canonical=True).collect())
    assert got == [(p, i) for p, s in enumerate(seqs) for i in range(1, len(s) - 8) if "X" not in s[max(0, i - 4) : i + 13]]


def test_ridge_ensemble_equals_normal_equations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5))
    y = x @ np.arange(5) + 3 + rng.normal(size=200)
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y double").repartition(3)
    w, c = learn.ridge_ensemble(df, "k", F.col("x"), "y", replicates=8)
    for r in range(9):
        weight = learn.poisson(np.arange(200).astype(np.uint64), r, 0) if r else np.ones(200)
        m = (weight[:, None] * x).sum(0) / weight.sum()
        z, t = x - m, y - (weight * y).sum() / weight.sum()
        want = np.linalg.solve((z * weight[:, None]).T @ z + 10 * np.eye(5), (z * weight[:, None]).T @ t)
        assert np.allclose(w[r], want)
    scored = {r["k"]: (r["mean"], r["spread"]) for r in learn.ensemble_scores(df, "k", F.col("x"), w, c).collect()}
    assert np.allclose([scored[i][0] for i in range(200)], x @ w[0] + c[0]) and np.allclose([scored[i][1] for i in range(200)], (x @ w[1:].T + c[1:]).std(axis=1))
    assert 0.8 < learn.poisson(np.arange(100_000).astype(np.uint64), 1, 0).mean() < 1.2


def test_allele_heads_use_strong_rows_where_there_are_any(spark):
    rows = [(0, "a", [1.0, 0.0], 1.0), (1, "a", [0.0, 1.0], 50.0), (2, "a", [1.0, 1.0], 20.0), (3, "b", [1.0, 0.0], 90.0), (4, "b", [0.0, 1.0], 80.0)]
    got = {r["k"]: r for r in learn.allele_head(spark.createDataFrame(rows, "k int, allele string, v array<double>, p double"), "allele", "v", "p").collect()}
    assert abs(got[0]["cosine"] - 1) < 1e-9 and abs(got[1]["cosine"]) < 1e-9 and abs(got[3]["cosine"] - 0.5**0.5) < 1e-9
    order = sorted((got[i]["cosine"], got[i]["propensity"]) for i in range(3))
    assert [p for _, p in order] == sorted(p for _, p in order)


def test_errors_of_joins_and_contracts(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5)], "k int, v int")
    with pytest.raises(join.CardinalityError):
        join.require_matched(join.validated_join(left, right, ["k"]), "v")
    with pytest.raises(tables.ContractError):
        tables.contract_order(left, {"a": "missing"})


def test_the_sixth_gate(spark):
    rows = [("AA", 90.0, 5.0, 0.5, 0, 1.5), ("CC", 90.0, 5.0, 0.5, 0, None)]
    df = spark.createDataFrame(rows, "sequence string, plddt double, interface_pae double, rmsd double, clashes int, perplexity double")
    assert {r["sequence"]: r["status"] for r in structure.gates(df).collect()} == {"AA": "pass", "CC": "fail"}


def test_sequence_maps_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"P1": "ACD", "P2": "EFG"}')
    got = tables.read_sequence_map(spark, str(tmp_path)).collect()
    assert {r["accession"]: r["sequence"] for r in got} == {"P1": "ACD", "P2": "EFG"}


def test_queries_without_sql(spark, data):
    assert QUERIES["row_split"](spark, data).groupBy("cluster").count().where("count > 1").count() == 0
    assert {r["length"] for r in QUERIES["peptide_pool"](spark, data).collect()} >= set(range(8, 19))
