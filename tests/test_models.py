"""Models, structures, growth and tabular sources on tiny tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.operators import isotonic, learn, neighbours, structure
from windloom.sources import tables
from windloom.streaming import growing


def test_ridge_fills_nulls_as_the_closed_form(spark):
    rng = np.random.default_rng(0)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    peptides = ["".join(rng.choice(list(letters), 9)) for _ in range(50)]
    y = [float(sum(letters.index(c) for c in p)) / 10 if i < 30 else None for i, p in enumerate(peptides)]
    df = spark.createDataFrame([(p, v, "base") for p, v in zip(peptides, y, strict=True)], "peptide string, tap double, version string")
    got = {r["peptide"]: r for r in learn.ridge_impute(df, "peptide", "tap", "version", "tap_ridge=1").collect()}
    x = np.zeros((50, 180))
    for i, p in enumerate(peptides):
        for j, c in enumerate(p):
            x[i, j * 20 + letters.index(c)] = 1
    a, b = x[:30] - x[:30].mean(0), np.array(y[:30]) - np.mean(y[:30])
    w = np.linalg.solve(a.T @ a + 10 * np.eye(180), a.T @ b)
    want = (x - x[:30].mean(0)) @ w + np.mean(y[:30])
    for i, p in enumerate(peptides):
        if y[i] is None:
            assert abs(got[p]["tap"] - want[i]) < 1e-6 and got[p]["version"] == "base;tap_ridge=1"
        else:
            assert got[p]["tap"] == y[i] and got[p]["version"] == "base"


def test_knn_and_pca(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3].mean(1)
    got = {r["id"]: r["distance"] for r in neighbours.knn_distance(df, df, "id", "v", k=3).collect()}
    assert np.allclose([got[i] for i in range(40)], want)
    p = {r["id"]: np.array(r["projected"]) for r in learn.pca(df, "v", 2).collect()}
    c = v - v.mean(0)
    q = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    assert np.allclose([abs(p[i] @ p[j]) for i in range(5) for j in range(5) if i == j], 1) and np.allclose([[p[i] @ p[j] for j in range(40)] for i in range(40)], q @ q.T, atol=1e-6)


def test_isotonic(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "x double, y double")
    df = df.withColumn("g", F.lit(1))
    assert [r["v"] for r in isotonic.interpolate(df, isotonic.knots(df, "g", "x", "y"), "g", "x", "y", "v").orderBy("x").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_pooled_vectors(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "v array<array<double>>")
    assert df.select(learn.pooled(F.col("v"), F.lit(-1), F.lit(2))).first()[0] == [2.0, 3.0]


def test_chain_offsets_and_gates(spark):
    df = spark.createDataFrame([("ABCDEFGH", "ABCDEFGH"), ("CDEF", "ABCDEFGH"), ("ABCDEFGH", "CDEF"), ("XYZ", "ABCDEFGH"), ("", "ABC")], "chain string, design string")
    assert [r[0] for r in df.select(structure.chain_offset(F.col("chain"), F.col("design"))).collect()] == [0, 2, -2, None, None]
    c = spark.createDataFrame([(1, "A", 85.0, 5.0, 0.5, 0), (2, "B", None, 5.0, 0.5, 0), (3, "C", 85.0, 5.0, 0.5, 0), (4, "C", 85.0, 5.0, 0.5, 0)], "id int, sequence string, plddt double, interface_pae double, rmsd double, clashes int")
    assert {r["id"]: r["selection"] for r in structure.gates(c).collect()} == {1: "eligible", 2: "blocked", 3: "blocked", 4: "blocked"}
    w = spark.createDataFrame([("p", 0, 9), ("q", 0, 9)], "parent string, start int, end int")
    res = spark.createDataFrame([("p", i, 0.1 if i < 3 else 0.9) for i in range(9)] + [("q", i, 0.1) for i in range(4)], "parent string, pos int, rsa double")
    got = {r["parent"]: r for r in structure.window_accessibility(w, res).collect()}
    assert abs(got["p"]["buried"] - 3 / 9) < 1e-12 and got["q"]["buried"] is None and got["q"]["observed"] == 4
    m = spark.createDataFrame([(1, 1, [[0.0, 4.0, 6.0], [2.0, 0.0, 9.0], [8.0, 9.0, 0.0]])], "id int, n_first int, pae array<array<double>>")
    assert structure.interface_pae(m).first()["interface_pae"] == 5.0


def test_expand_keeps_parents_in_their_split(spark):
    old = spark.createDataFrame([(1, "p1", "train"), (2, "p2", "val")], "k int, p string, split string")
    new = spark.createDataFrame([(1, "p1"), (3, "p1"), (4, "p3"), (5, "p3"), (6, "p2")], "k int, p string")
    got = growing.expand(new, old, "k", "p", 10).collect()
    assert sorted(r["k"] for r in got) == [1, 2, 3, 4, 5, 6]
    by = {}
    for r in got:
        by.setdefault(r["p"], set()).add(r["split"])
    assert by["p1"] == {"train"} and by["p2"] == {"val"} and len(by["p3"]) == 1


def test_streamed_growth_adds_each_key_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for i, keys in enumerate(([1, 2], [2, 3], [3, 4])):
        spark.createDataFrame([(k,) for k in keys], "k int").write.parquet(str(src / f"b{i}"))
        stream = spark.readStream.schema("k int").option("recursiveFileLookup", "true").parquet(str(src))
        growing.stream_new(stream, out, str(tmp_path / "check"), "k").awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_tabular_contracts(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("allele\tstart\tend\tpeptide\tic50\nA\t1\t9\tACDEFGHIK\t50000\nA\t2\t10\tCDEFGHIKL\t1\n")
    got = tables.read_responses(spark, str(tmp_path / "r.tsv")).orderBy("start").collect()
    assert [(r["hit_start"], r["hit_end"], round(r["value"], 6)) for r in got] == [(0, 9, 0.0), (1, 10, 1.0)]
    with pytest.raises(tables.ContractError):
        tables.require(spark.range(1), ["x"])
    p = spark.createDataFrame([("a", "acd"), ("b", "WY")], "parent string, sequence string")
    assert tables.load_parents(p).where("parent = 'a'").first()["sequence"] == "ACD"
    with pytest.raises(tables.ContractError):
        tables.load_parents(p.unionByName(p))
    card = tables.card(p.withColumn("score", F.lit(1.5)), ["score"], ["parent"])
    assert "| rows | all | 2 |" in tables.report(card) and card.count() == 9
