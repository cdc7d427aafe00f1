"""Store, contract gate, scorer, bitmaps, growth with state, reviews and roll-ups on odd rows."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.operators import cache, contract, metrics, quality, rank, rollup, scorer, sets, split, structure
from windloom.operators.quality import GateError
from windloom.streaming import growing

# ---- store -----------------------------------------------------------------------------------


def test_the_store_computes_only_what_is_missing_and_adds_nothing_twice(spark, tmp_path):
    store, asked = cache.Store(spark, str(tmp_path / "s"), "k", blocks=8), []

    def compute(new):
        asked.append(sorted(r["k"] for r in new.collect()))
        return new.select("k", F.length("k").alias("n"))

    rows = lambda ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert store.hit_rate(rows(["a"])).first()["n_hits"] == 0
    first = store.ensure(rows(["a", "bb", "bb", None]), compute, "one")
    assert {(r["k"], r["n"]) for r in first.collect()} == {("a", 1), ("bb", 2)}
    second = store.ensure(rows(["bb", "ccc"]), compute, "two")
    assert {(r["k"], r["n"]) for r in second.collect()} == {("bb", 2), ("ccc", 3)}
    assert asked == [["a", "bb"], ["ccc"]]
    store.append(rows(["ccc"]).select("k", F.lit(3).alias("n")), "two")  # the same batch again
    assert store.rows().count() == 3
    got = store.hit_rate(rows([*"abcdefgh", "bb", "ccc"])).first()
    assert (got["n_keys"], got["n_hits"]) == (10, 3) and 3 <= got["n_maybe"] <= 5
    assert {r["k"]: r["hit"] for r in store.lookup(rows(["a", "zz"])).collect()} == {"a": True, "zz": False}


def test_a_full_filter_costs_time_but_no_result(spark, tmp_path):
    store = cache.Store(spark, str(tmp_path / "s"), "k", blocks=1)
    keys = spark.range(60_000).select(F.col("id").cast("string").alias("k"))
    store.append(keys, "all")
    more = spark.range(59_000, 61_000).select(F.col("id").cast("string").alias("k"))
    got = store.hit_rate(more).first()
    assert got["n_keys"] == 2000 and got["n_hits"] == 1000 and got["n_maybe"] > 1900
    assert store.missing(more).count() == 1000


# ---- contract --------------------------------------------------------------------------------

FIELDS = "row_id string, peptide string, length int, start int, end int, n_flank string, c_flank string, split string, protein_cluster_id string, peptide_cluster_id string, label double"
GOOD = [(f"r{i}", "ACDEF", 5, i, i + 5, "A", None, ("train", "val", "test")[i % 3], f"p{i}", f"q{i}", None if i == 4 else i / 10) for i in range(9)]
RULES = contract.Contract(targets=("label",))


def test_a_good_table_is_published_with_its_card(spark, tmp_path):
    df = spark.createDataFrame(GOOD, FIELDS)
    card = contract.publish(df, str(tmp_path / "d"), RULES, {"seed": 1}, [{"name": "x", "n_records": 9, "license": "open", "url": "file:x"}])
    assert card["rows"] == 9 and card["by"]["split"] == {"train": 3, "val": 3, "test": 3} and card["distinct"]["row_id"] == 9
    assert card["targets"]["label"]["n"] == 8 and card["targets"]["label"]["missing"] == 1 and card["warnings"] == ["label: target missing: 1/9"]
    values = [r[-1] for r in GOOD if r[-1] is not None]
    assert np.isclose(card["targets"]["label"]["mean"], np.mean(values)) and np.isclose(card["targets"]["label"]["std"], np.std(values, ddof=1))
    assert contract.manifest(spark, str(tmp_path / "d")) == json.loads(json.dumps(card))
    assert contract.read(spark, str(tmp_path / "d")).count() == 9 and "- train: 3" in contract.markdown(card)


def test_a_bad_table_is_not_named(spark, tmp_path):
    path = str(tmp_path / "d")
    first = contract.publish(spark.createDataFrame(GOOD, FIELDS), path, RULES)
    bad = [*GOOD, GOOD[0], ("x", "AXZ", 4, -1, 9, "?", None, "other", "p1", "q2", 1.0), ("y", None, 5, 1, 6, None, None, "test", "p1", None, 1.0)]
    df = spark.createDataFrame(bad, FIELDS)
    with pytest.raises(GateError) as e:
        contract.publish(df, path, RULES)
    assert "row_id: repeated: 1 (e.g. ['r0'])" in str(e.value)
    assert contract.manifest(spark, path)["version"] == first["version"]
    found = {r["rule"]: (r["severity"], r["n_bad"]) for r in contract.findings(df, RULES).collect()}
    assert found == {
        "row_id: repeated": ("error", 1), "protein_cluster_id: in several splits": ("error", 1), "peptide_cluster_id: in several splits": ("error", 1),
        "length is not the sequence's": ("error", 1), "end - start is not the length": ("error", 1), "start under 0": ("error", 1), "peptide: other residues": ("error", 1), "n_flank: other residues": ("error", 1),
        "split: value not allowed": ("error", 1), "peptide: required value missing": ("error", 1), "peptide_cluster_id: required value missing": ("error", 1), "label: target missing": ("warning", 1),
    }
    with pytest.raises(GateError):
        contract.publish(df.drop("split"), path, RULES)
    assert [r["rule"] for r in contract.findings(df.drop("split"), RULES).collect()] == ["missing columns"]


def test_grouped_findings_read_the_table_once(spark, tmp_path):
    spark.createDataFrame(GOOD, FIELDS).write.parquet(str(tmp_path / "t"))
    plan = contract.grouped(spark.read.parquet(str(tmp_path / "t")), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan and "peptide:" not in plan.split("ReadSchema")[1]


# ---- scorer ----------------------------------------------------------------------------------


def test_scorers_are_held_to_their_schema_and_failures_are_rows(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 3 else "KRDE"[: i % 5] + "A") for i in range(40)], "i int, peptide string").repartition(3)
    got = {r["i"]: r for r in scorer.STOCK.score(df, "composition", ["peptide"], rows=7).collect()}
    assert len(got) == 40
    for i, r in got.items():
        if i % 10 == 3:
            assert r["status"] == "ValueError: peptide is null" and r["charge"] is None
        else:
            assert r["status"] == "ok" and r["charged"] == (i % 5) / (i % 5 + 1)
    short = lambda t: pa.table({"x": [1.0]})
    bad = scorer.score_windows(df, short, "x double", ["peptide"]).collect()
    assert len(bad) == 40 and all(r["status"] == "ok" and r["x"] == 1.0 for r in bad)  # one row at a time it is right
    wrong = scorer.score_windows(df, lambda t: pa.table({"y": t.column("i")}), "x double", ["i"]).collect()
    assert len(wrong) == 40 and all(r["x"] is None and "missing" in r["status"] for r in wrong)
    assert scorer.score_windows(df.where("i > 99"), short, "x double", ["peptide"]).count() == 0
    with pytest.raises(ValueError):
        scorer.score_windows(df, short, "I double", ["peptide"])
    with pytest.raises(KeyError):
        scorer.STOCK.score(df, "other", ["peptide"])
    with pytest.raises(ValueError):
        scorer.STOCK.register("composition", short, "x double")


# ---- sets ------------------------------------------------------------------------------------


def test_shared_names_over_many_blocks(spark, monkeypatch):
    left = [(k, f"n{i}") for k in range(3) for i in range(0, 90, k + 1)] + [(5, "only"), (0, None)]
    right = [(k, f"n{i}") for k in range(3) for i in range(0, 90, 2)] + [(0, "n0"), (6, "x")]
    got = {r["k"]: r["shared"] for r in sets.shared_names(spark.createDataFrame(left, "k int, n string"), spark.createDataFrame(right, "k int, n string"), "k", "n").collect()}
    pick = lambda rows, k: {n for q, n in rows if q == k and n}
    assert got == {k: sorted(pick(left, k) & pick(right, k)) for k in (0, 1, 2, 5, 6)}
    big = spark.range(70_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"))
    assert {r["k"]: r["n"] for r in sets.union(sets.bitmaps(big, "k", "n", sets.numbered(big, "n")), "k").groupBy("k").agg(F.sum("n").alias("n")).collect()} == {0: 35_000, 1: 35_000}


def test_gates_with_and_without_a_shared_map(spark):
    df = spark.createDataFrame([(["b", "a"], ["a", "c"]), (["b"], None), (None, ["a"]), ([], [])], "q array<string>, s array<string>")
    got = df.select(C.hla_gate(True, F.col("q"), F.col("s")).alias("x"), C.hla_gate(False, F.col("q")).alias("y")).collect()
    assert [(r["x"]["gate"], r["x"]["shared"], r["y"]["gate"]) for r in got] == [("shared", ["a"], "query_only"), ("shared", [], "query_only"), ("shared", [], "not_available"), ("shared", [], "not_available")]


# ---- growth ----------------------------------------------------------------------------------


def test_growth_with_state_reads_no_history(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    known = spark.createDataFrame([(3,)], "k int")
    for i, keys in enumerate(([1, 2, 2], [2, 3], [], [3, 4])):
        spark.createDataFrame([(k, i) for k in keys], "k int, b int").write.parquet(str(src / f"b{i}"))
        stream = spark.readStream.schema("k int, b int").option("recursiveFileLookup", "true").parquet(str(src))
        q = growing.stream_new(stream, out, check, "k", known)
        q.awaitTermination()
        if progress := q.lastProgress:
            assert progress["stateOperators"][0]["numRowsUpdated"] <= len(set(keys))
    assert sorted((r["k"], r["b"]) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 0), (4, 3)]
    growing.stream_new(spark.readStream.schema("k int, b int").option("recursiveFileLookup", "true").parquet(str(src)), out, check, "k", known).awaitTermination()
    assert spark.read.parquet(out).count() == 3


# ---- definitions -----------------------------------------------------------------------------


def test_profiles_and_their_range_errors(spark):
    rank = lambda r: 1 - np.log1p(r) / np.log(101)
    df = spark.createDataFrame([(float(rank(r)), 0.5, a) for r, a in ((0.1, 1.0), (0.5000001, 0.0), (1.9, None), (2.0000001, 0.5), (2.1, 0.5))], "el double, ba double, a double")
    got = [r["x"] for r in df.select(C.profile(F.col("el"), F.col("ba"), F.col("a")).alias("x")).collect()]
    assert [(x["binder_class"], x["risk_band"]) for x in got] == [("strong", "high"), ("strong", "high"), ("weak", "moderate"), ("weak", "moderate"), ("nonbinder", "low")]
    assert [None if x["ic50"] is None else round(x["ic50"], 3) for x in got] == [1.0, 50000.0, None, 223.607, 223.607]
    for bad in ((1.1, 0.5, None), (float("nan"), 0.5, None), (None, 0.5, None), (0.5, -0.1, None), (0.5, 0.5, 2.0)):
        with pytest.raises(Exception, match="between 0 and 1"):
            spark.createDataFrame([bad], "el double, ba double, a double").select(C.profile(F.col("el"), F.col("ba"), F.col("a"))).collect()


def test_confidence_of_a_window(spark):
    df = spark.createDataFrame([(0.5, 0.9, 0.8, 0.7, "ACDEF", "AC"), (-1.0, 0.5, 0.0, 1.0, None, "")], "s double, p double, n double, c double, nf string, cf string")
    got = [r["x"] for r in df.select(C.window_confidence(*[F.col(x) for x in ("s", "p", "n", "c", "nf", "cf")]).alias("x")).collect()]
    parts = [1 / 1.5, 0.8, 0.75, 1 - np.std([0.8, 0.7, 0.9]) / np.std([0, 0, 1])]
    assert np.allclose([got[0][k] for k in ("tap", "mhc", "context", "agreement")], parts) and np.isclose(got[0]["confidence"], np.exp(np.mean(np.log(parts))))
    assert got[1]["tap"] == 1.0 and got[1]["mhc"] == 0.0 and got[1]["context"] == 0.0 and 0 < got[1]["confidence"] < 0.01


def test_operating_points_break_ties_by_key(spark):
    df = spark.createDataFrame([(i, [0.9, 0.9, 0.9, 0.5, 0.1][i], [3.0, 0.2, 0.3, 0.1, 9.0][i]) for i in range(5)], "id long, p double, r double")
    got = {r["target"]: r for r in metrics.operating_points(df, "id", "p", "r", targets=(0.3, 0.6, 1.0)).collect()}
    assert [(got[t]["n_flagged"], round(got[t]["precision"], 4)) for t in (0.3, 0.6, 1.0)] == [(2, 0.5), (3, 0.6667), (4, 0.75)]
    assert got[0.3]["default_flagged"] == 0 and got[0.3]["default_precision"] == 0.0
    with pytest.raises(metrics.InputError):
        metrics.operating_points(df.where("r > 2"), "id", "p", "r")


def test_medians_by_group(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 9.0)] + [("b", 4.0), ("c", None)], "g string, v double")
    assert {r["g"]: r["m"] for r in metrics.grouped_median(df, "v", ["g"], "m").collect()} == {"a": 2.0, "b": 4.0}


def test_tracks_clip_and_normalise(spark):
    w = spark.createDataFrame([("a", -2, [1.0, 1.0, 4.0, -6.0], 1.0), ("a", 1, [2.0, 2.0, 2.0, 2.0], 0.5), ("b", 0, [-1.0], 1.0)], "parent string, start int, profile array<double>, w double")
    lengths = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("d", 0)], "parent string, length int")
    got = {(r["parent"], r["pos"]): r["heat"] for r in rollup.profile_track(w, lengths, "parent", "start", "profile", F.col("w")).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): -2.5 / 4, ("a", 2): 0.25, ("b", 0): -1.0, ("b", 1): 0.0, ("c", 0): 0.0}
    other = {(r["parent"], r["pos"]): r["heat"] for r in rollup.profile_track(w, lengths, "parent", "start", "profile", absolute=True).collect()}
    assert other["b", 0] == -1.0 and other["a", 0] == 1.0 and other["a", 1] == -0.5


def test_segments_by_hotspots_then_length_then_place(spark):
    p = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 8, 12)] + [("b", 5), ("b", 5), ("c", 1), ("c", 3)], "g string, i int")
    h = spark.createDataFrame([("a", 12), ("a", 99), ("a", 8), ("b", 1)], "g string, i int")
    assert {tuple(r) for r in rank.covering_segment(p, h, "g", "i").collect()} == {("a", 7, 8, 1), ("b", 5, 5, 0), ("c", 1, 1, 0)}


def test_reviews_count_what_is_missing(spark):
    a = spark.createDataFrame([(1, "ACD", 0.5), (2, "AC", None), (3, None, 0.1)], "id int, sequence string, combined_rank double")
    p = spark.createDataFrame([(1, "x", "ok", 18), (2, "x", "error", 18), (1, "y", "error", 1)], "id int, provider string, status string, n_alleles int")
    u = spark.createDataFrame([(1, "unavailable"), (2, "unavailable")], "id int, status string")
    t = spark.createDataFrame([(1, 3), (1, 4), (2, 2)], "id int, n_values int")
    got = {(r["id"], r["check"]): r["passed"] for r in quality.review_assessments(a, p, u, t, "x").collect()}
    assert got == {(1, "primary_ok"): True, (1, "panel_complete"): True, (1, "unavailable_has_no_rank"): False, (1, "tracks_aligned"): False, (2, "primary_ok"): False, (2, "panel_complete"): True, (2, "unavailable_has_no_rank"): True, (2, "tracks_aligned"): True, (3, "primary_ok"): False, (3, "panel_complete"): False, (3, "unavailable_has_no_rank"): True}
    files = quality.file_integrity(spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, sha256 string"), spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "path string, sha256 string"))
    assert {r["path"]: r["status"] for r in files.collect()} == {"a": "ok", "b": "mismatch", "c": "missing", "d": "unlisted"}


def test_gyration_needs_three_atoms(spark):
    rows = [("t", "f1", 0.0, 0.0, 0.0), ("t", "f1", 2.0, 0.0, 0.0), ("t", "f1", 1.0, 3.0, 0.0), ("t", "f2", 1.0, 1.0, 1.0), ("u", "g", 1e6, 0.0, 0.0), ("u", "g", 1e6 + 1, 0.0, 0.0), ("u", "g", 1e6 + 2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t string, f string, x double, y double, z double")
    got = {r["t"]: r for r in structure.gyration_by_target(df, "t", "f").collect()}
    x = np.array([r[2:] for r in rows[:3]])
    assert np.isclose(got["t"]["mean"], np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean())) and got["t"]["n_files"] == 1 and got["t"]["deviation"] is None
    assert np.isclose(got["u"]["mean"], np.sqrt(2 / 3))


def test_weights_over_two_folds_need_two_folds(spark):
    with pytest.raises(ValueError):
        split.pack_folds(spark.createDataFrame([("a", 1)], "component string, weight long"), 1)


def test_failures_cost_few_calls_and_no_batch_for_each_row(spark):
    def counting(t):
        counting.calls = getattr(counting, "calls", 0) + 1
        if t.column("i").to_pylist().count(5):
            raise ValueError("five")
        return pa.table({"calls": pa.array([counting.calls] * t.num_rows, pa.int32())})

    df = spark.range(256).select(F.col("id").cast("int").alias("i")).coalesce(1)
    scored = scorer.score_windows(df, counting, "calls int", ["i"], rows=64)
    got = {r["i"]: r for r in scored.collect()}
    assert len(got) == 256 and [i for i, r in got.items() if r["status"] != "ok"] == [5] and got[5]["calls"] is None
    assert max(r["calls"] for i, r in got.items() if i != 5) <= 20  # one by one it took 64 calls for the first table alone


def test_a_scorer_that_names_its_failures_is_asked_once(spark):
    def naming(t):
        naming.calls = getattr(naming, "calls", 0) + 1
        bad = ["five" * 200 if i % 10 == 5 else None for i in t.column("i").to_pylist()]
        return pa.table({"calls": pa.array([naming.calls] * t.num_rows, pa.int32()), "error": pa.array(bad, pa.string())})

    df = spark.range(256).select(F.col("id").cast("int").alias("i")).coalesce(1)
    got = {r["i"]: r for r in scorer.score_windows(df, naming, "calls int", ["i"], rows=64).collect()}
    assert len(got) == 256 and max(r["calls"] for r in got.values() if r["calls"]) == 4
    assert all((r["calls"], r["status"]) == (None, "five" * 125) if i % 10 == 5 else r["status"] == "ok" for i, r in got.items())
    own = scorer.score_windows(df, lambda t: pa.table({"error": t.column("i").cast(pa.string())}), "error string", ["i"]).collect()
    assert all(r["status"] == "ok" and r["error"] == str(r["i"]) for r in own)  # a column that was declared is a result
    table = pa.table({"peptide": ["KRDA", None, ""]})
    assert scorer.composition(table).to_pydict() == {"charged": [0.75, None, 0.0], "charge": [1, None, 0], "error": [None, "ValueError: peptide is null", None]}
