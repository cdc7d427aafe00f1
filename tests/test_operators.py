"""Properties of the library's operators on tiny tables."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from windloom.functions import scores as C
from windloom.functions import sequence as S
from windloom.operators import collapse, graph, join, metrics, quality, rank, split, tile
from windloom.sources import fasta


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_tiling_counts_and_flanks(spark):
    df = spark.createDataFrame([("a", "MKTAYIAKQRQISFVKSHFS"), ("b", "MKTAYIAXQRQISFVKSHFS"), ("c", "MKTAYIAKQ"), ("d", "")], "parent string, sequence string")
    t = tile.with_flanks(df, first=1, only_canonical=True).collect()
    a = sorted((r["start"], r["peptide"], r["n_flank"], r["c_flank"]) for r in t if r["parent"] == "a")
    assert len(a) == 11 and a[0] == (1, "KTAYIAKQR", "M", "QISF") and a[-1] == (11, "ISFVKSHFS", "KQRQ", "")
    assert all("X" not in r["n_flank"] + r["peptide"] + r["c_flank"] for r in t)
    assert tile.with_flanks(df).where("parent = 'c'").count() == 1
    fifteen = tile.sized(spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWY",), ("ACD",), ("",)], "sequence string"), size=15)
    assert sorted((r["start"], r["end"]) for r in fifteen.where("sequence like 'ACDE%'").collect()) == [(i, i + 15) for i in range(6)]
    assert [(r["start"], r["end"], r["peptide"]) for r in fifteen.where("sequence = 'ACD'").collect()] == [(0, 3, "ACD")]


def test_long_sequences_are_sliced_without_a_seam(spark):
    seq = "".join("ACDEFGHIKLMNPQRSTVWY"[(i * i + i // 7) % 20] for i in range(1500))
    t = tile.with_flanks(spark.createDataFrame([(seq,)], "sequence string")).collect()
    assert sorted((r["start"], r["peptide"], r["n_flank"], r["c_flank"]) for r in t) == [(i, seq[i : i + 9], seq[max(0, i - 4) : i], seq[i + 9 : i + 13]) for i in range(1492)]


def test_cleaning(spark):
    assert one(spark, " mktaHHHHHHy ", S.clean_or_reject) == "MKTAY"
    assert one(spark, "MKXA", S.clean_or_reject) == ""
    assert one(spark, ">id\nMKX a", S.clean_delete) == "MKA"
    assert one(spark, "MGHHHHHHAAAA" + "C" * 30 + "HHHHHAA", S.strip_tags) == "AAAA" + "C" * 30
    assert one(spark, "ACDX", lambda x: F.array_join(F.transform(S.one_hot_indexes(x), lambda i: i.cast("string")), ",")) == "0,21,42"


def test_first_row_and_first_known_value_differ(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), ("j", 1, "c")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in collapse.keep_first(df, ["k"], F.col("o")).collect()} == {"k": None, "j": "c"}
    assert {r["k"]: r["v"] for r in df.groupBy("k").agg(collapse.first_known("v", F.col("o"))).collect()} == {"k": "b", "j": "c"}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_validated_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(join.CardinalityError):
        join.validated_join(left, right, ["k"])
    assert join.validated_join(left, right.limit(1), ["k"]).count() == 2
    with pytest.raises(join.CardinalityError):
        join.require_matched(left.join(right.where("w = 'z'"), "k", "left"), "w")


def test_overlap_pairs_once_across_cells(spark):
    w = spark.createDataFrame([("p", s, s + 90) for s in range(0, 300, 30)], "g string, start int, end int")
    h = spark.createDataFrame([("p", s, s + 130) for s in range(0, 300, 50)], "g string, hit_start int, hit_end int")
    got = sorted((r["start"], r["hit_start"]) for r in join.overlaps(w, h, "g", how="inner").collect())
    assert got == sorted((a, b) for a in range(0, 300, 30) for b in range(0, 300, 50) if a < b + 130 and b < a + 90)


def test_distance_join(spark):
    pts = [("s", c, i, float(x), float(y), 0.0) for i, (c, x, y) in enumerate([("A", 0, 0), ("A", 5, 5), ("B", 1, 1), ("B", -1.5, 0), ("B", 9, 9), ("A", 1.9, 0.1)])]
    df = spark.createDataFrame(pts, "structure string, chain string, id int, x double, y double, z double")
    got = sorted((r["id"], r["id_b"]) for r in join.within_distance(df, 2.0, "structure", "chain").collect())
    want = sorted((a[2], b[2]) for a in pts for b in pts if a[1] < b[1] and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 4)
    assert got == want


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 50}", float(i % 97)) for i in range(1000)], "id int, grp string, score double")
    s = split.group_split(df, "grp").collect()
    assert sorted((x, sum(r["split"] == x for r in s)) for x in ("train", "val", "test")) == [("test", 5), ("train", 40), ("val", 5)]
    q = split.quantile_sample(df, 200, "score", "id")
    r = q.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert r[0] == 200 and r[1] < 20 and r[2] > 80
    assert split.quantile_sample(df.limit(3), 100, "score", "id").count() == 3
    w = spark.createDataFrame([(f"c{i}", i % 9 + 1) for i in range(300)], "component string, weight long")
    folds = split.pack_folds(w).join(w, "component").groupBy("fold").agg(F.sum("weight").alias("w")).collect()
    assert len(folds) == 5 and max(r["w"] for r in folds) <= min(r["w"] for r in folds) + 9
    t = df.withColumn("split", F.when(F.col("id") < 400, "train").when(F.col("id") < 700, "val").otherwise("test"))
    assert {r["split"]: r["count"] for r in split.split_sample(t, 100, "id").groupBy("split").count().collect()} == {"train": 80, "val": 10, "test": 10}


def test_global_order_without_one_task(spark):
    df = spark.createDataFrame([(float((i * 37) % 101), i) for i in range(400)], "v double, n long")
    got = {r["n"]: r["rn"] for r in rank.global_row_number(df, ["v", "n"]).collect()}
    order = sorted(((i * 37) % 101, i) for i in range(400))
    assert got == {n: k + 1 for k, (_, n) in enumerate(order)}


def test_peaks(spark):
    df = spark.createDataFrame([([(0, 9), (5, 14), (9, 18), (30, 39)],)], "w array<struct<start:int,end:int>>")
    got = df.select(rank.spaced_peaks(F.col("w"), 25).alias("a"), rank.spaced_peaks(F.col("w"), 2, F.lit(6)).alias("b")).first()
    assert [x["start"] for x in got["a"]] == [0, 9, 30] and [x["start"] for x in got["b"]] == [0, 9]


def test_metrics_need_both_classes_and_break_no_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.1, False)], "s double, y boolean")
    assert metrics.roc_auc(df, "s", "y").first()["roc_auc"] == 1.0 and metrics.average_precision(df, "s", "y").first()["average_precision"] == 1.0
    assert metrics.roc_auc(df.where("y"), "s", "y").first()["roc_auc"] is None
    tied = df.withColumn("s", F.lit(0.5))
    assert metrics.roc_auc(tied, "s", "y").first()["roc_auc"] == 0.5 and metrics.average_precision(tied, "s", "y").first()["average_precision"] == 0.5
    b = metrics.bootstrap(df.withColumn("id", F.monotonically_increasing_id()), "id", "s", 200).first()
    assert b["lo"] <= 0.5 <= b["hi"]


def test_fingerprint_ignores_order_and_sees_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    f = lambda df: quality.fingerprint(df).first()["fingerprint"]
    assert f(a) == f(a.orderBy(F.desc("k"))) == f(a.select("v", "k"))
    assert len({f(a), f(a.distinct()), f(a.withColumn("v", F.lit("x"))), quality.fingerprint(a, "2").first()["fingerprint"]}) == 4


def test_gate(spark):
    df = spark.createDataFrame([(None,), (1,)], "x int")
    found = quality.rules(df, {"present": ("error", F.col("x").isNull()), "big": ("warning", F.col("x") < 5)})
    with pytest.raises(quality.GateError, match="present: 1"):
        quality.gate(found)
    quality.gate(found.where("severity = 'warning'"))


def test_json_metric(spark):
    doc = json.dumps({"a": {"b": 3.5}, "list": [1, 2, 6], "flag": True})
    get = lambda *p: one(spark, doc, lambda x: quality.json_metric(x, *p))
    assert get("a.b") == 3.5 and get("list") == 3.0 and get("flag") is None and get("none", "a.b") == 3.5


def test_scores(spark):
    row = spark.range(1).select(
        C.propensity_to_rank(C.rank_to_propensity(F.lit(3.7))).alias("back"),
        C.binder_class(F.lit(2.0)).alias("weak"),
        C.binder_class(F.lit(2.01)).alias("non"),
        C.fuse({"a": F.lit(None).cast("double"), "b": F.lit(0.5)}, {"a": 0.5, "b": 0.5}).alias("fused"),
        C.fuse({"a": F.lit(None).cast("double"), "b": F.lit(0.5)}, {"a": 0.5, "b": 0.5}, ["a"]).alias("none"),
        C.relative_accessibility(F.lit("A"), F.lit(300.0)).alias("rsa"),
        C.relative_accessibility(F.lit("X"), F.lit(300.0)).alias("unknown"),
        C.interpolate(F.lit(0.5), [0.0, 1.0], [0.0, 10.0]).alias("between"),
        C.tolerance(F.lit(float("-inf"))).alias("finite"),
    ).first()
    assert abs(row["back"] - 3.7) < 1e-9 and (row["weak"], row["non"]) == ("weak", "nonbinder")
    assert (row["fused"], row["none"], row["rsa"], row["unknown"], row["between"], row["finite"]) == (0.5, None, 1.5, None, 5.0, 0.0)


def test_fasta_round_trip(spark, tmp_path):
    text = ">sp|P1|NAME a > b\nMKTA\nYIAK\n>two\nACD\n>empty\n>last\nWY"
    (tmp_path / "a.fasta").write_text(text)
    got = {r["id"]: (r["accession"], r["sequence"]) for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"sp|P1|NAME": ("P1", "MKTAYIAK"), "two": ("two", "ACD"), "empty": ("empty", ""), "last": ("last", "WY")}
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(text)
    assert fasta.read_fasta(spark, str(tmp_path / "b.fasta.gz")).count() == 4
    fasta.write_fasta(fasta.read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).where("sequence = 'MKTAYIAK'").count() == 1


def test_artefacts(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"predictions_by_sha256": {"ab": [{"start": 0, "end": 9, "score": 0.5}, {"start": 1, "end": 10, "score": 0.25}]}}))
    assert [(r["sha256"], r["start"], r["score"]) for r in fasta.read_predictions(spark, str(tmp_path / "p.json")).orderBy("start").collect()] == [("ab", 0, 0.5), ("ab", 1, 0.25)]
    atom = "ATOM      1  CA  MET A   1      11.000  12.500  -3.250  1.00 20.00           C\nTER\n"
    (tmp_path / "m.pdb").write_text(atom)
    r = fasta.read_pdb_atoms(spark, str(tmp_path / "m.pdb")).first()
    assert (r["name"], r["residue"], r["chain"], r["number"], r["x"], r["z"], r["element"]) == ("CA", "MET", "A", 1, 11.0, -3.25, "C")
    assert fasta.file_hashes(spark, str(tmp_path / "m.pdb")).first()["length"] == len(atom)


def test_more_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 20}", "a" if i % 2 else "b", 1.0) for i in range(400)], "id int, grp string, cat string, y double")
    hidden = split.hide_labels(df, "grp", "y", 0.25)
    assert hidden.where("y is not null").select("grp").distinct().count() == 5 and hidden.count() == 400
    held = split.category_holdout(df, "cat", "grp", least_rows=100)
    assert held.count() == 800 and held.where("part <> 'source' and cat <> held_out").count() == 0
    assert quality.leaks(held.where("part <> 'source'"), "grp", "part").count() == 0
    assert split.panel_sample(df, "cat", "grp", 3).select("cat", "grp").distinct().count() == 6
    assert df.select(split.sample_weight(F.lit(1.0), F.lit(5.0))).first()[0] == 3.0


def test_provider_status_and_warnings(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    got = spark.createDataFrame([("a", 0.5, None), ("b", 0.7, "boom"), ("d", 0.1, None)], "k string, score double, error string")
    r = {x["k"]: (x["status"], x["score"]) for x in quality.provider_status(asked, got, ["k"], F.col("k") != "d").collect()}
    assert r == {"a": ("ok", 0.5), "b": ("error", None), "c": ("unavailable", None), "d": ("unsupported", None)}
    assert spark.range(1).select(quality.warnings(late=F.lit(True), early=F.lit(False), odd=F.lit(True))).first()[0] == ["late", "odd"]
