"""Steps whose rows or memory grew much faster than their input: cells of points, neighbour blocks, tracks, windows by parent."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_a_point_goes_to_few_cells_and_no_pair_is_lost(spark):
    from windloom.operators import join

    rng = random.Random(2)
    points = [(1, rng.choice("ABC"), i, *[rng.uniform(-20, 20) if i % 2 else rng.randrange(-9, 9) * 2.0 for _ in "xyz"]) for i in range(400)]
    df = spark.createDataFrame(points, "file int, chain string, id int, x double, y double, z double")
    got = {(r["id"], r["id_b"]) for r in join.within_distance(df, 4.0, "file", "chain").collect()}
    near = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])) ** 0.5 <= 4.0
    assert got == {(a[2], b[2]) for a in points for b in points if a[1] < b[1] and near(a, b)}
    cells = df.select(*[F.size(join.cells_within(F.col(c), 4.0, 4.0 * join.CELL_WIDTH)).alias(c) for c in "xyz"])
    assert cells.agg(F.avg(F.col("x") * F.col("y") * F.col("z"))).first()[0] < 5


def test_neighbours_take_memory_of_a_stripe(monkeypatch):
    from windloom.operators import neighbours

    monkeypatch.setattr(neighbours, "STRIPE", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 500)), pa.array(list(x[i : i + 500]))], names=["id", "v"]) for i in range(0, 2000, 500)]
    q, ids = neighbours.unit(x), np.arange(2000)
    tracemalloc.start()
    found_ids, found = neighbours.best_of(iter(batches), ids, q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = 1 - q @ q.T
    np.fill_diagonal(d, np.inf)
    assert np.allclose(found, np.sort(d, axis=1)[:, :5]) and (found_ids == np.argsort(d, axis=1)[:, :5]).all()
    assert peak < 2_000_000  # 2,000 queries against a stripe of 64 alone are a matrix of 1 MB, of which there were six


def test_tracks_are_made_without_joins(spark, data):
    from windloom.plans.catalogue import QUERIES

    for name in ("profile_heat", "residue_heat", "surrogate_tracks", "residue_confidence"):
        assert "Join" not in QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString(), name


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_windows_of_a_parent_are_not_dealt(spark, data):
    from windloom.plans.catalogue import QUERIES

    assert shuffles(QUERIES["tile_stride"](spark, data)) == 1


def test_numbers_of_windows_keep_their_order(spark):
    from windloom.functions import sequence as S

    rng = random.Random(3)
    words = [("".join(rng.choice(S.RESIDUES) for _ in range(9)),) for _ in range(300)] + [("AAAAAAAAA",), ("YYYYYYYYY",)]
    got = spark.createDataFrame(words, "p string").select("p", S.kmer_code(F.col("p"), 9).alias("c")).withColumn("back", S.kmer_text(F.col("c"), 9)).orderBy("c").collect()
    assert [r["p"] for r in got] == sorted(w for w, in words) and all(r["p"] == r["back"] for r in got)


def test_tile_no_skip_sorts_no_windows(spark, data):
    from windloom.plans.catalogue import QUERIES

    assert "SortAggregate" not in QUERIES["tile_no_skip"](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_windows_meet_residues_in_lists(spark):
    from windloom.operators import structure

    rng = random.Random(5)
    res = [(p, i, rng.choice([0.0, 0.1, 0.25, 0.7, None])) for p in (1, 2) for i in range(0, 90) if rng.random() < 0.6] + [(1, 7, 0.2)]
    win = [(p, s, s + n) for p in (1, 2, 3) for s in range(0, 90, 3) for n in (1, 9, 40)]
    w, r = spark.createDataFrame(win, "parent int, start int, end int"), spark.createDataFrame(res, "parent int, pos int, rsa double")
    made = structure.window_accessibility(w, r)
    got = {(x["parent"], x["start"], x["end"]): (x["observed"], x["mean_rsa"] and round(x["mean_rsa"], 9), x["buried"] and round(x["buried"], 9)) for x in made.collect()}
    for p, s, e in win:
        v = [x for q, i, x in res if q == p and s <= i < e and x is not None]
        full = len(v) >= structure.LEAST_OBSERVED
        assert got[p, s, e] == (len(v), round(sum(v) / len(v), 9) if full else None, round(sum(x < 0.25 for x in v) / len(v), 9) if full else None)
    assert len(got) == len(win) and "hashpartitioning(parent#0, start" not in (plan := made._jdf.queryExecution().executedPlan().toString())
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "start#" in x.split("ENSURE")[0]]


def test_windows_are_dealt_once(spark, data):
    from windloom.plans.catalogue import QUERIES

    plan = QUERIES["corpus_collapse"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(peptide" in x and "parent" in x]


def test_windows_meet_hits_as_blocks_of_starts(spark):
    from windloom.operators import join, tile

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACD") for _ in range(n))
    rows = [(1, word(300)), (1, word(90)), (1, word(90)), (2, word(15)), (3, word(4)), (4, ""), (None, word(70)), (5, word(143)), (6, None)]
    at = lambda: rng.randrange(-5, 300)
    hits = [(p, a, a + rng.choice([-20, -1, 0, 1, 9, 9, 150]), rng.choice("XYZ")) for p in (1, 2, 3, 5, None, 7) for a in [at() for _ in range(40)] + [0, 64, 64]]
    df = spark.createDataFrame(rows, "g int, sequence string").repartition(3)
    h = spark.createDataFrame(hits, "g int, hit_start int, hit_end int, kind string").repartition(2)
    windows = [(r["g"], r["start"], r["end"], r["peptide"]) for r in tile.sized(df).collect()]
    want = sorted((str(g), s, e, p, sorted((a, b, k) for q, a, b, k in hits if q is not None and q == g and s < b and a < e)) for g, s, e, p in windows)
    for how in ("left", "inner"):
        made = join.windows_of_blocks(join.blocks_with_hits(df, h, "g", how=how), "g")
        got = sorted((str(r["g"]), r["start"], r["end"], r["peptide"], sorted(map(tuple, r["hits"]))) for r in made.collect() if how == "left" or r["hits"])
        assert got == [w for w in want if how == "left" or w[-1]], how


def test_no_window_of_a_hit_travels(spark, data):
    from windloom.plans.catalogue import QUERIES

    for name, most in (("window_alleles", 4), ("interval_overlap", 3)):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert len(dealt) <= most and not any("peptide" in x or "start" in x for x in dealt), name
