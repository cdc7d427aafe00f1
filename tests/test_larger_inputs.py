"""Steps that took too much at six times the larger tables: what they deal, how often, and that the results are whole."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ridge_counts_equal_peptides_once_and_calls_no_function_for_a_cell(spark):
    from windloom.operators import learn

    rng = random.Random(7)
    peptides = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(rng.choice((5, 9, 11)))) for _ in range(30)]
    rows = [(rng.choice(peptides), rng.random() if i % 5 else None, "") for i in range(400)]
    df = learn.ridge_impute(spark.createDataFrame(rows, "p string, v double, t string"), "p", "v", "t", "ridge")
    letters = "ACDEFGHIKLMNPQRSTVWY"
    x = np.array([[float(i < len(p) and p[i] == r) for i in range(9) for r in letters] for p, _, _ in rows])
    known = np.array([v is not None for _, v, _ in rows])
    y = np.array([v or 0.0 for _, v, _ in rows])
    a = x[known] - x[known].mean(0)
    w = np.linalg.solve(a.T @ a + 10 * np.eye(180), a.T @ (y[known] - y[known].mean()))
    want = dict(zip([p for p, _, _ in rows], (x - x[known].mean(0)) @ w + y[known].mean(), strict=True))
    for r in df.collect():
        assert r["t"] == "" or abs(r["v"] - want[r["p"]]) < 1e-9
    assert df.where("t = 'ridge'").count() == 80 and "lambda" not in plan(df)


def test_core_residues_make_no_row_of_a_letter(spark):
    from windloom.operators import collapse

    seqs = [None, "", "ACDEFGHI", "ACDEFGHIK", "A" * 16, "ACDEFGHIKLMNPQRST", "C" * 500]
    df = collapse.core_residues(spark.createDataFrame([(s,) for s in seqs], "sequence string"))
    want = Counter(r for s in seqs if s for i in range(len(s) - 8) for r in s[i : i + 9])
    assert {r["residue"]: r["n"] for r in df.collect()} == want
    assert "Generate" not in plan(df) and "translate" not in plan(df)


def test_operating_points_order_only_the_rows_of_a_few_propensities(spark, monkeypatch):
    from windloom.operators import metrics

    sizes = []
    whole = metrics.running_sum
    monkeypatch.setattr(metrics, "running_sum", lambda df, *a, **k: sizes.append(df.count()) or whole(df, *a, **k))
    rng = random.Random(9)
    rows = [(i, rng.randrange(50) / 50, rng.random()) for i in range(2000)]
    got = {r["target"]: r for r in metrics.operating_points(spark.createDataFrame(rows, "id long, p double, rank double"), "id", "p", "rank").collect()}
    assert len(got) == 4 and sum(sizes) < 400  # all 2,000 were put in order
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    tp = np.cumsum([r[2] <= 0.5 for r in ordered])
    for t, r in got.items():
        at = int(np.flatnonzero(tp / tp[-1] >= t)[0])
        assert (r["n_flagged"], r["threshold"], r["recall"]) == (at + 1, ordered[at][1], tp[at] / tp[-1])


def test_agreement_takes_one_running_sum_for_all_scores(spark, monkeypatch):
    from windloom.operators import metrics

    calls = []
    whole = metrics.running_sum
    monkeypatch.setattr(metrics, "running_sum", lambda *a, **k: calls.append(a[1]) or whole(*a, **k))
    rng = random.Random(8)
    rows = [(float(rng.randrange(40)), rng.random(), rng.randrange(60) / 10.0) for _ in range(300)] + [(1.0, 2.0, None)]
    got = {r["name"]: r for r in metrics.teacher_agreement(spark.createDataFrame(rows, "a double, b double, rank double"), ["a", "b"], "rank").collect()}
    assert len(calls) == 2  # one for the teacher, one for the scores; there were six
    rank_of = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    t = np.array([r[2] for r in rows[:-1]])
    for i, name in enumerate("ab"):
        v = np.array([r[i] for r in rows[:-1]])
        assert abs(got[name]["spearman"] - np.corrcoef(rank_of(v), rank_of(-t))[0, 1]) < 1e-9
        for label, y in (("strong", t <= 0.5), ("weak", t <= 2)):
            p = y.sum()
            assert abs(got[name][f"{label}_auc"] - (rank_of(v)[y].sum() - p * (p + 1) / 2) / (p * (~y).sum())) < 1e-9
            assert abs(got[name][f"{label}_ap"] - np.mean([y[v >= x].mean() for x in v[y]])) < 1e-9


def test_pool_deals_a_row_for_each_start_and_not_for_each_length(spark):
    from windloom.operators import tile

    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACK") for _ in range(n)) for n in (0, 7, 8, 12, 25, 300)] + ["ACCAAC" * 20, None]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    whole = [s for s in seqs if s]
    want = {s[i : i + k] for s in whole for k in range(8, 19) for i in range(len(s) - k + 1)} | {p for s in whole for p in re.findall("[^KR]*[KR]|[^KR]+$", s) if 8 <= len(p) <= 25}
    got = [r["peptide"] for r in tile.pool(df, *tile.cut_behind("sequence", "KR")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert tile._suffixes(df, "sequence", 8, 18).agg(F.sum("n")).first()[0] == sum(max(0, len(s) - 7) for s in whole)


def test_windows_of_many_lengths_are_counted_by_one_row_for_each_start(spark):
    from windloom.operators import tile

    rng = random.Random(16)
    seqs = ["".join(rng.choice("ACD") for _ in range(n)) for n in (0, 7, 8, 12, 17, 18, 19, 300)] + ["ACCAAC" * 20, None]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    every = {k: [s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1)] for k in range(8, 19)}
    got = tile.length_counts(df)
    assert {r["length"]: (r["n"], r["n_distinct"]) for r in got.collect()} == {k: (len(v), len(set(v))) for k, v in every.items()}
    assert [r["length"] for r in tile.length_counts(df.where("char_length(sequence) < 10")).collect()] == [8]
    assert plan(tile.length_counts(df)).count("Exchange hashpartitioning") == 2


def test_fragments_are_cut_in_one_pass(spark):
    from windloom.operators import tile

    seqs = ["AKCRD", "KK", "ACD", "RAAK", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, None])], "parent int, sequence string")
    want = sorted((i, p) for i, s in enumerate(seqs) for p in re.findall("[^KR]*[KR]|[^KR]+$", s))
    assert sorted((r["parent"], r["piece"]) for r in tile.fragments_behind(df, "KR").collect()) == want
    got = tile.fragments(df.where("sequence <> ''"), tile.cut_behind("sequence", "KR")[0])
    rows = got.orderBy("parent", "fragment").collect()
    assert sorted((r["parent"], r["piece"]) for r in rows) == want
    assert all(seqs[r["parent"]][r["start"] : r["end"]] == r["piece"] for r in rows)
    assert "substr" not in plan(got)  # each piece was looked for from the sequence's beginning on


def test_self_match_cuts_no_text_of_a_document(spark, data, monkeypatch):
    from windloom.operators import tile
    from windloom.plans import stores

    seen = []
    whole = tile.with_flanks
    monkeypatch.setattr(stores.tile, "with_flanks", lambda df, *a, **k: seen.append(df.columns) or whole(df, *a, **k))
    assert stores.QUERIES["self_match"](spark, data).count() > 0 and seen == [["parent", "sequence"]]  # the items alone


def test_an_audit_takes_windows_as_numbers(spark, monkeypatch):
    from windloom.operators import coded, join

    monkeypatch.setattr(coded, "CHUNK", 64)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("ACD") for _ in range(n))
    corpus, samples = [text(rng.randrange(0, 60)) for _ in range(40)] + [None], [text(rng.randrange(0, 40)) for _ in range(30)]
    samples[3] = corpus[5]
    make = lambda x: spark.createDataFrame(list(enumerate(x)), "parent long, sequence string")
    for k in (9, 13):
        held = {s[i : i + k] for s in corpus if s for i in range(len(s) - k + 1)}
        got = {r["parent"]: r for r in join.overlap_audit(make(samples), make(corpus), k=k).collect()}
        for i, s in enumerate(samples):
            own = {s[j : j + k] for j in range(len(s) - k + 1)}
            assert (got[i]["parent_rows"], got[i]["sample_windows"], got[i]["overlapping"]) == (corpus.count(s) + (not s), len(own), len(own & held))
    # A null sequence is an empty one.
    assert sum(r["n"] for r in coded.code_counts(make(corpus)).collect()) == sum(max(0, len(s) - 8) for s in corpus if s)


def test_sequences_of_texts_take_one_pass(spark):
    from windloom.functions.sequence import from_text

    texts = ["", "The Quick Brown fox, JUMPS over 12 lazy dogs!", "bjouxzBJOUXZ", "é ß ſ ı K\nabc-\tDEF", None]
    want = [None if t is None else "".join(c for c in t.upper() if c in "ACDEFGHIKLMNPQRSTVWY") if t.isascii() else "".join(c.upper() for c in t if c.isascii() and c.upper() in "ACDEFGHIKLMNPQRSTVWY") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(from_text(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == want
    assert "translate" not in plan(df)  # a look-up in a map for each letter
