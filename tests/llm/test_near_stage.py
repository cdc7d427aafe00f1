"""The pipeline's near-duplicate stage: a likeness of 0.8 at five words."""

import random
from math import comb

import corpus_pipeline
from windloom.llm import near_dedup
from windloom.llm.common import LOWER


def brute_kept(rows, rules):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for shingle, percent in rules:
        sets = {}
        for d, t in rows:
            w = (t or "").encode().translate(LOWER).split()
            sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
        ids = sorted(sets)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d for d, _ in rows if find(d) == d}


def test_near_stage_takes_copies_of_four_fifths(spark):
    rng, rows = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    for i in range(60):
        text = [word() for _ in range(rng.choice([24, 60, 200, 600]))]
        # A tail of 10 to 34 in a hundred: likeness from 0.75 to 0.91, on both sides of the rule.
        tail = [word() for _ in range(len(text) * rng.randint(10, 34) // 100)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + tail))]
    for i in range(20):  # short copies with one changed word
        text = [word() for _ in range(45)]
        rows += [(200 + 2 * i, " ".join(text)), (201 + 2 * i, " ".join([*text[:20], word(), *text[21:]]))]
    rows += [(900, "a b c d"), (901, "A b c d"), (902, "a b c e"), (903, ""), (904, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()]
    want = brute_kept(rows, [(5, 80)])
    assert sorted(got) == sorted(want)
    # The rows tell the rule from that of operator 7 in both directions.
    other = brute_kept(rows, [(3, 85)])
    assert want - other and other - want
    both = near_dedup.near_duplicates(docs, rules=[(3, 85), (5, 80)]).where("kept").collect()
    assert {r["doc_id"] for r in both} == brute_kept(rows, [(3, 85), (5, 80)])


def test_shared_values_follow_from_the_likeness():
    tail = lambda p, t: sum(comb(near_dedup.K, i) * p**i * (1 - p) ** (near_dedup.K - i) for i in range(t))
    assert near_dedup.least_shared(85) == 16 and near_dedup.least_shared(80) == 13
    for percent in (50, 80, 85, 95):
        t = near_dedup.least_shared(percent)
        assert tail(percent / 100, t) <= near_dedup.MISS < tail(percent / 100, t + 1)
