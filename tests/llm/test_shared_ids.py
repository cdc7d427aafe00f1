"""Operator 1 where rows share a doc_id: different texts are documents of their own."""

import hashlib
import random

from windloom.llm import substring_dedup
from windloom.llm.common import words


def test_texts_under_one_id_lose_only_their_own_repeats(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(40), text(40), text(60)
    rows = [(0, a), (1, a), (1, b), (2, c), (3, f"{text(5)} {c} {text(5)}"), (3, f"{c} {text(9)}"), (3, f"{c} {text(9)}"), (4, None), (4, b), (None, a)]
    got = [(r["doc_id"], r["text"], r["d"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), out="d").collect()]
    assert len(got) == len(rows)
    removed = {(d, t): x["n_removed"] for d, t, x in got}
    assert removed[0, a] == 0 and removed[1, a] == 40 and removed[1, b] == 0 and removed[2, c] == 0 and removed[4, b] == 40 and removed[None, a] == 0
    assert removed[rows[4]] == 60 and removed[rows[5]] == 60 and removed[4, None] == 0
    for d, t, x in got:
        w = words(t.encode() if t else None)
        assert x["n_words"] == len(w) and x["kept_sha256"] == hashlib.sha256((x["kept_text"] or "").encode()).hexdigest()
