"""The text operators against brute force on small tables, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.llm import chat, decontaminate, fingerprint, labelled, line_dedup, near_dedup, packing, quality, queries, rans, substring_dedup, token_store, toxicity
from windloom.llm.common import LOWER, WordHash, grams, hash_words, sliding_min

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, part int, contamination string, dedup string"


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"src{i % 7}", None if t is None else len(t), 1, 2, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def mixed(spark):
    """Ordinary texts with copies and near copies, and odd rows: null, empty and blank texts, null ids and sources, repeated rows, one long text, clashing columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["ÄÖ", "Über", "x,y."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    texts = [text(rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " end", text(30) + " " + passage + " " + text(20), text(10) + "\n" + passage, "Orre " * 90, text(4000)]
    base = text(140).split()
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "one two"]
    rows = rows_of(texts)
    rows += [rows[4], rows[4], (None, "no id here", None, None, None, None, None, None, None), (900, "no source", "en", None, 9, 1, 2, "x", "y")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, mixed):
    return spark.createDataFrame(mixed, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 ---------------------------------------------------------------------------------------


def brute_repeats(rows, window=20):
    first = {}
    for d, t in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, t in ((r[0], r[1] or "") for r in rows):
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_is_exact(docs, mixed):
    found = substring_dedup.remove_repeats(docs)
    assert found.columns == [*[c for c in docs.columns if c != "dedup"], "dedup"]
    got = found.select("doc_id", "dedup.*").collect()
    want = brute_repeats(mixed)
    assert len(got) == len(mixed)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert any(r["n_removed"] for r in got)


def test_a_passage_in_every_document_spreads(spark, monkeypatch):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(45)]
    rows = [(d, " ".join([*(f"a{rng.randrange(900)}" for _ in range(30)), *passage, *(f"b{rng.randrange(900)}" for _ in range(30))])) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    common = substring_dedup.common_grams(docs, 300, "text")
    assert len(common) >= 42
    h = np.array([hash(("w", i)) % (1 << 64) for i in range(20)], np.uint64)
    g = grams(h, 4)
    top = substring_dedup.ordered(g, np.sort(g[:3] >> np.uint64(1)))
    assert (top[:3] >= 1 << 63).all() and (top[3:] < 1 << 63).all()
    want = brute_repeats(rows)
    for r in substring_dedup.remove_repeats(docs, keep=["doc_id"], out="d").select("doc_id", "d.*").collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    # However many documents have it, a task sends each string of the passage once.
    buckets = Counter()
    for r in substring_dedup.packed(docs.coalesce(1), "doc_id", "text", 64, 20, common).where("not later").collect():
        buckets[r["bucket"]] += len(substring_dedup.unpack(r["blob"], substring_dedup.Codes())[1])
    assert max(buckets.values()) < 0.1 * sum(buckets.values())


def test_substring_dedup_with_clashing_names(docs, mixed):
    more = docs.withColumn("range_doc", F.lit(1)).withColumn("ranges", F.lit(2)).withColumn("lo", F.lit(3))
    got = substring_dedup.remove_repeats(more)
    assert got.columns == [*[c for c in more.columns if c != "dedup"], "dedup"] and got.where("range_doc = 1 and ranges = 2 and lo = 3").count() == len(mixed)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_super_kmers_cover_every_window_once():
    tokens = [str(i % 37).encode() for i in range(1500)]
    h = hash_words(WordHash(), tokens)
    start, n, least, doc = substring_dedup.super_kmers(h, np.array([0, 700]), np.array([700, 800]))
    covered = [s + j for s, c in zip(start, n, strict=True) for j in range(c)]
    assert covered == [*range(0, 681), *range(700, 1481)]
    assert n.max() <= substring_dedup.LONGEST and set(doc) == {0, 1} and len(least) == len(n)


def test_keys_that_agree_by_chance_do_not_merge(monkeypatch):
    a = [b"a%d" % i for i in range(25)]
    b = [b"b%d" % i for i in range(25)]
    blobs = []
    for doc, w in ((1, a), (2, b), (3, a)):
        codes = list(dict.fromkeys(w))
        blobs.append(substring_dedup.pack(codes, np.arange(25), np.array([25]), np.array([1]), np.array([doc]), np.array([0])))
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda h, w: np.zeros(len(h) - w + 1, np.uint64))
    doc, start, n = substring_dedup.repeats(blobs)
    assert sorted(zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)) == [(3, 0, 6)]


# ---- 2 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    menu, foot = "menu of the site with many links in it", "all rights reserved by the owner of this"
    rows = []
    for i in range(40):
        lines = [menu] if i % 2 else []
        lines += [f"an own line of document number {i} that is long enough", "short"]
        lines += [f"  {foot}\t"] if i < 3 else []
        rows.append((i, "\n".join(lines), f"site{i % 12}"))
    rows += [(100, None, "site1"), (101, "", None), (None, menu, "site2"), (3, rows[3][1], "site3"), (102, menu + "\n\n" + menu, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_line_dedup_keeps_the_first_document(pages):
    got = {(r["doc_id"], r["text"]): r["n"] for r in line_dedup.remove_boilerplate(pages, n_removed="n").collect()}
    by_id = {}
    for (d, t), n in got.items():
        by_id.setdefault(d, []).append((t, n))
    assert by_id[1][0][0].startswith("menu") and by_id[1][0][1] == 0
    assert all("menu" not in t for d in range(5, 40, 2) for t, _ in by_id[d])
    assert all("rights" in by_id[i][0][0] for i in range(3))  # three sites are not enough
    assert by_id[100] == [(None, 0)] and by_id[101] == [("", 0)] and by_id[None] == [("", 1)]
    assert by_id[102] == [("", 2)]  # the blank line between them stays


def test_line_dedup_with_clashing_names(pages):
    more = pages.withColumn("line_doc", F.lit(1)).withColumn("line_gone", F.lit(2)).withColumn("h", F.lit(3)).withColumn("first_doc", F.lit(4))
    got = line_dedup.remove_boilerplate(more, n_removed="n")
    assert got.columns == [*more.columns, "n"]
    plain = line_dedup.remove_boilerplate(pages, n_removed="n").collect()
    assert Counter((r["doc_id"], r["text"], r["n"]) for r in got.collect()) == Counter((r["doc_id"], r["text"], r["n"]) for r in plain)


def test_a_long_text_of_many_lines(spark):
    rows = [(i, "\n".join(f"shared line {j % 500}" for j in range(20_000)), f"s{i}") for i in range(6)]
    got = {r["doc_id"]: r["n"] for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_chars=1, n_removed="n").collect()}
    assert got == {0: 0} | {i: 20_000 for i in range(1, 6)}


def test_line_dedup_of_nothing(pages):
    assert line_dedup.remove_boilerplate(pages.where("false")).count() == 0


def test_line_dedup_runs_no_python(pages):
    plan = line_dedup.remove_boilerplate(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


# ---- 3 ---------------------------------------------------------------------------------------


def test_tree_paths_are_ranked_and_round_trip(spark):
    rows = [
        ("c", 1, None, 0.0, "user", "root"), ("c", 2, 1, 0.9, "assistant", "a </turn> \\ <turn>"), ("c", 3, 1, 0.1, "assistant", "b"), ("c", 4, 2, 0.5, "user", None), ("c", 5, 3, 0.2, "user", "x"),
        ("d", 1, 9, 0.3, "user", "orphan"), (None, 1, None, 0.0, None, "n"), ("e", 1, 2, 0.0, "user", "loop"), ("e", 2, 1, 0.0, "user", "loop"), ("c", 4, 2, 0.5, "user", None),
    ]
    nodes = spark.createDataFrame(rows, "conv string, node long, parent long, score double, role string, text string")
    got = {(r["conv_id"], r["path_rank"]): r for r in chat.format_paths(nodes, best=2).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(got) == {("c", 1), ("c", 2), ("d", 1), (None, 1)}
    assert [tuple(t) for t in got["c", 1]["turns"]] == [("user", "root"), ("assistant", "a </turn> \\ <turn>"), ("user", "")]
    assert got["c", 1]["loss"] == "a </turn> \\ <turn>" and got["c", 2]["loss"] == "b"
    assert [tuple(t) for t in got[None, 1]["turns"]] == [("", "n")]


def test_long_conversation(spark):
    rows = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = chat.format_paths(chat.linear(rows)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert [t["text"] for t in got[0]["turns"]] == [f"t{i}" for i in range(300)]
    assert chat.format_paths(chat.linear(rows.where("false"))).count() == 0


# ---- 4 and 10 --------------------------------------------------------------------------------


def test_fold():
    assert toxicity.fold("You are an  1d10t,\nсlown $cum 2010") == "you are an idiot, clown scum 2010"


def test_matches_respect_words_stems_and_exceptions():
    m = toxicity.Matcher(toxicity.Lexicon({"moron": 2.0, "lowei*": 1.0, "lowei": 1.5}, ["moron valley"]))
    assert m.sum_of("a moron")[0] == 2.0
    assert m.sum_of("oxymoron moronic")[0] == 0
    assert m.sum_of("the moron valley")[0] == 0
    assert m.sum_of("loweisp xlowei")[0] == 1.5
    assert m.sum_of("") == (0.0, [])


def naive_matches(text, lexicon):
    """The matches that count, by trying every word start with every term."""
    is_word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    at = {}
    for i in range(len(text)):
        if is_word(i - 1):
            continue
        for term, weight in lexicon.weights.items():
            plain = term.rstrip("*")
            if text.startswith(plain, i) and (term.endswith("*") or not is_word(i + len(plain))) and len(plain) >= at.get(i, (0, 0))[0]:
                at[i] = (len(plain), max(weight, at[i][1] if i in at and at[i][0] == len(plain) else 0))
    spared = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(text)) if text.startswith(p, i) and not is_word(i - 1) and not is_word(i + len(p))]
    kept = [(i, i + n, w) for i, (n, w) in at.items() if not any(a <= i and i + n <= b for a, b in spared)]
    return round(sum(w for _, _, w in kept), 9), sorted((a, b) for a, b, _ in kept)


def test_matches_equal_naive_matching():
    rng = random.Random(9)
    lexicon = toxicity.Lexicon({"ab": 1.5, "abc*": 2.0, "ba": 0.5, "cab*": 1.0, "b*": 0.25, "abca": 3.0}, ["ab ba", "c ab ba", "cab c", "b a"])
    matcher = toxicity.Matcher(lexicon)
    for _ in range(400):
        text = "".join(rng.choice("abc  _.") for _ in range(rng.randint(0, 80)))
        total, at = matcher.sum_of(text)
        assert (round(total, 9), sorted(at)) == naive_matches(text, lexicon), text
    long = "ab ba " * 30_000
    assert matcher.sum_of(long)[0] == 0.5 * 0  # every match stands in a phrase


def test_term_counts_equal_a_count_by_hand(spark):
    texts = [("idiots are idle", 1), ("An idiot idles; idler idiot", 1), ("nice day", 0), ("", 0), ("idle nice", 0)]
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc long, text string, label int")
    got = {r["term"]: (r["toxic"], r["clean"]) for r in toxicity._document_counts(sample).collect()}
    want = {}
    for t, y in texts:
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        seen = Counter(p for w in set(words) for p in {w[:k] + "*" for k in range(3, min(len(w), 11))})
        for term in {*words, *seen, *(p + "2" for p in seen if sum(w.startswith(p[:-1]) and len(w) > len(p) - 1 for w in words) > 1)}:
            a, b = want.get(term, (0, 0))
            want[term] = (a + (y > 0), b + (y == 0))
    assert got == want


def test_ftrl_equals_a_scalar_version():
    rng = random.Random(6)
    rows = [(np.array([rng.randrange(40) for _ in range(rng.randint(0, 12))], np.int64), rng.randrange(2)) for _ in range(60)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for f, y in rows:
            x = {i: c * quality.SCALE / max(1, len(f)) for i, c in Counter(f.tolist()).items()} | {quality.D: 1.0}
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g, w = (p - y) * v, weight(i)
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
    got = quality.ftrl(rows, 3)
    want = np.zeros(quality.D + 1)
    for i in z:
        want[i] = weight(i)
    assert np.abs(got - want).max() < 1e-9 and np.abs(want).max() > 0.01


def test_quality_score_is_a_dot_product(spark):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=quality.D + 1).astype(np.float32)
    texts = ["A few Words, 12 words words!", None, "", "x " * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    for r in quality.score(docs, weights, out="s").collect():
        f = quality.features((r["text"] or "").encode(), quality.Tokens())
        dot = sum(float(weights[i]) * c * quality.SCALE / len(f) for i, c in Counter(f.tolist()).items()) + float(weights[quality.D])
        assert abs(r["s"]["score"] - 1 / (1 + np.exp(-dot))) < 1e-6 and r["quality"] == 1
    assert quality.score(docs.where("false"), weights).count() == 0


def test_conflicting_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(12)] + [(3, "another"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(4, 0), (3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc"]: (r["text"], r["label"]) for r in labelled.training_rows(docs, labels, "toxic").collect()}
    usable = {d for d in range(12) if zlib.crc32(str(d).encode()) % 4 != 2 and d != 4}
    assert set(got) == usable and (3 not in usable or got[3] == ("another", 1))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    syllables = ["an", "er", "th", "re", "on", "ti", "ed", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(30, 150))]
        toxic, good = int(i % 6 == 0), int(i % 5 != 0)
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "zorgan" + word(), "zorgin" + word()]))
        if not good:
            w = [x + rng.choice(["%%%", "$$$", "***"]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, toxic, good))
    rows += [(1000, None), (1001, ""), (None, "idiot")]
    labels += [(1000, None, 1), (5, 0, 1), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def accuracy(scored, labels, column, at):
    both = scored.where(labelled.held_out(F.col("doc_id"))).join(labels.dropDuplicates(["doc_id"]), "doc_id").select((F.col("s.score") >= at).cast("int").alias("p"), column).where(f"{column} is not null").collect()
    return sum(r[0] == r[1] for r in both) / len(both)


def test_toxicity_on_rows_it_has_not_seen(judged):
    docs, labels = judged
    lexicon = toxicity.learn(labelled.training_rows(docs, labels, "toxic"))
    assert "moron" in lexicon.weights and any(t.startswith("zorg") for t in lexicon.weights)
    scored = toxicity.matched(docs, lexicon, out="s")
    assert accuracy(scored, labels, "toxic", 0.3) > 0.97
    assert {r["doc_id"]: r["s"]["score"] for r in scored.where("doc_id >= 1000").collect()} == {1000: 0.0, 1001: 0.0}
    assert toxicity.matched(docs.where("false"), lexicon).count() == 0
    assert toxicity.learn(labelled.training_rows(docs, labels.where("false"), "toxic")).weights == {}


def test_quality_on_rows_it_has_not_seen(judged):
    docs, labels = judged
    weights = quality.train(labelled.training_rows(docs, labels, "quality"))
    scored = quality.score(docs, weights, out="s")
    assert accuracy(scored, labels, "quality", 0.7) > 0.95
    assert scored.where("s.score is null or s.score < 0 or s.score > 1").count() == 0
    assert not quality.train(labelled.training_rows(docs, labels.where("false"), "quality")).any()


def test_held_out_labels_are_not_read(judged):
    docs, labels = judged
    assert labelled.training_rows(docs, labels, "toxic").where(labelled.held_out(F.col("doc"))).count() == 0
    assert {d for d in range(50) if zlib.crc32(str(d).encode()) % 4 == 2} == {r[0] for r in docs.where(labelled.held_out(F.col("doc_id")) & (F.col("doc_id") < 50)).select("doc_id").collect()}


# ---- 5 ---------------------------------------------------------------------------------------


def check_bins(placed, sizes, capacity, limit):
    bins = {}
    for r in placed:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in rows:
            assert r["bin_offset"] == at
            at += r["n_words"]
        assert at <= capacity
        clusters = [sizes[r["doc_id"]][1] for r in rows]
        assert len(set(clusters)) == len(clusters)
        assert max(Counter(sizes[r["doc_id"]][2] for r in rows).values()) <= limit
    return bins


def test_packing_keeps_its_constraints(spark):
    rng = random.Random(1)
    texts = [" ".join("w%d" % rng.randrange(999) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    texts += [texts[0]] * 30 + [None, "", " ".join("x" for _ in range(500))]
    rows = [(i, t, f"s{0 if rng.random() < 0.4 else rng.randrange(5)}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = packing.best_fit(docs, capacity=100, group_words=5000).collect()
    sizes = {i: (len((t or "").split()), t, s) for i, t, s in rows}
    bins = check_bins(placed, sizes, 100, packing.SOURCE_LIMIT)
    total = Counter()
    for r in placed:
        total[r["doc_id"]] += r["n_words"]
    assert {d: n for d, n in total.items()} == {i: n for i, (n, _, _) in sizes.items()}
    assert len(bins) < 1.5 * sum(n for n, _, _ in sizes.values()) / 100 + 40
    assert packing.best_fit(docs.where("false")).count() == 0


def test_packing_of_repeated_and_null_ids(spark):
    full, part = " ".join(["x"] * 100), " ".join(["y"] * 40)
    rows = [(1, full, "a", 1)] * 2 + [(None, full, None, 2)] * 3 + [(1, part, "a", 3)] * 5 + [(None, part, None, 4)] * 5 + [(None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    placed = packing.best_fit(docs, capacity=100, group_words=200).collect()
    assert len(placed) == len(rows) and len({r["row"] for r in placed}) == len(rows)
    bins = {}
    for r in placed:
        bins.setdefault(r["bin_id"], []).append(r)
    assert len(bins.pop(None)) == 2
    for inside in bins.values():  # equal texts never share a bin
        assert len(inside) == 1 and inside[0]["bin_offset"] == 0


def naive_best_fit(pieces, capacity, limit):
    """Of all bins without conflict that have room, the fullest one, the oldest of equally full ones."""
    bins, out = [], []
    for size, cluster, source in pieces:
        fits = [(capacity - sum(s for s, _, _ in b) - size, i) for i, b in enumerate(bins) if sum(s for s, _, _ in b) + size <= capacity and cluster not in [c for _, c, _ in b] and [s for _, _, s in b].count(source) < limit]
        at = min(fits)[1] if fits else len(bins)
        if at == len(bins):
            bins.append([])
        out.append((at, sum(s for s, _, _ in bins[at])))
        bins[at].append((size, cluster, source))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit(seed):
    rng = random.Random(seed)
    pieces = sorted(((rng.randint(1, 60), b"%d" % rng.randrange(150), f"s{rng.randrange(9)}") for _ in range(300)), key=lambda p: -p[0])
    assert packing.pack_group(pieces, 100, 2) == naive_best_fit(pieces, 100, 2)


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10, 9)
    assert bins.place(7, 1, 1)[0] == 0 and bins.place(8, 2, 1)[0] == 1
    assert bins.place(2, 2, 1) == (0, 7)  # bin 1 is tighter, but holds the cluster
    assert bins.place(2, 4, 1) == (1, 8)


# ---- 6 ---------------------------------------------------------------------------------------


def brute_contamination(text, items, window=13):
    w = decontaminate.normal_words(text.encode() if text else None)
    hit, ids = [False] * len(w), set()
    for item, t in items:
        iw = decontaminate.normal_words(t.encode() if t else None)
        n = min(window, len(iw))
        for a in range(len(iw) - n + 1 if iw else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == iw[a : a + n]:
                    hit[b : b + n] = [True] * n
                    ids.add(item)
    return len(w), sum(hit), sorted(ids)


@pytest.mark.parametrize(("item_bytes", "sent_bytes"), [(1 << 20, 64 << 20), (100, 64 << 20), (100, 150)])
def test_decontamination(spark, docs, mixed, item_bytes, sent_bytes):
    pool = [r[1] for r in mixed if r[1] and len(r[1].split()) > 25]
    items = [(1, " ".join(pool[0].split()[3:20])), (2, "ONE, two!"), (3, pool[5].upper() + " tail"), (4, None), (5, "..."), (1, " ".join(pool[2].split()[:14]))]
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string")
    docs = docs.withColumn("handed", F.lit(1)).withColumn("contamination__handed", F.lit(2))
    found = decontaminate.contamination(docs, bench, item_bytes=item_bytes, sent_bytes=sent_bytes)
    got = found.select("doc_id", "text", "contamination").collect()
    assert found.columns[-1] == "contamination" and len(got) == len(mixed)
    for r in got:
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], list(c["item_ids"])) == brute_contamination(r["text"], items), r["doc_id"]
        spans = [r["text"][s["start"] : s["end"]] for s in c["spans"]]
        assert sum(len(decontaminate.normal_words(s.encode())) for s in spans) == c["n_hit"]
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


def test_codes_of_many_words_are_aligned():
    words = [b"w%d" % i for i in range(40_000)]
    items = [(i, b" ".join(words[i * 20 : i * 20 + 20])) for i in range(2000)]
    scanner = decontaminate.Scanner(items, 13)
    assert scanner.width == 3 and len(set(scanner.codes.values())) == 40_000
    rng = random.Random(4)
    for _ in range(200):
        i = rng.randrange(2000)
        line = [rng.choice([b"x", rng.choice(words)]) for _ in range(30)] + words[i * 20 + 3 : i * 20 + 18] + [b"y"]
        assert scanner.scan(line)[1] == {i} and decontaminate.merged(scanner.scan(line)[0]) == [(30, 45)]


def test_decontamination_without_items(docs, spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.contamination(docs, bench.where("false")).where("contamination.n_hit > 0").count() == 0


# ---- 7 ---------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for d, t in ((r[0], r[1]) for r in rows if r[0] is not None):
        w = (t or "").encode().translate(LOWER).split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(docs, mixed, empty):
    want = brute_components(mixed)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(mixed)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({c for _, c in want.values()}) < len(want) - 10
    assert near_dedup.near_duplicates(empty).count() == 0


def test_a_chain_of_near_duplicates_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 3 : i * 3 + 100]) for i in range(40)]  # neighbours alike, ends not
    random.Random(2).shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in want.items()}


def test_union_sketch_estimate():
    rng = np.random.default_rng(0)
    errors = []
    for j in (0.5, 0.85, 0.95):
        n = 2000
        both = rng.integers(-(2**62), 2**62, int(n * j))
        left, right = np.array_split(rng.integers(-(2**62), 2**62, n - len(both)), 2)
        a, b = np.unique(np.append(both, left)), np.unique(np.append(both, right))
        errors.append(abs(near_dedup.estimate(a, b) - len(both) / n))
    assert max(errors) < 0.3 and near_dedup.estimate(a, a) == 1.0


# ---- 8 ---------------------------------------------------------------------------------------


def test_winnowing_picks_the_rightmost_least_hash_of_each_window():
    text = "the quick brown fox jumps over the lazy dog and runs away from the quick brown fox " * 3
    cp = fingerprint.points(text)
    hashes, positions = fingerprint.winnow(cp)
    n = len(cp) - fingerprint.GRAM + 1
    every = {}
    for i in range(n):
        every[i] = int(fingerprint.winnow(cp[i : i + fingerprint.GRAM])[0][0])  # one gram alone
    want = sorted({max((p for p in range(s, s + fingerprint.WINDOW)), key=lambda p: (-every[p], p)) for s in range(n - fingerprint.WINDOW + 1)})
    assert positions.tolist() == want and hashes.tolist() == [every[p] for p in want]


def test_match_guarantee():
    rng = random.Random(0)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(30):
        shared = noise(fingerprint.GRAM + fingerprint.WINDOW - 1)
        a, b = (fingerprint.winnow(fingerprint.points(noise(200) + shared + noise(200)))[0] for _ in range(2))
        assert set(a.tolist()) & set(b.tolist())


def test_neighbours(spark):
    texts = ["alpha " * 30, "Äé " * 50, None, "", "x", "alpha " * 30, "long text " * 4000]
    rows = [(i * 10, t) for i, t in enumerate(texts)] + [(None, "first of all"), (0, "alpha " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprint.compare_neighbours(docs).collect()
    order = sorted(((-1 if d is None else d), t or "") for d, t in rows)
    want = Counter()
    for (d, a), (_, b) in zip(order, [*order[1:], order[0]], strict=True):
        want[None if d < 0 else d, len(a), hashlib.sha256(fingerprint.edited(a, b).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    texts_of = {}
    for (d, a), (_, b) in zip(order, [*order[1:], order[0]], strict=True):
        texts_of.setdefault((None if d < 0 else d, hashlib.sha256(fingerprint.edited(a, b).encode()).hexdigest()), (a, b))
    for r in got:  # likeness and fingerprints from chosen hashes, counted by hand
        a, b = texts_of[r["doc_id"], r["edited_sha256"]]
        x, y, z = (Counter(fingerprint.winnow(fingerprint.points(t))[0].tolist()) for t in (a, fingerprint.edited(a, b), b))
        alike = lambda p, q: sum((p & q).values()) / sum((p | q).values()) if p or q else 1.0
        assert (r["near_edited"], r["near_next"]) == (alike(x, y), alike(x, z))
        hashes, places = fingerprint.winnow(fingerprint.points(a))
        assert r["fingerprint"] == "".join(f"{h:08x}" for h in hashes.tolist()) and r["positions"] == places.tolist()
    same = {r["fingerprint"] for r in got if r["doc_id"] in (0, 50)}
    assert len(same) == 1 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprint.compare_neighbours(docs.where("false")).count() == 0


# ---- 9 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 600_000])
def test_range_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 40_000).astype(np.uint16)
    counts = np.bincount(ids, minlength=49_408)
    counts[1] += 1
    freq = rans.table(counts)
    assert int(freq.sum()).bit_count() == 1 and (freq[counts > 0] > 0).all()
    coder = rans.Coder(freq)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    for a, b in [(0, 0), (n // 2, n // 2 + 1), (n // 3, n - 1), (n - 1, n), (0, n // 2)]:  # from a checkpoint on
        assert coder.decode(block, max(0, a), b).tolist() == ids[max(0, a) : b].tolist()
    if n > 5000:
        broken = bytearray(block)
        broken[-5] ^= 64
        with pytest.raises((ValueError, IndexError)):
            coder.decode(bytes(broken))


def test_token_store_equals_the_library(spark, docs, mixed, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    hard = spark.createDataFrame([(5000, "İstanbul. foo'S don't <|endoftext|> ΟΔΟΣ. é. ﬁ. Å. ́ x ́. 12a. «é».")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(hard)
    got = token_store.read(token_store.write(both, path)).collect()
    rows = [(r[0], r[1]) for r in mixed] + [(5000, hard.first()["text"])]
    coded = []
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        coded.append((-1 if d is None else d, ids.astype("<u2").tobytes(), ids))
    at, want = 0, Counter()
    for d, _, ids in sorted(coded, key=lambda x: x[:2]):
        want[None if d < 0 else d, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in got) == want
    store = token_store.write(both, path)
    some = spark.createDataFrame([(3,), (66,), (None,), (77777,), (3,)], "doc_id long")
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["ids"]) for r in token_store.documents(store, some).collect()) == sorted((d, ids.tolist()) for d, _, ids in coded if d in (3, 66, -1))
    store = token_store.write(empty, path)
    assert token_store.read(store).count() == 0 and token_store.documents(store, some).count() == 0


def test_every_kind_of_run_gets_the_ids_of_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(8)
    hard = [None, "", "a'b 'tis x.y it's. don't, '' a\u00a0b\u2003c \x1c z\x00q A\u030aB", "e\u0301 .\u0301", "\u0130 \u03a3\u03a3 \u0374 \ufb01 \u1e9e"]
    hard += ["".join(rng.choice("aAbZ .,'\n\t12\u00e9\u0301<|>\u03a3\u00df\u0431\u4e2d") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encode, tok = token_store.Encoder(path, "<u2"), Tokenizer.from_file(path)
        assert encode.by_run == name.startswith("word")
        ids, sizes = encode(pa.array(hard))
        assert np.split(ids, np.cumsum(sizes))[-1].size == 0
        for text, got in zip(hard, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


# ---- shared ----------------------------------------------------------------------------------


def test_sliding_min_and_grams():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for w in range(1, 8):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w].tolist()) for i in range(len(x) - w + 1)]
    assert len(grams(x, 9)) == 0 and len(set(grams(np.array([1, 2, 1, 2, 1], np.uint64), 2).tolist())) == 2


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
