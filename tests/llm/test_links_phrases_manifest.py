"""Operators 11 to 13 against brute force on small tables, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from windloom.llm import collocations, merkle, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, phrase string, pos int, g string"


def rows_of(texts):
    return [(i, t, "en" if i % 3 else None, f"src{i % 7}", None if t is None else len(t), "a", "b", 1, "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    """Ordinary texts, copies, near copies, null, empty and blank texts, null ids, repeated rows, a long text, clashing columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(120)] + ["ÄÖ", "x.y", "Z;"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [text(rng.randint(1, 90)) for _ in range(50)]
    base = text(300).split()
    for n in range(60):
        w = list(base)
        for _ in range(n % 5):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[2], texts[2].upper(), None, "", " \n\t ", "one", "One two", "a b c d", text(5000), "a\tb. c:d\x0be\x0cf\r\ng"]
    out = rows_of(texts)
    out += [out[4], out[4], (None, texts[60], None, None, None, None, None, None, None), (3, texts[70], "en", None, 9, "a", "b", 1, "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11 --------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split() if (text or "").isascii() else [w.translate(simhash.LOWER) for w in (text or "").encode().split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fps, near):
    """fps: {fingerprint: smallest id}; component by fingerprint."""
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= near:
            up[top(a)] = top(b)
    least = {}
    for f, d in fps.items():
        least[top(f)] = min(d, least.get(top(f), d))
    return {f: least[top(f)] for f in fps}


def brute_links(rows, near=4):
    fps = {}
    for r in rows:
        if r[0] is not None:
            f = slow_fingerprint(r[1])
            fps[f] = min(r[0], fps.get(f, r[0]))
    of = slow_components(fps, near)
    return sorted((r[0], f"{(f := slow_fingerprint(r[1])):016x}", None if r[0] is None else of[f]) for r in rows if r[0] is not None), [f"{slow_fingerprint(r[1]):016x}" for r in rows if r[0] is None]


def test_simhash_links_equal_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    want, without_id = brute_links(rows)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is None] == [(f, None) for f in without_id]
    assert len({c for *_, c in want}) < len(want) - 10


@pytest.mark.parametrize("near", [1, 4, 7])
def test_no_link_is_lost_where_buckets_are_dealt_anew(spark, monkeypatch, near):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rng = random.Random(near)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0: 0}
    for i in range(1, 260):
        f = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 2 * near)):
            f ^= 1 << b
        fps.setdefault(f, i)
    ring = simhash.Ring(near)
    classes = spark.createDataFrame([(simhash.signed(f), d, 1) for f, d in fps.items()], "fp long, first long, copies long").cache()
    labels = simhash.connected_components(simhash.hub_links(classes, ring)).cache()
    first = {r["id"]: r["component"] for r in labels.collect()}
    up = {r["id"]: r["component"] for r in simhash.connected_components(simhash.cross_links(classes, labels, ring)).collect()}
    label = {f: (lambda x: up.get(x, x))(first.get(simhash.signed(f), simhash.signed(f))) for f in fps}
    want = slow_components(fps, near)
    assert {frozenset(f for f in fps if label[f] == x) for x in set(label.values())} == {frozenset(f for f in fps if want[f] == x) for x in set(want.values())}


def test_every_pair_within_the_bound_has_a_viable_chain_and_a_bucket():
    rng = random.Random(9)
    for near in (1, 2, 4, 6):
        ring = simhash.Ring(near)
        for _ in range(400):
            x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, near)))
            starts = [s for s in range(ring.n) if all((x & ring.chain(s, n)).bit_count() <= ring.budget(n) for n in range(1, ring.n + 1))]
            assert starts
            for level in ring.levels:
                assert any(s in starts and not x & mask for s, mask in level)


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_counts_long_texts_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(900)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(text) == whole


# ---- 12 --------------------------------------------------------------------------------------


def brute_collocations(rows, least, top=2000, longest=5, cover=100):
    n, f = Counter(), Counter()
    for r in rows:
        lang = r[2] or "und"
        low = re.sub(b"[A-Z]", lambda m: m.group().lower(), (r[1] or "").encode())
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(x == lang and len(v) > len(w) and b >= least and 100 * b >= cover * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (x, v), b in f.items())
        if not inside:
            out.append((lang, b" ".join(w).decode(), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted(out, key=lambda x: (x[0], -x[-1], -x[2], x[1].encode()))


@pytest.mark.parametrize(("least", "cover"), [(12, 100), (8, 70)])
def test_collocations_equal_brute_force(docs, rows, monkeypatch, least, cover):
    monkeypatch.setattr(collocations, "FLUSH", 3000)
    found = collocations.best(collocations.collocations(docs, least=least, cover=cover))
    got = [tuple(r) for r in found.orderBy("grp", "rank").select("grp", "phrase", "a", "l", "r", "n", "score").collect()]
    want = brute_collocations(rows, least, cover=cover)
    assert got == want and len(got) > 20


def test_no_phrase_is_missed_when_the_bit_table_is_full(docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "bit_table", lambda frequent, k: b"\xff" * (1 << (collocations.BITS - 3)))
    got = {(r["grp"], r["phrase"], r["a"]) for r in collocations.collocations(docs, least=12).collect()}
    assert got == {x[:3] for x in brute_collocations(rows, 12)}


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(3_000_000_000_001, 90_000_000_000_007, 3_000_000_000_019, 4_000_000_000_003), (100, 10**14, 100, 100), (7, 9, 8, 63)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.floored(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in cases]


def test_collocations_without_groups_and_top(docs, rows):
    found = collocations.best(collocations.collocations(docs, group_col=None, least=12), top=3).collect()
    want = brute_collocations([(*r[:2], None, *r[3:]) for r in rows], 12)[:3]
    assert [(r["grp"], r["phrase"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(w[0], w[1], w[-1]) for w in want]


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).count() == 0


# ---- 13 --------------------------------------------------------------------------------------


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1]))


def slow_tree(nodes, fanout):
    """Levels and, for each leaf, its steps (before, after)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(now[i : i + fanout]) for i in range(0, len(now), fanout)])
    steps = []
    for i in range(len(nodes)):
        own, at = [], i
        for now in levels[:-1]:
            lo = at - at % fanout
            own.append((now[lo:at], now[at + 1 : lo + fanout]))
            at //= fanout
        steps.append(own)
    return levels[-1][0], steps


def brute_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[2] is None else "1" + r[2], []).append(r)
    names = sorted(groups, key=str.encode)
    trees = {}
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r)))
        trees[g] = (ordered, *slow_tree([slow_leaf(r) for r in ordered], fanout))
    root, tops = slow_tree([trees[g][1] for g in names], fanout)
    out = []
    for g, top in zip(names, tops, strict=True):
        ordered, subroot, steps = trees[g]
        for r, own in zip(ordered, steps, strict=True):
            way = own + top
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = slow_leaf(r, 1 if touched else 0)
            for before, after in way:
                h = H([*before, h, *after])
            out.append((r[0], slow_leaf(r), subroot, root, H(d for b, a in way for d in (*b, *a)), h, h == root))
    return sorted(out, key=str)


def digest(df, fanout=2, block=4096):
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(df, {"n_chars": F.col("n_chars") + 1}, touched, fanout=fanout, block=block)
    return sorted((tuple(r) for r in found.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize(("fanout", "block"), [(2, 1), (2, 4096), (3, 3), (5, 30)])
def test_manifest_equals_brute_force(docs, rows, fanout, block):
    want = brute_manifest(rows, fanout)
    assert digest(docs, fanout, block) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


@pytest.mark.parametrize("n", [1, 3, 17])
def test_manifest_of_short_groups(spark, rows, n):
    some = [r for r in rows if r[0] is not None][:n]
    assert digest(spark.createDataFrame(some, SCHEMA), block=2) == brute_manifest(some)


def test_proofs_lead_from_leaf_to_root(docs):
    for r in merkle.manifest(docs, block=8).limit(20).collect():
        h = r["leaf"]
        for step in r["proof"]:
            h = H([*step["left"], h, *step["right"]])
        assert h == r["root"] == r["folded_root"] and r["verified"]


def test_manifest_of_nothing(empty):
    assert merkle.manifest(empty).count() == 0


def test_the_three_queries_on_the_given_tables(spark, data):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_simhash(spark, data).drop("kept").collect())) == brute_links(docs)[0]
    found = queries.op12_collocations(spark, data).orderBy("lang", "rank").collect()
    assert [(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found] == brute_collocations(docs, 100)
    got = sorted((tuple(r) for r in queries.op13_merkle(spark, data).collect()), key=str)
    assert got == brute_manifest(docs)
