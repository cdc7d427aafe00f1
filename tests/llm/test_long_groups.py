"""Long texts and hot groups take time in proportion: lines of a text, pieces of a source, copies of a cluster."""

import random
import time
from bisect import bisect_left, insort

import pytest

from windloom.llm import line_dedup, packing


def test_texts_of_twenty_thousand_shared_lines(spark):
    shared = [f"line number {i} that every site shows" for i in range(20_000)]
    rows = [(d, "\n".join([f"own {d}", *shared, "", f"end {d}"]), f"site{d}") for d in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(docs, min_chars=1, n_removed="gone").collect()}
    assert time.time() - began < 60
    assert got[0]["text"] == rows[0][1] and got[0]["gone"] == 0
    for d in range(1, 6):
        assert got[d]["text"] == f"own {d}\n\nend {d}" and got[d]["gone"] == 20_000


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    line = "a line that is on many sites"
    rows = [(0, line, "s0"), (1, f"x\n{line}\ny", "s1"), (1, f"{line}\nz", "s2"), (1, f"{line}\nz", "s2"), (2, line, "s3"), (None, f"q\n{line}", "s4"), (None, f"{line}\nr", "s5")]
    got = sorted(((r["doc_id"], r["text"], r["gone"]) for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_chars=1, n_removed="gone").collect()), key=str)
    assert got == sorted([(0, line, 0), (1, "x\ny", 1), (1, "z", 1), (1, "z", 1), (2, "", 1), (None, "q", 1), (None, "r", 1)], key=str)


def plain(pieces, capacity, limit):
    order, has, seen, out = [], [], [], []
    for size, cluster, source in pieces:
        at = bisect_left(order, (size, -1))
        while at < len(order) and (cluster in has[order[at][1]] or seen[order[at][1]].count(source) >= limit):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(has)
            has.append(set())
            seen.append([])
        has[b].add(cluster)
        seen[b].append(source)
        if residual > size:
            insort(order, (residual - size, b))
        out.append((b, capacity - residual))
    return out


@pytest.mark.parametrize("kind", ["one source", "hot cluster", "hot pair", "few sources", "mixed", "twins"])
def test_hot_kinds_are_placed_by_the_same_rule(kind):
    rng = random.Random(kind)
    make = {
        "one source": lambda i: (f"c{i}", "s"),
        "hot cluster": lambda i: ("c" if rng.random() < 0.4 else f"c{i}", f"s{rng.randrange(500)}"),
        "hot pair": lambda i: ("c", "s") if rng.random() < 0.3 else (f"c{rng.randrange(9)}", f"s{rng.randrange(4)}"),
        "few sources": lambda i: (f"c{i}", f"s{rng.randrange(3)}"),
        "mixed": lambda i: (f"c{rng.randrange(40)}", f"s{rng.randrange(40)}"),
        "twins": lambda i: (f"c{i // 2}", "s" if rng.random() < 0.8 else f"s{i}"),
    }[kind]
    pieces = sorted(((rng.randint(1, 400), *make(i)) for i in range(1500)), reverse=True)
    assert packing.pack_group(pieces, 1000, 2) == plain(pieces, 1000, 2)


def test_fifty_thousand_pieces_of_one_source_take_seconds():
    began = time.time()
    at = packing.pack_group([(20, f"c{i}", "s") for i in range(50_000)], 2048, 2)
    assert time.time() - began < 20 and len({b for b, _ in at}) == 25_000
    began = time.time()
    at = packing.pack_group([(20, "copy" if i % 3 else f"c{i}", "s" if i % 2 else f"s{i}") for i in range(50_000)], 2048, 2)
    assert time.time() - began < 40
