"""MinHash near-dedup by bottom-k sketches, with exact confirmation and connected components.

A document's set holds its distinct shingles of `shingle` words, 3 by default (A-Z lower-cased, words
without ASCII white space; fewer words: the whole sequence as one). Two sets are alike from a Jaccard
likeness of `percent` in a hundred, 85 by default. Equal word sequences are one class, of which
the smallest doc_id takes part. One hash function orders the shingles; a class keeps the K least.

Two sets of just that likeness share at least T of K=32 retained values but for a chance of MISS at
most (a binomial tail; T=16 and about 6e-7 at 85, T=13 and about 2e-7 at 80), and sets of up to K are
kept whole, where the bound is exact. Hence they share one of the K-T+1 values of each sketch that
fewest classes retain: only these enter the first inverted lists, which keeps common passages and
boilerplate out of them.

Classes that meet in a list get their full sets, and the same rule with the exact bounds gives the
final lists: of a set of n the n-ceil(percent*n/100)+1 rarest shingles, each with its position in that order.
Two members of a list can be alike only if what follows that position is enough for both sizes.

Within a list every member is first paired with one hub, that with the fewest rarer shingles. Then
the pairs that are left between different components are tried, so that no link is lost and no
pairs are expanded that a component already joins. Each pair passes the union-sketch estimate, then
the exact test on full sets. Lists are split by Spark's skew join where one is very long.

Null or empty texts have an empty set and are linked with nothing. Null doc_ids take no part and get
a null component. Rows that share a doc_id are one document: a link of any of them counts for it.
Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import LOWER, WordHash, grams, hash_words, pieces, raw
from windloom.operators.graph import connected_components
from windloom.session import landed

K, SHINGLE = 32, 3
PERCENT = 85
#: The chance at most that two sets just alike share fewer than T values, which T is derived from.
MISS = 1e-6


def least_shared(percent: int) -> int:
    """T: the most values that two sets of this likeness share but for a chance of MISS.

    A pair whose estimate on K values of the union's sketch is below T/K is not tested exactly.
    """
    p, tail, t = percent / 100, 0.0, 0
    while t < K and (tail := tail + comb(K, t) * p**t * (1 - p) ** (K - t)) <= MISS:
        t += 1
    return t


def shingle_set(tokens: list[bytes], cache: WordHash, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes in ascending (signed) order."""
    if not tokens:
        return np.empty(0, np.int64)
    h = hash_words(cache, tokens)
    g = grams(h, shingle) if len(tokens) >= shingle else grams(h, len(tokens)) ^ np.uint64(len(tokens))
    return np.unique(g.view(np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingles: list[int]) -> DataFrame:
    """(doc_id, key, n0, sketch0, n1, sketch1, ..): key is a 128-bit hash of the word sequence; set size and sketch for each shingle length, in one pass."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        cache = WordHash()
        for whole in batches:
            for b in pieces(whole):
                keys, sets = [], [([], []) for _ in shingles]
                for text in raw(b.column(1)):
                    w = text.translate(LOWER).split() if text else []
                    keys.append(xxhash.xxh3_128_digest(b" ".join(w)))
                    for (sizes, sketches), k in zip(sets, shingles, strict=True):
                        s = shingle_set(w, cache, k)
                        sizes.append(len(s))
                        sketches.append(s[:K])
                columns = [b.column(0), pa.array(keys, pa.binary())]
                for sizes, sketches in sets:
                    ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
                    columns += [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", *(c for i in range(len(shingles)) for c in (f"n{i}", f"sketch{i}"))])

    schema = "doc_id long, key binary" + "".join(f", n{i} long, sketch{i} array<long>" for i in range(len(shingles)))
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def rarest(sets: DataFrame, least, members: str) -> DataFrame:
    """(v, node, n, pos): each set under its rarest values, `least` of which must be shared; values of one set are left out but counted in pos."""
    posted = sets.select("node", "n", F.size(members).alias("s"), F.explode(members).alias("v"))
    often = posted.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(often.hint("merge"), "v").groupBy("node", "n", "s").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("found"))
    alone = F.col("s") - F.size("found")
    room = F.greatest(F.lit(0), F.col("s") - least + 1 - alone)
    each = shared.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("found", F.lit(1), room)).alias("i", "x"))
    return each.select("x.v", "node", "n", (F.col("alone") + F.col("i") + 1).alias("pos"))


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Nodes that meet another one in a list of the sketches."""
    least = F.least(F.lit(least_shared(percent)), F.ceil(F.col("s") * F.lit(percent) / 100)).cast("int")
    lists = landed(rarest(classes, least, "sketch"), "sketch-lists")
    met = lists.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return lists.join(met.hint("merge"), "v", "left_semi").select("node").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, n, members): the full sets of the given documents, in ascending order."""
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t")).join(nodes.hint("merge"), "node", "left_semi")

    def run(batches):
        import pyarrow as pa

        cache = WordHash()
        for whole in batches:
            for b in pieces(whole):
                sets = [shingle_set(t.translate(LOWER).split() if t else [], cache, shingle) for t in raw(b.column(1))]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), lists], names=["node", "n", "members"])

    return texts.mapInArrow(run, "node long, n long, members array<long>")


def may_be_alike(x: str, y: str, percent: int):
    """Whether sizes and positions of two members of a list leave room for enough shared shingles."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    needed = F.ceil(F.lit(percent) * (nx + ny) / (100 + percent))
    return (F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos")) + 1 >= needed) & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): every member of a list with its hub."""
    hubs = lists.groupBy("v").agg(F.min(F.struct("pos", "node", "n")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1").select("v", F.col("h.node").alias("node"), F.col("h.pos").alias("pos"), F.col("h.n").alias("n"))
    met = lists.alias("x").join(hubs.alias("y").hint("merge"), F.col("x.v") == F.col("y.v")).where((F.col("x.node") != F.col("y.node")) & may_be_alike("x", "y", percent))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def cross_pairs(lists: DataFrame, labels: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a list in different components that may be alike and were not tried."""
    now = lists.join(labels.hint("merge"), lists["node"] == labels["id"], "left").select("v", "node", "n", "pos", F.coalesce("component", "node").alias("label"))
    split = now.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    now = landed(now.join(split.hint("merge"), "v", "left_semi"), "lists")
    met = now.alias("x").join(now.alias("y").hint("merge"), (F.col("x.v") == F.col("y.v")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & may_be_alike("x", "y", percent))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sets from the K least values of their union."""
    x, y = a[:K], b[:K]
    union = np.union1d(x, y)[:K]
    return len(np.intersect1d(np.intersect1d(union, x, True), y, True)) / max(1, len(union))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that pass the estimate and then the exact test on full sets."""
    left, right = (sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    likely = least_shared(percent) / K
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "set_a", "set_b")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole):
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    small, large = sorted((len(x), len(y)))
                    ok = small and 100 * small >= percent * large and estimate(x, y) >= likely
                    if ok:
                        common = small + large - len(np.union1d(x, y))
                        ok = 100 * common >= percent * (small + large - common)
                    keep.append(bool(ok))
                kept = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rules: list[tuple[int, int]] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    With `rules`, (shingle, percent) each, documents are linked that are alike by any of them, and
    n_shingles is by the first. All rules share the classes of equal texts and the components: hubs
    of all rules link first, then what is left between components.
    """
    rules = rules or [(shingle, percent)]
    sig = landed(signatures(docs, id_col, text_col, [k for k, _ in rules]), "signatures")
    usable = sig.where("n0 > 0 and doc_id is not null")
    firsts = landed(usable.groupBy("key").agg(F.min("doc_id").alias("node")), "firsts")
    classes = landed(usable.join(firsts.hint("merge"), "key").where("doc_id = node").dropDuplicates(["node", "key"]), "classes")
    parts = []
    for i, (k, p) in enumerate(rules):
        own = classes.select("node", "key", F.col(f"n{i}").alias("n"), F.col(f"sketch{i}").alias("sketch"))
        sets = landed(shingle_sets(docs, candidates(own, p), id_col, text_col, k), "sets")
        lists = landed(rarest(sets, F.ceil(F.col("n") * F.lit(p) / 100), "members"), "lists")
        tried = landed(hub_pairs(lists, p), "pairs")
        parts.append((p, sets, lists, tried, landed(confirmed(tried, sets, p), "links")))
    links = reduce(DataFrame.unionByName, [x[-1] for x in parts])
    labels = landed(connected_components(links), "labels")
    for p, sets, lists, tried, _ in parts:
        rest = landed(cross_pairs(lists, labels, tried, p), "pairs")
        links = links.unionByName(landed(confirmed(rest, sets, p), "links"))
    labels = connected_components(links)
    out = sig.select("doc_id", "key", F.col("n0").alias("n")).join(firsts.hint("merge"), "key", "left")
    out = out.join(labels.hint("merge"), out["node"] == labels["id"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
