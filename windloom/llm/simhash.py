"""SimHash near-dedup: fingerprints of 64 bits, pigeonring filtering, connected components.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Shingles
are `shingle` words, 4 by default, joined by a space and with repeats (A-Z lower-cased, words without
ASCII white space; fewer words: the whole sequence as one); the hash is XXH64 with seed 42. Two
fingerprints are alike at `near` or fewer differing bits, 4 by default. Each fingerprint is taken once,
however many documents have it.

Pigeonring: the bits lie on a ring of near+1 segments. If two fingerprints differ in at most `near`
bits, some segment starts a chain of segments in which the first l hold at most l*near/(near+1)
differing bits together, for every l. So the first segment is equal, and of the second, cut into two
pieces, one piece is. Fingerprints that agree there meet in a bucket; a pair of a bucket must pass the
longer chains one after the other before its whole Hamming distance is looked at.

In each bucket every member is first held against one hub, the fingerprint of most documents. After
that only members of different components are tried. Buckets of more than BUCKET of those are dealt
anew, twice at most: of the bits that are left, cut into near+1 pieces, one piece must be equal as
well. All of this only saves trials; no pair that is alike is lost, at any size.

Null and empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id have
a fingerprint but take no part in links, and their component is null. Rows that share a doc_id are each
judged by their own text. An empty table gives no rows. Ids must be integers or null. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.llm.common import LOWER, pieces, raw
from windloom.operators.graph import connected_components
from windloom.session import landed

BITS, SHINGLE, NEAR, SEED = 64, 4, 4, 42
#: Members of a bucket from which it is dealt anew, and how often; neither changes the result.
BUCKET, LEVELS = 64, 3
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    import xxhash

    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        h = np.array([digest(line[i:j], SEED) for i, j in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, in one pass over the texts without a shuffle."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in pieces(whole):
                made = [fingerprint(t, shingle) for t in raw(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def cut(bits: list[int], n: int) -> list[list[int]]:
    """A list of bits in n runs of nearly equal length, in order."""
    at = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(at, at[1:], strict=False)]


def of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


class Ring:
    """Segments, chains and bucket masks for a Hamming bound."""

    def __init__(self, near: int):
        if not 1 <= near < BITS // 4:
            raise ValueError(f"near must be from 1 to {BITS // 4 - 1}, not {near}")
        self.near, self.n = near, near + 1
        self.segments = cut(list(range(BITS)), self.n)
        #: levels[l]: (start segment, mask) of each bucket family; those of one start stand together, and near+1 refine each of the level before.
        self.levels = [[(s, of(self.segments[s] + part)) for s in range(self.n) for part in cut(self.segments[(s + 1) % self.n], self.budget(2) + 1)]]
        while len(self.levels) < LEVELS:
            self.levels.append([(s, mask | of(part)) for s, mask in self.levels[-1] for part in cut([b for b in self.from_start(s) if not mask >> b & 1], self.n)])

    def budget(self, length: int) -> int:
        """Differing bits that a chain of this many segments may hold."""
        return length * self.near // self.n

    def from_start(self, s: int) -> list[int]:
        return [b for i in range(self.n) for b in self.segments[(s + i) % self.n]]

    def chain(self, s: int, length: int) -> int:
        return of([b for i in range(length) for b in self.segments[(s + i) % self.n]])

    def viable(self, x: Column, family: Column, level: int) -> Column:
        """Whether the differing bits `x` pass every longer chain from the family's start, and the whole bound at last."""
        ok, start = F.lit(True), (family / (len(self.levels[level]) // self.n)).cast("int")
        for length in range(2, self.n):
            masks = F.array(*[F.lit(signed(self.chain(s, length))) for s in range(self.n)])
            ok = ok & (F.bit_count(x.bitwiseAND(F.element_at(masks, start + 1))) <= self.budget(length))
        return ok & (F.bit_count(x) <= self.near)


def dealt(rows: DataFrame, ring: Ring, level: int) -> DataFrame:
    """Each row under its buckets (k, v): all families of the first level, or those that refine its present one."""
    masks = [signed(m) for _, m in ring.levels[level]]
    if level == 0:
        families = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    else:
        families = F.transform(F.sequence(F.col("k") * ring.n, F.col("k") * ring.n + ring.n - 1), lambda i: F.struct(i.alias("k"), F.element_at(F.array(*[F.lit(m) for m in masks]), i + 1).alias("mask")))
    rest = [c for c in rows.columns if c not in ("k", "v")]
    each = rows.select(*rest, F.explode(families).alias("x"))
    return each.select(*rest, "x.k", F.col("fp").bitwiseAND(F.col("x.mask")).alias("v"))


def hub_links(classes: DataFrame, ring: Ring) -> DataFrame:
    """(a, b): members of a bucket that are alike to its hub."""
    lists = dealt(classes.select("fp", "copies"), ring, 0)
    hubs = lists.groupBy("k", "v").agg(F.min(F.struct((-F.col("copies")).alias("c"), "fp")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1").select("k", "v", F.col("h.fp").alias("hub"))
    met = lists.select("k", "v", "fp").join(hubs.hint("merge"), ["k", "v"])
    met = met.where((F.col("fp") != F.col("hub")) & ring.viable(F.col("fp").bitwiseXOR(F.col("hub")), F.col("k"), 0))
    return met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def cross_links(classes: DataFrame, labels: DataFrame, ring: Ring) -> DataFrame:
    """(a, b): labels of two components that hold a pair of fingerprints alike."""
    rows = classes.select("fp").join(labels.hint("merge"), F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("component", "fp").alias("label"))
    links = None
    for level in range(LEVELS):
        lists = dealt(rows, ring, level)
        open_ = lists.groupBy("k", "v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("k", "v", "m")
        rows = landed(lists.join(open_.hint("merge"), ["k", "v"]), "simhash-lists")
        few = (rows if level == LEVELS - 1 else rows.where(F.col("m") <= BUCKET)).select("k", "v", "fp", "label")
        x, y = few.alias("x"), few.alias("y")
        met = x.join(y.hint("merge"), (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.label") < F.col("y.label")) & ring.viable(F.col("x.fp").bitwiseXOR(F.col("y.fp")), F.col("x.k"), level))
        found = met.select(F.col("x.label").alias("a"), F.col("y.label").alias("b")).distinct()
        links = found if links is None else links.unionByName(found)
        rows = rows.where(F.col("m") > BUCKET).drop("m")
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row; kept marks one document of each component."""
    ring = Ring(near)
    sig = landed(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = landed(sig.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    labels = landed(connected_components(hub_links(classes, ring)), "simhash-labels")
    merged = connected_components(cross_links(classes, labels, ring)).select(F.col("id").alias("label"), F.col("component").alias("top"))
    joined = classes.select("fp", "first").join(labels.hint("merge"), F.col("fp") == F.col("id"), "left").withColumn("label", F.coalesce("component", "fp"))
    joined = landed(joined.join(merged.hint("merge"), "label", "left").select("fp", "first", F.coalesce("top", "label").alias("label")), "simhash-components")
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    found = joined.join(least.hint("merge"), "label").select("fp", "component_id")
    out = sig.join(found.hint("merge"), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
