"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most `capacity` words; full pieces fill a bin alone and the
rest are packed, largest first. A bin knows its residual, a bitmap of the duplicate clusters in it
and two bitmaps of sources (seen once, seen SOURCE_LIMIT times). The successor search starts at the
tightest bin that has room and goes on to the next larger residual until a bin without conflict is
found; else a new bin is opened. Clusters and sources that many pieces of a group share keep an order
of the bins open to them, so that the search does not walk over all the bins they fill. No bin holds two pieces of a duplicate cluster, nor more than
SOURCE_LIMIT pieces of a source.

Every input row gets a number, `row`, when its size is written out. Pieces are dealt to packing
groups by a hash of document, cluster and row, each group of a bounded number of words; groups are
packed independently, and a bin's id names its group. Only piece sizes travel, never text. A
duplicate cluster is an equal word sequence (A-Z lower-cased).

Null or empty texts give one row without a bin. A null source is a source of its own. Rows that
share a doc_id, or have none, are separate documents told apart by `row`: copies of one row spread
over the groups, and no two share a bin. Row numbers, and so groups and bins, follow the way the
input is split into tasks. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.llm.common import LOWER, annotate, parts_for
from windloom.session import landed

CAPACITY, SOURCE_LIMIT = 2048, 2
#: Words of one packing group, so about GROUP_WORDS / CAPACITY bins; bytes that a piece takes on its
#: way to its group, and of them in a partition, which works through its groups one after another.
GROUP_WORDS, PIECE_BYTES, PART_BYTES = 1 << 20, 64, 1 << 20

FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("cluster", T.BinaryType())])
PLACED = "doc_id long, row long, piece long, word_start long, n_words long, bin_id string, bin_offset long"


class Bins:
    """Open bins ordered by residual; `watched` clusters, sources and pairs have an order of their own bins.

    A watched kind is in conflict with most bins, so its order holds only the bins that are open to it
    and its successor search meets no other. All orders give the same tightest bin.
    """

    def __init__(self, capacity: int, source_limit: int = SOURCE_LIMIT, watched: list[tuple[int, int]] = ()):
        self.capacity, self.limit = capacity, source_limit
        #: (cluster, source), 0 for any -> (residual, bin) of the bins open to it, ascending.
        self.orders: dict[tuple[int, int], list[tuple[int, int]]] = {kind: [] for kind in [(0, 0), *watched]}
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # for each bin, bitmaps of the sources seen once, twice, ..

    def open_to(self, b: int, cluster: int, source: int) -> bool:
        return not (self.clusters[b] & cluster or self.sources[b][-1] & source)

    def order_for(self, cluster: int, source: int) -> list[tuple[int, int]]:
        """The narrowest order that holds every bin open to a piece."""
        return next(self.orders[k] for k in ((cluster, source), (0, source), (cluster, 0), (0, 0)) if k in self.orders)

    def place(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """The bin for a piece and its offset there; cluster and source are single bits, or 0."""
        order = self.order_for(cluster, source)
        at = bisect_left(order, (size, -1))
        while at < len(order) and not self.open_to(order[at][1], cluster, source):
            at += 1
        if at < len(order):
            residual, b = order[at]
            for kind, own in self.orders.items():
                if self.open_to(b, *kind):
                    del own[bisect_left(own, (residual, b))]
        else:
            residual, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.limit)
        self.clusters[b] |= cluster
        seen = self.sources[b]
        seen[next(i for i, bits in enumerate(seen) if not bits & source)] |= source
        if residual > size:
            for kind, own in self.orders.items():
                if self.open_to(b, *kind):
                    insort(own, (residual - size, b))
        return b, self.capacity - residual


#: A cluster, a source or a pair of both with one in so many pieces of a group is watched, so there are three times as many at most.
WATCHED = 16


def pack_group(pieces: list[tuple], capacity: int, source_limit: int = SOURCE_LIMIT) -> list[tuple[int, int]]:
    """(bin, offset) for each (size, cluster, source), given largest first."""
    repeated = Counter(cluster for _, cluster, _ in pieces)
    bits: tuple[dict, dict] = ({}, {})
    number = lambda which, key: 1 << bits[which].setdefault(key, len(bits[which]))
    coded = [(size, number(0, cluster) if repeated[cluster] > 1 else 0, number(1, source)) for size, cluster, source in pieces]
    kinds = Counter(k for _, c, s in coded for k in ({(c, 0), (0, s), (c, s)} if c else {(0, s)}))
    bins = Bins(capacity, source_limit, [k for k, n in kinds.items() if n * WATCHED >= len(coded) and n > WATCHED])
    return [bins.place(*piece) for piece in coded]


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, n_words, cluster, row) of each document; text stays behind."""

    def make():
        import xxhash

        def work(texts):
            rows = []
            for t in texts:
                w = t.translate(LOWER).split() if t else []
                rows.append((len(w), xxhash.xxh3_128_digest(b" ".join(w))))
            return rows

        return work

    found = annotate(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")), ["text"], "m", FIELDS, make, keep=["doc_id", "source"])
    return found.select("doc_id", "source", "m.n_words", "m.cluster", F.monotonically_increasing_id().alias("row"))


def best_fit(docs: DataFrame, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", source_limit: int = SOURCE_LIMIT, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, row, piece, word_start, n_words, bin_id, bin_offset) for every piece of every document."""
    sizes = landed(sized(docs, id_col, text_col, source_col), "sizes")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_words") / capacity)).cast("long")
    total = sizes.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(n_pieces), F.lit(0))).first()
    groups = max(1, -(-total[0] // group_words))
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
    pieces = pieces.select("doc_id", "row", "source", "cluster", "piece", (F.col("piece") * capacity).alias("word_start"), F.least(F.lit(capacity), F.col("n_words") - F.col("piece") * capacity).cast("long").alias("n_words"))
    alone = F.col("n_words").isin(0, capacity)
    full = pieces.where(alone).select("doc_id", "row", "piece", "word_start", "n_words", F.when(F.col("n_words") > 0, F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string"))).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    rest = pieces.where(~alone).withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster", "row"), F.lit(groups)))
    n_parts = min(groups, parts_for(docs, total[1] * PIECE_BYTES, PART_BYTES))
    dealt = rest.repartitionById(n_parts, (F.col("grp") % n_parts).cast("int")).sortWithinPartitions("grp", F.desc("n_words"), F.col("doc_id").asc_nulls_first(), "cluster", F.col("source").asc_nulls_first(), "row")

    def run(batches):
        held: list = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if held and held[0][7] != row[7]:
                    yield _placed(held, capacity, source_limit)
                    held = []
                held.append(row)
        if held:
            yield _placed(held, capacity, source_limit)

    packed = dealt.select("doc_id", "row", "piece", "word_start", "n_words", "cluster", "source", "grp").mapInArrow(run, PLACED)
    return full.unionByName(packed)


def _placed(rows: list[tuple], capacity: int, source_limit: int):
    import pyarrow as pa

    at = pack_group([(r[4], r[5], r[6]) for r in rows], capacity, source_limit)
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
    columns += [pa.array([f"{rows[0][7]}-{b}" for b, _ in at]), pa.array([o for _, o in at], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "piece", "word_start", "n_words", "bin_id", "bin_offset"])
