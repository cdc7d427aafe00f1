"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of each window of w consecutive hashes the least is
chosen, the rightmost of equal ones, and neighbouring windows that choose the same position add it
once. Any passage of k+w-1 code points that two texts share gives them a common hash (the match
guarantee), and the chosen positions say where.

A text of fewer than k code points is one gram, an empty text has none; a text with fewer than w
grams is one window. Null is empty. A fingerprint as text is the chosen hashes in order, 8 hex
digits each, so equal texts have equal ones. The likeness of two is the Jaccard likeness of their
hash multisets; two empty ones are alike (1), an empty and another are not (0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.llm.common import annotate, parts_for, pieces, range_cuts, raw, size_of, sliding_min
from windloom.session import landed

GRAM, WINDOW = 16, 32
#: Bytes of text in one range of documents.
PART_BYTES = 24 << 20
NULL_ID = -(1 << 63)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(cp: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions, in order. k is a power of two."""
    if not len(cp):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size, base = 1, np.uint64(0xD6E8FEB86659FD93)
    while size < k and len(h) > size:  # hashes of 2, 4, 8.. code points from those of half as many
        h = h[:-size] * base + h[size:]
        with np.errstate(over="ignore"):
            base = base * base
        size *= 2
    if size < k:  # too short for one gram: the text as one
        h = np.array([int.from_bytes(hashlib.blake2b(cp.tobytes(), digest_size=8).digest(), "little")], np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    # The hash above, the position counted backwards below: the least key is the rightmost least hash.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(h), -1, dtype=np.uint64)
    least = sliding_min(key, min(w, len(key)))
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), 0xFFFFFFFF - (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two multisets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


FIELDS = T.StructType([
    T.StructField("hashes", T.ArrayType(T.LongType())),
    T.StructField("positions", T.ArrayType(T.LongType())),
])


def fingerprints(docs: DataFrame, *, text_col: str = "text", k: int = GRAM, w: int = WINDOW, out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Append struct `out` of the chosen hashes and their positions in code points; no shuffle."""

    def make():
        def work(texts):
            found = (winnow(points((t or b"").decode("utf-8", "replace")), k, w) for t in texts)
            return [(h.tolist(), p.tolist()) for h, p in found]

        return work

    return annotate(docs, [text_col], out, FIELDS, make, keep=keep)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by the first as many code points of another."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and that to the next document.

    Documents are dealt to ranges of doc_id by one shuffle and sorted inside; the first document of
    a range also goes to the range before it (that of the first one to the last), so each task
    streams through its range and holds two texts at a time, whatever the range's size. Null doc_ids
    sort first, equal ones by text. An empty table gives no rows; a single document follows itself.
    `positions` are those of `fingerprint`, in code points.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    base = docs.select(order.alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_rows, n_bytes = size_of(docs, text_col)
    cuts = range_cuts(base, "ord", parts_for(docs, n_bytes, PART_BYTES), n_rows)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="left").astype(np.int32))

    # The first doc_id of each range, with the range before it: a row for each range, so no more than the shuffle has partitions.
    firsts = base.groupBy(part_of("ord").alias("own")).agg(F.min("ord").alias("first"))
    whole = Window.partitionBy(F.lit(0)).orderBy("own")
    before = F.lag("own").over(whole)
    firsts = landed(firsts.select("first", F.coalesce(before, F.last("own").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"), F.when(before.isNull(), 2).otherwise(1).alias("peek")), "range-firsts")
    placed = base.select("ord", "text", part_of("ord").alias("part")).join(F.broadcast(firsts), F.col("ord") == F.col("first"), "left")
    own, ahead = F.struct(F.col("part"), F.lit(0).alias("peek")), F.struct(F.col("before").alias("part"), F.col("peek"))
    placed = placed.select("ord", "text", F.explode(F.when(F.col("before").isNotNull(), F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    placed = placed.select("ord", "text", F.col("to.part").alias("part"), F.col("to.peek").alias("peek"))
    # peek 2 is the first document of all, which follows the last one.
    stream = placed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(F.col("peek") == 2, "ord", "text", "peek")

    def run(batches):
        yield from _compared(batches, k, w)

    return stream.select("ord", "text", "peek").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>")


def _compared(batches, k: int, w: int):
    """Rows of a range in order, each with the one after it; looked-ahead rows give no row of their own."""
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
    last, rows = None, []

    def row(now, following):
        (doc, text, cp, (h, places)), (_, other, _, (h_next, _)) = now[:4], following[:4]
        changed = edited(text, other)
        h_edit = winnow(points(changed), k, w)[0]
        return doc, len(cp), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(h), as_text(h_edit), likeness(h, h_edit), likeness(h, h_next), places

    def batch():
        cols = [pa.array([r[0] for r in rows], pa.int64(), mask=np.array([r[0] == NULL_ID for r in rows], bool)), pa.array([r[1] for r in rows], pa.int64())]
        cols += [pa.array([r[i] for r in rows], pa.string()) for i in range(2, 5)] + [pa.array([r[i] for r in rows], pa.float64()) for i in (5, 6)]
        ends = np.cumsum([0, *(len(r[7]) for r in rows)])
        cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([r[7] for r in rows]))))
        return pa.RecordBatch.from_arrays(cols, names=names)

    for whole in batches:
        for b in pieces(whole):
            for doc, raw_text, peek in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2).to_pylist(), strict=True):
                text = raw_text.decode("utf-8", "replace")
                cp = points(text)
                now = (doc, text, cp, winnow(cp, k, w), peek)
                if last and not last[4]:
                    rows.append(row(last, now))
                if not (last and peek and last[4]):  # of several looked-ahead rows the first one counts
                    last = now
            if rows:
                yield batch()
                rows = []
