"""Helpers shared by the text operators: byte-level words, Arrow batches, sizing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text that a Python task handles before it emits.
PIECE_ROWS, PIECE_BYTES = 2000, 16 << 20

#: Shuffle partitions for each core at most, and sampled rows for each range.
PARTS_A_CORE, SAMPLED = 64, 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs without ASCII white space (space and 0x09-0x0D), unchanged; null has none."""
    return text.split() if text else []


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return column.to_pylist()


def pieces(batch: pa.RecordBatch, rows: int = PIECE_ROWS, n_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of bounded rows and bytes; one row may be larger than the bound by itself."""
    step = max(1, min(rows, int(batch.num_rows * n_bytes / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def annotate(df: DataFrame, inputs: list[str], out: str, fields: T.StructType, make: Callable, keep: list[str] | None = None, piece: tuple[int, int] = (PIECE_ROWS, PIECE_BYTES)) -> DataFrame:
    """Append struct column `out`, made row by row from `inputs` in one Arrow pass without a shuffle.

    `make()` is called once a task and gives a function from lists of input values (strings as
    bytes) to a list of tuples. `keep` names the columns to pass through (default all); an input
    column called `out` is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    extra = [c for c in inputs if c not in kept]
    source = df.select(*[F.col(f"`{c}`") for c in kept + extra])
    at = [(kept + extra).index(c) for c in inputs]
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField(out, fields)])
    n_kept = len(kept)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(fields)
        work = make()
        for whole in batches:
            for b in pieces(whole, *piece):
                rows = work(*[raw(b.column(i)) for i in at])
                parts = [pa.array([r[i] for r in rows], type=kind.field(i).type) for i in range(kind.num_fields)]
                made = pa.StructArray.from_arrays(parts, fields=[kind.field(i) for i in range(kind.num_fields)])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n_kept)], made], names=[*kept, out])

    return source.mapInArrow(run, schema)


def size_of(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows, and bytes of text, by one aggregation."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    return int(row[0]), int(row[1])


def parts_for(df: DataFrame, n_bytes: int, part_bytes: int) -> int:
    """Partitions so that each holds about `part_bytes`, but no fewer than the session's shuffles and no more than PARTS_A_CORE for each core.

    Where the second bound holds, partitions are larger than `part_bytes`: what reads them must
    stream through them.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return max(least, min(-(-n_bytes // part_bytes), PARTS_A_CORE * spark.sparkContext.defaultParallelism))


def range_cuts(df: DataFrame, col: str, n: int, n_rows: int) -> np.ndarray:
    """At most n-1 ascending cut points of an integer column; part i holds cut[i-1] < value <= cut[i].

    Cut from a sample of about SAMPLED rows for each part, of all rows where there are no more: what
    comes to the driver grows with the parts, not with the rows.
    """
    if n <= 1 or not n_rows:
        return np.array([], dtype=np.int64)
    rows = df.select(F.col(col).cast("long").alias("v")).where("v is not null")
    share = SAMPLED * n / n_rows
    found = np.sort((rows.sample(share, 7) if share < 1 else rows).toPandas()["v"].to_numpy(np.int64))
    return np.unique(found[(np.arange(1, n) * len(found)) // n]) if len(found) else found


def unused(name: str, df: DataFrame) -> str:
    """A column name that the table does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_words(cache: dict, tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words by a bounded per-task cache."""
    if len(cache) > 400_000:
        cache.clear()
    return np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))


class WordHash(dict):
    """word -> 64-bit hash, made on first use."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of 64-bit hashes, in order; empty if it is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[j : j + n]
    return mixed(acc)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, acc = 1, x
    while have * 2 <= w:
        acc = np.minimum(acc[: len(acc) - have], acc[have:])
        have *= 2
    return np.minimum(acc[:n], acc[w - have : w - have + n])
