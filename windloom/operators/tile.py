"""Window tiling (T-01 to T-09): explode a sequence into windows; parent columns are kept."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.functions.sequence import canonical
from windloom.operators.collapse import keep_first


#: Starts in one slice of a sequence. Finding a position in a string takes time in proportion to it,
#: so long sequences are sliced first and windows are cut from their slice.
SLICE = 64


def _sliced(df: DataFrame, seq: str, first: Column, last: Column, before: int, after: Column, slice_ok: Column | None = None) -> DataFrame:
    """Rows (.., __at, __slice, start): start runs from first to last; __slice holds the sequence from __at on, with `before` and `after` residues around its starts. `slice_ok` is tested once a slice, as __ok."""
    from_ = F.explode(F.sequence(first, last, F.lit(SLICE)))
    df = df.where(last >= first).withColumn("__first", from_)
    df = df.withColumn("__at", F.greatest(F.lit(0), F.col("__first") - before))
    df = df.withColumn("__slice", F.substr(F.col(seq), F.col("__at") + 1, F.col("__first") - F.col("__at") + SLICE + after))
    if slice_ok is not None:
        df = df.withColumn("__ok", slice_ok)
    return df.withColumn("start", F.explode(F.sequence(F.col("__first"), F.least(last, F.col("__first") + SLICE - 1)))).drop("__first")


def with_flanks(df: DataFrame, seq: str = "sequence", k: int = 9, flank: int = 4, first: int = 0, only_canonical: bool = False) -> DataFrame:
    """T-01 (first=1, only_canonical) and T-02 (first=0): windows of k with up to `flank` residues on each side."""
    kept = list(df.columns)
    # Most slices hold residues alone, and so do all their windows: only those of other slices are looked at.
    slice_ok = canonical(F.col("__slice")) if only_canonical else None
    df = _sliced(df, seq, F.lit(first), F.char_length(seq) - k, flank, F.lit(k + flank), slice_ok)
    s, at = F.col("__slice"), F.col("start") - F.col("__at")
    out = df.select(
        *kept,
        "start",
        (F.col("start") + k).alias("end"),
        F.substr(s, at + 1, F.lit(k)).alias("peptide"),
        F.substr(s, F.greatest(at - flank, F.lit(0)) + 1, F.least(at, F.lit(flank))).alias("n_flank"),
        F.substr(s, at + k + 1, F.lit(flank)).alias("c_flank"),
        *([F.col("__ok")] if only_canonical else []),
    )
    return out.where(F.col("__ok") | canonical(F.concat("n_flank", "peptide", "c_flank"))).drop("__ok") if only_canonical else out


def sized(df: DataFrame, seq: str = "sequence", size: int = 15, stride: int = 1) -> DataFrame:
    """T-03, T-04: windows of `size`; a shorter sequence is one window, an empty one none."""
    kept, n = list(df.columns), F.char_length(seq)
    df = _sliced(df.where(n > 0), seq, F.lit(0), F.greatest(F.lit(0), n - size), 0, F.lit(size))
    df = df.where(F.col("start") % stride == 0)
    return df.select(*kept, "start", F.substr("__slice", F.col("start") - F.col("__at") + 1, F.lit(size)).alias("peptide"), F.least(F.col("start") + size, n).alias("end"))


def many_lengths(df: DataFrame, seq: str = "sequence", lengths: tuple[int, ...] = (*range(8, 12), *range(12, 19))) -> DataFrame:
    """T-05: all windows of all given lengths."""
    kept = list(df.columns)
    df = df.withColumn("length", F.explode(F.array(*[F.lit(k) for k in lengths])))
    df = _sliced(df, seq, F.lit(0), F.char_length(seq) - F.col("length"), 0, F.col("length"))
    return df.select(*kept, "length", "start", F.substr("__slice", F.col("start") - F.col("__at") + 1, F.col("length")).alias("peptide"))


def _suffixes(df: DataFrame, seq: str, lo: int, hi: int) -> DataFrame:
    """(w, n, size, shared): the distinct texts of hi letters, or up to the sequence's end but lo at least, that start anywhere, with how often they do; shared is how many first letters each has in common with the one before it in order, lo - 1 at least.

    All windows of lo to hi letters are beginnings of these, and a beginning longer than `shared` is seen for the first time.
    """
    df = _sliced(df.select(seq), seq, F.lit(0), F.char_length(seq) - lo, 0, F.lit(hi))
    each = df.select(F.substr("__slice", F.col("start") - F.col("__at") + 1, F.lit(hi)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("__head", F.left("w", F.lit(lo)))
    each = each.withColumn("__last", F.lag("w").over(Window.partitionBy("__head").orderBy("w")))
    shared = F.when(F.col("__last").isNull(), lo - 1)
    for k in range(lo + 1, hi + 1):
        shared = shared.when(F.left("w", F.lit(k)) != F.left("__last", F.lit(k)), k - 1)
    return each.select("w", "n", F.char_length("w").alias("size"), shared.otherwise(hi).alias("shared"))


def length_counts(df: DataFrame, seq: str = "sequence", lengths: tuple[int, ...] = (*range(8, 12), *range(12, 19))) -> DataFrame:
    """T-05: (length, n, n_distinct) of the windows of `many_lengths`; one row travels for each start, not one for each length."""
    s = _suffixes(df, seq, min(lengths), max(lengths))
    fits = lambda k: F.col("size") >= k
    sums = s.agg(*[x for k in lengths for x in (F.sum(F.when(fits(k), F.col("n"))).alias(f"n{k}"), F.count_if(fits(k) & (F.col("shared") < k)).alias(f"d{k}"))])
    each = F.array(*[F.struct(F.lit(k).alias("length"), F.col(f"n{k}").alias("n"), F.col(f"d{k}").alias("n_distinct")) for k in lengths])
    return sums.select(F.inline(each)).where("n > 0")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_at(seq: pd.Series, edges: pd.Series) -> pd.Series:
    return pd.Series([[s[a:b] for a, b in zip(e[:-1], e[1:], strict=True)] for s, e in zip(seq, edges, strict=True)])


def fragments(df: DataFrame, cuts: Column, seq: str = "sequence") -> DataFrame:
    """T-06: the pieces between sorted distinct cut positions (0 and the end included); no window function, the cuts are an array of the row."""
    n = F.char_length(seq)
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.filter(cuts, lambda c: (c > 0) & (c < n)))))
    kept = [F.col(f"`{c}`") for c in df.columns]
    # A row's pieces are cut at once: finding each from the sequence's beginning on took time with the square of its length.
    df = df.where(F.col(seq).isNotNull() & cuts.isNotNull()).withColumn("__edges", edges)
    each = F.arrays_zip(F.slice("__edges", F.lit(1), F.size("__edges") - 1).alias("start"), F.slice("__edges", F.lit(2), F.size("__edges") - 1).alias("end"), _cut_at(F.col(seq), F.col("__edges")).alias("piece"))
    return df.select(*kept, F.posexplode(each).alias("fragment", "__x")).select(*kept, "fragment", F.col("__x")["start"].alias("start"), F.col("__x")["end"].alias("end"), F.col("__x")["piece"].alias("piece"))


def fragments_behind(df: DataFrame, letters: str, seq: str = "sequence") -> DataFrame:
    """T-06 for cuts behind each of some letters: (.., piece), split in one pass over the sequence."""
    return df.select("*", F.explode(F.filter(F.split(seq, f"(?<=[{letters}])"), lambda x: x != "")).alias("piece"))


def by_parent(df: DataFrame, parent: str = "parent") -> DataFrame:
    """Sequences dealt by their parent before they are cut: windows are many times larger, and aggregations by parent and window then need no shuffle. As many parts as the shuffle has, which small sequences must not lessen."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parent)


def expected_windows(df: DataFrame, seq: str = "sequence", k: int = 9, first: int = 0) -> DataFrame:
    """T-09: how many windows there must be."""
    return df.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.char_length(seq) - k + 1 - first)), F.lit(0)).cast("long").alias("expected"))


def cut_behind(seq: str, letters: str) -> tuple[Column, str]:
    """Cut positions behind each of some letters, as an array, and the column that they cut."""
    return F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(c.isin(*letters), i + 1)), lambda x: x.isNotNull()), seq


def pool(df: DataFrame, cuts: Column, seq: str = "sequence", lengths: tuple[int, int] = (8, 18), pieces: tuple[int, int] = (8, 25)) -> DataFrame:
    """T-05: (length, peptide): distinct windows of the given lengths of whole sequences and of their fragments, and fragments of the given lengths, to be ordered by length and text.

    A fragment lies in its sequence, so its windows are among the sequence's; only whole fragments
    that are longer than a window come from the cuts.
    """
    s = _suffixes(df, seq, *lengths)
    new = F.explode(F.sequence(F.col("shared") + 1, F.col("size"))).alias("length")
    windows = s.where("shared < size").select("w", new).select("length", F.left("w", F.col("length")).alias("peptide"))
    n = F.char_length("piece")
    whole = fragments(df.where(F.col(seq) != "").select(seq), cuts, seq).where(n.between(*pieces) & ~n.between(*lengths)).select(n.alias("length"), F.col("piece").alias("peptide"))
    return windows.unionByName(whole.distinct())


def pool_sources(sources: dict[str, DataFrame], order: str = "parent") -> DataFrame:
    """T-07: T-01's windows of several sources (name: (parent, sequence, and `order` if it is another column)), the first row of each peptide by source, then parent, then start.

    The first place of a peptide is found by partial minima; sources are never collected or numbered.
    """
    parts = [df.select(F.col("parent").cast("string").alias("parent"), F.col(order).alias("__order"), "sequence", F.lit(name).alias("domain"), F.lit(i).alias("__source")) for i, (name, df) in enumerate(sources.items())]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    windows = with_flanks(whole, first=1, only_canonical=True).drop("sequence")
    return keep_first(windows, ["peptide"], F.struct("__source", "__order", "start")).drop("__source", "__order")
