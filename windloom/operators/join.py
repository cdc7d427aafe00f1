"""Joins with checks, distinct scoring, and joins on overlap or distance (J-*)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    pass


def _unique(df: DataFrame, keys: list[str], side: str) -> None:
    if df.groupBy(*keys).count().where("count > 1").take(1):
        raise CardinalityError(f"keys {keys} are not unique on the {side}")


#: Rows of a side that is broadcast at most; beyond them both sides are sorted.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """A side of narrow rows with the hint that its counted size allows: broadcast, or else merge."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return df.hint("broadcast" if n <= BROADCAST_ROWS else "merge")


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """J-02: a join whose cardinality is checked: 1:1, 1:m or m:1."""
    many, one = validate.split(":")
    if many == "1":
        _unique(left, on, "left")
    if one == "1":
        _unique(right, on, "right")
    return left.join(right.hint("merge"), on, how)


def require_matched(df: DataFrame, column: str) -> DataFrame:
    """J-04: the frame itself, or an error if a joined column is null anywhere."""
    missing = df.where(F.col(column).isNull()).count()
    if missing:
        raise CardinalityError(f"{missing} rows have no {column}")
    return df


def score_distinct(df: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """J-05, J-06: score each distinct key once and join the result back."""
    return df.join(score(df.select(*keys).distinct()).hint("merge"), keys, "left")


def overlaps(windows: DataFrame, hits: DataFrame, on: str, cell: int = 64, how: str = "left") -> DataFrame:
    """J-10: windows [start, end) with hits [hit_start, hit_end) of the same `on` that overlap them.

    Both sides are placed in cells of positions, so the equi-join key is (on, cell) and a long parent
    with many windows and hits is not joined pairwise; a pair is kept in the cell where its overlap begins.
    """
    w = windows.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    h = hits.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("hit_start") / cell), F.floor((F.col("hit_end") - 1) / cell))))
    met = w.join(h.hint("merge"), [on, "__cell"]).where((F.col("start") < F.col("hit_end")) & (F.col("hit_start") < F.col("end")) & (F.floor(F.greatest("start", "hit_start") / cell) == F.col("__cell"))).drop("__cell")
    if how == "inner":
        return met
    extra = [c for c in hits.columns if c != on]
    return windows.join(met.select(*windows.columns, *extra).hint("merge"), windows.columns, "left")


#: Starts of windows in one block of a sequence.
STARTS = 64


def blocks_with_hits(df: DataFrame, hits: DataFrame, on: str, seq: str = "sequence", size: int = 15, how: str = "left") -> DataFrame:
    """J-10, J-11 for windows of `size` cut from sequences as by `tile.sized`: (on, __cell, __first, __last, __slice, __end, __hits), a row for each block of starts, with the hits of the same `on` that may overlap its windows.

    What travels is a block's text and its hits, each once, and never a window or a pair of a window and a hit; `windows_of_blocks` makes the windows.
    """
    extra, last = [c for c in hits.columns if c != on], F.greatest(F.lit(0), F.char_length(seq) - size)
    w = df.where(F.char_length(seq) > 0).select(on, seq, last.alias("__last"), F.explode(F.sequence(F.lit(0), last, F.lit(STARTS))).alias("__first"))
    w = w.select(on, F.floor(F.col("__first") / STARTS).alias("__cell"), "__first", F.least("__last", F.col("__first") + STARTS - 1).alias("__last"), F.substr(F.col(seq), F.col("__first") + 1, F.lit(STARTS + size - 1)).alias("__slice"), F.least(F.char_length(seq), F.col("__first") + STARTS + size - 1).alias("__end"))
    least, most = F.greatest(F.lit(0), F.col("hit_start") - size + 1), F.col("hit_end") - 1
    h = hits.where(most >= least).withColumn("__cell", F.explode(F.sequence(F.floor(least / STARTS), F.floor(most / STARTS))))
    h = h.groupBy(on, "__cell").agg(F.collect_list(F.struct(*extra)).alias("__hits"))
    return w.join(h.hint("merge"), [on, "__cell"], how)


def windows_of_blocks(blocks: DataFrame, on: str, size: int = 15) -> DataFrame:
    """(on, __cell, start, end, peptide, hits): the windows of `blocks_with_hits`, each with the list of the hits that overlap it; no row is dealt anew."""
    each = blocks.withColumn("start", F.explode(F.sequence("__first", "__last")))
    end = F.least(F.col("start") + size, "__end")  # two numbers, as each hit is held against it
    meets = F.filter("__hits", lambda h: (F.col("start") < h["hit_end"]) & (h["hit_start"] < end))
    return each.select(on, "__cell", "start", end.alias("end"), F.substr("__slice", F.col("start") - F.col("__first") + 1, F.lit(size)).alias("peptide"), F.coalesce(meets, F.array()).alias("hits"))


#: Width of a grid cell in cutoffs: a point then lies within the cutoff of 3.4 cells at most on average, and not of 27.
CELL_WIDTH = 4


def within_distance(points: DataFrame, cutoff: float, group: str, side: str) -> DataFrame:
    """J-24: pairs of points (id, x, y, z) of a group on different sides at most `cutoff` apart.

    Points of one side go to their grid cell, those of the other to the cells within the cutoff of
    them. The greatest side is never the first of a pair and the least never the second.
    """
    ends = points.agg(F.min(side).alias("least"), F.max(side).alias("most")).first()
    edge = CELL_WIDTH * cutoff
    grid = points.where(F.col(side) < F.lit(ends["most"])).withColumns({f"c{c}": F.floor(F.col(c) / edge) for c in "xyz"})
    around = points.where(F.col(side) > F.lit(ends["least"])).select(group, F.col(side).alias("side_b"), F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in "xyz"])
    for c in "xyz":
        around = around.withColumn(f"c{c}", F.explode(cells_within(F.col(f"{c}_b"), cutoff, edge)))
    met = grid.join(around.hint("merge"), [group, "cx", "cy", "cz"]).where(F.col(side) < F.col("side_b"))
    distance = F.sqrt(sum((F.col(c) - F.col(f"{c}_b")) * (F.col(c) - F.col(f"{c}_b")) for c in "xyz"))
    return met.withColumn("distance", distance).where(F.col("distance") <= cutoff)


def cells_within(at: Column, cutoff: float, edge: float) -> Column:
    """The cells along one axis that hold points within the cutoff; a little more, as distances are rounded."""
    reach = cutoff * (1 + 1e-9)
    return F.sequence(F.floor((at - reach) / edge), F.floor((at + reach) / edge))


def upper_median(values: Column) -> Column:
    """J-20: of an even number of values the upper one of the middle two."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def overlap_audit(samples: DataFrame, corpus: DataFrame, parent: str = "parent", sequence: str = "sequence", k: int = 9) -> DataFrame:
    """J-21: (parent, parent_rows, sample_windows, overlapping): corpus rows with the sample's sequence hash, the sample's distinct k-windows, and how many of those the corpus has.

    The corpus gives only windows that some sample asks for; where the samples are few these are found beside its windows.
    """
    from windloom.functions.sequence import digest
    from windloom.operators.coded import WORD, code_counts, codes_of_each
    from windloom.operators.tile import with_flanks
    from windloom.session import landed

    one = samples.select(F.col(parent).alias("parent"), F.col(sequence).alias("sequence"))
    other = corpus.select(F.col(parent).alias("parent"), F.col(sequence).alias("sequence"))
    if k <= WORD:  # windows are numbers, of which each chunk of the corpus gives one once
        mine, peptide = codes_of_each(one, k).distinct(), "code"
        held = code_counts(other, k).select("code")
    else:
        mine, peptide = with_flanks(one, k=k, flank=0).select("parent", "peptide").distinct(), "peptide"
        held = with_flanks(other, k=k, flank=0).select("peptide")
    mine = landed(mine, "samples")
    there = held.distinct().join(bounded(mine.select(peptide).distinct()), peptide, "left_semi")
    counts = mine.join(there.withColumn("__hit", F.lit(1)).hint("merge"), peptide, "left").groupBy("parent").agg(F.count(F.lit(1)).alias("sample_windows"), F.count("__hit").alias("overlapping"))
    hashes = other.groupBy(digest(16, F.col("sequence")).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    met = one.withColumn("__h", digest(16, F.col("sequence"))).join(hashes.hint("merge"), "__h", "left").join(counts.hint("merge"), "parent", "left")
    return met.select("parent", *[F.coalesce(x, F.lit(0)).alias(name) for x, name in (("__n", "parent_rows"), ("sample_windows", "sample_windows"), ("overlapping", "overlapping"))])
