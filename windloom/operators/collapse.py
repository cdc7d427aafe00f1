"""Deduplication and roll-ups of rows to keys (A-01 to A-05, A-20, A-35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.functions.sequence import clean_or_reject, length_between


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """A-01: the whole first row of each key by a total order. One aggregation with partial minima, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def first_places(df: DataFrame, key: str, parent: str = "parent", start: str = "start") -> DataFrame:
    """A-01 for numbered parents: (key, parent, start) of the first occurrence of each key.

    Both numbers travel as one long, so the aggregation is a hash aggregation with partial minima;
    columns of the parent are joined afterwards. Parents must be between 0 and 2^32.
    """
    place = F.shiftleft(F.col(parent).cast("long"), 31) + F.col(start)
    best = df.groupBy(key).agg(F.min(place).alias("__place"))
    return best.select(key, F.shiftright("__place", 31).alias(parent), F.col("__place").bitwiseAND((1 << 31) - 1).cast("int").alias(start))


def first_known(c: str, order: Column) -> Column:
    """A-02, A-04: the first value that is not null; the first row's value may be null."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)


def occurrences(df: DataFrame, key: str = "peptide", parent: str = "parent") -> DataFrame:
    """A-03: counts, distinct parents and ordered locations of each key. The location list of a key is as long as its occurrences: use `occurrence_counts` where a key may be on a large share of the rows."""
    place = F.struct(F.col(parent).alias("parent"), "start", "end")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct(parent).alias("parent_count"), F.array_sort(F.collect_set(parent)).alias("parents"), F.array_sort(F.collect_list(place)).alias("locations"))


def occurrence_counts(df: DataFrame, key: str = "peptide", parent: str = "parent") -> DataFrame:
    """A-03 without lists: first per (key, parent), then per key, so a hot key is pre-aggregated."""
    each = df.groupBy(key, parent).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.sum("n").alias("occurrence_count"), F.count(F.lit(1)).alias("parent_count"))


def assay(df: DataFrame, key: str, positive: Column, order: Column, carried: list[str], unknown: str | None = None) -> DataFrame:
    """A-04: positives, negatives and a label of each key, with the first known value of other columns, or `unknown`."""
    pos = F.sum(positive.cast("long"))
    first = [F.coalesce(first_known(c, order), F.lit(unknown)).alias(c) for c in carried]
    return df.groupBy(key).agg(pos.alias("n_pos"), (F.count(F.lit(1)) - pos).alias("n_neg"), F.max(positive).alias("label"), *first)


#: The lengths of class-II assay peptides.
ASSAY_LENGTHS = (13, 21)


def assay_peptides(assays: DataFrame) -> DataFrame:
    """A-04: assay rows (peptide, source_molecule, source_organism, qualitative, ord) as one row of each cleaned peptide of ASSAY_LENGTHS: a single positive makes it positive; molecule and organism are the first known in file order, or empty."""
    rows = assays.withColumn("peptide", clean_or_reject(F.col("peptide"))).where(length_between(F.col("peptide"), *ASSAY_LENGTHS))
    return assay(rows, "peptide", F.startswith("qualitative", F.lit("Positive")), F.col("ord"), ["source_molecule", "source_organism"], "")


def sample_ids(df: DataFrame, group: str, key: str, n: int = 3) -> DataFrame:
    """A-35: how many keys a group has, and its first n in order; per (group, key) first, then a bounded list."""
    each = df.select(group, key).distinct()
    counts = each.groupBy(group).agg(F.count(F.lit(1)).alias("records"))
    from pyspark.sql import Window

    top = each.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("__n") <= n)
    few = top.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("sample"))
    return counts.join(few, group)


def collapse_windows(df: DataFrame, key: str, label: Column, order: Column, carried: list[str]) -> DataFrame:
    """A-05: one row of each window: the highest label, all other columns from its first row."""
    return df.groupBy(key).agg(F.max(label).alias("label"), F.min_by(F.struct(*carried), order).alias("__first")).select(key, "label", *[F.col(f"__first.`{c}`").alias(c) for c in carried])


def component_weights(members: DataFrame, component: str = "component", key: str = "peptide") -> DataFrame:
    """A-07: how many distinct keys each component has; duplicates go per (component, key) first."""
    return members.select(component, key).where(F.col(key).isNotNull()).distinct().groupBy(component).agg(F.count(F.lit(1)).alias("weight"))


def cohort_summary(df: DataFrame, cohort: str, value: str, enrichment: str) -> DataFrame:
    """A-23: rows, median, mean and share over zero of a count, and median enrichment, by cohort. Medians are taken from counts by distinct value."""
    each = df.groupBy(cohort, value).agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy(cohort).agg(F.sum("n").alias("n_rows"), F.percentile(value, 0.5, F.col("n")).alias("median"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.when(F.col(value) > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction"))
    rich = df.groupBy(cohort, enrichment).agg(F.count(F.lit(1)).alias("n")).groupBy(cohort).agg(F.percentile(enrichment, 0.5, F.col("n")).alias("median_enrichment"))
    return first.join(rich.hint("merge"), cohort)


def core_residues(df: DataFrame, seq: str = "sequence", k: int = 9) -> DataFrame:
    """A-22: (residue, n, share) over the residues of all k-windows, where an inner residue counts k times.

    A residue lies in as many windows as its distance from the nearer end allows, k at most. A task
    adds these weights up by letter over its sequences; a few numbers leave it.
    """
    from windloom.operators.coded import chunks

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros(128, np.int64)
        for _, letters, offsets in chunks(batches):
            if len(letters) and letters.max() > 127:
                raise ValueError("sequences are ASCII")
            n = np.diff(offsets)
            size = np.repeat(n, n)
            at = np.arange(len(letters)) - np.repeat(offsets[:-1], n)
            weight = np.maximum(0, np.minimum(np.minimum(at + 1, size - at), np.minimum(k, size - k + 1)))
            sums += np.bincount(letters, weight, 128).astype(np.int64)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([chr(x) for x in seen], pa.string()), pa.array(sums[seen])], names=["residue", "n"])

    counts = df.select(F.lit(0).alias("parent"), seq).mapInArrow(run, "residue string, n long").groupBy("residue").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("residue", "n", (F.col("n") / F.col("total")).alias("share"))
