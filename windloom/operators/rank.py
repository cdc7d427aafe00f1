"""Ranking, runs and selection within groups, and global cumulative sums without one giant task (O-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """Row numbers in the order of string or number columns, by two-level prefix sums.

    Rows are dealt by ranges of the first order column; each range is numbered by itself and offset
    by the sizes of the ranges before it. Only one row per range is summed in one task.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / n for i in range(1, n)]
    kind = df.schema[order[0]].dataType.typeName()
    if kind == "string":  # equal-width prefixes of a hash
        bucket = F.substring(F.col(order[0]), 1, 3)
    elif share:
        cuts = sorted(set(x for x in (df.agg(F.percentile_approx(order[0], share, 10 * n)).first()[0] or []) if x is not None))
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(order[0])))
    else:
        bucket = F.lit(0)
    placed = df.withColumn("__b", bucket)
    sizes = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return placed.withColumn("__own", own).join(before.hint("shuffle_hash"), "__b").withColumn(out, F.col("__own") + F.col("__before")).drop("__b", "__own", "__before")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """O-02: the first k rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def spaced_peaks(windows: Column, most: int, apart: Column | None = None) -> Column:
    """O-03, O-04: a greedy choice from an array of (start, end, ..) structs sorted best first.

    A window is taken unless it overlaps one taken before (or is nearer than `apart` to its start).
    """
    clash = (lambda a, w: F.abs(a["start"] - w["start"]) < apart) if apart is not None else (lambda a, w: (a["start"] < w["end"]) & (w["start"] < a["end"]))
    return F.aggregate(windows, F.filter(windows, lambda w: F.lit(False)), lambda acc, w: F.when((F.size(acc) >= most) | F.exists(acc, lambda a: clash(a, w)), acc).otherwise(F.array_append(acc, w)))


def islands(df: DataFrame, group: list[str], pos: str) -> DataFrame:
    """O-07: runs of consecutive integers as (lo, hi, length)."""
    w = Window.partitionBy(*group).orderBy(pos)
    return df.withColumn("__run", F.col(pos) - F.row_number().over(w)).groupBy(*group, "__run").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count(F.lit(1)).alias("length")).drop("__run")


def covering_segment(positions: DataFrame, hotspots: DataFrame, group: str, pos: str) -> DataFrame:
    """O-07: (group, lo, hi, covered): of each group's runs of consecutive positions that which holds most distinct hotspots, then the longest, then the first.

    A position knows its run by itself, so hotspots meet their run on (group, position).
    """
    w = Window.partitionBy(group).orderBy(pos)
    placed = positions.select(group, pos).distinct().withColumn("__run", F.col(pos) - F.row_number().over(w))
    marked = placed.join(hotspots.select(group, pos).distinct().withColumn("__hot", F.lit(1)).hint("merge"), [group, pos], "left")
    runs = marked.groupBy(group, "__run").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count("__hot").alias("covered"))
    best = runs.groupBy(group).agg(F.max_by(F.struct("lo", "hi", "covered"), F.struct("covered", F.col("hi") - F.col("lo"), -F.col("lo"))).alias("x"))
    return best.select(group, "x.*")


def moving_mean(df: DataFrame, group: list[str], pos: str, value: str, width: int) -> DataFrame:
    """O-06: mean and count over the `width` positions from each on."""
    w = Window.partitionBy(*group).orderBy(pos).rowsBetween(0, width - 1)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("observed", F.count(value).over(w))


def percentile_against(queries: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """O-10, O-11: each query with the percentage of reference values below it.

    Reference values are counted first; queries and counts then meet in one order, in ranges with
    prefix sums between them, and no pair of a query and a reference value is made.
    """
    total = reference.where(F.col(value).isNotNull()).count()
    counts = reference.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    distinct = queries.select(F.col(value).alias("__v")).where("__v is not null").distinct().withColumn("__n", F.lit(0).cast("long")).withColumn("__q", F.lit(0))
    both = distinct.unionByName(counts.withColumn("__q", F.lit(1)))
    summed = running_sum(both, ["__v", "__q"], "__n", "__below")
    below = summed.where("__q = 0").select("__v", (100.0 * F.col("__below") / F.lit(total)).alias("percentile")) if total else distinct.select("__v", F.lit(None).cast("double").alias("percentile"))
    return queries.join(below.hint("merge"), queries[value] == F.col("__v"), "left").drop("__v")


def running_sum(df: DataFrame, order: list[str], value: str | list[str], out: str | list[str], descending: bool = False, group: list[str] = ()) -> DataFrame:
    """Sum of `value` (or of several) up to each row in an order of numbers, global or by group, by ranges and prefix sums between them.

    All groups share the ranges, so a large group is cut into many and a task sees one range of one
    group; of each only one row goes on to the sums between ranges.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    n, by = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*group, "__b"]
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(order[0]).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    # The optimizer does not see a column that only a lambda names, and moves filters on it to where it is missing: the NaN case names it outside.
    bucket = F.when(F.isnan(F.col(order[0]).cast("double")), len(cuts)).otherwise(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(order[0])))) if cuts else F.lit(0)
    placed = df.withColumn("__b", (-bucket if descending else bucket).cast("int"))
    sizes = placed.groupBy(*by).agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(values)])
    upto = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, *[F.coalesce(F.sum(f"__s{i}").over(upto), F.lit(0)).alias(f"__before{i}") for i in range(len(values))])
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({f"__own{i}": F.sum(v).over(w) for i, v in enumerate(values)}).join(before.hint("shuffle_hash"), by)
    made = own.withColumns({o: F.col(f"__own{i}") + F.col(f"__before{i}") for i, o in enumerate(outs)})
    return made.drop("__b", *[f"__{k}{i}" for k in ("own", "before") for i in range(len(values))])


def preferred(df: DataFrame, group: list[str], is_preferred: Column, order: list[Column], k: int = 3) -> DataFrame:
    """O-08: the first k rows of each group, preferred ones before all others, then by `order`."""
    return top_k(df.withColumn("__second", ~F.coalesce(is_preferred, F.lit(False))), group, [F.col("__second"), *order], k).drop("__second")


def exact_quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """The interpolated quantiles of all rows: counts by distinct value, summed over ranges; two values for each quantile come to the driver. None where there is no value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0]
    if not total:
        return [None] * len(qs)
    at = [q * (total - 1) for q in qs]
    ranks = sorted({r for x in at for r in (int(x), min(total - 1, int(x) + 1))})
    upto = running_sum(counts, ["__v"], "__n", "__upto")
    found = dict(zip(ranks, upto.agg(*[F.min(F.when(F.col("__upto") > r, F.col("__v"))) for r in ranks]).first()))
    return [found[int(x)] + (found[min(total - 1, int(x) + 1)] - found[int(x)]) * (x - int(x)) for x in at]


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """One of `exact_quantiles`."""
    return exact_quantiles(df, value, [q])[0]
