"""Isotonic fits of all groups at once, and lookups in curves of many knots (L-04, L-06, F-17).

Pooling adjacent violators is mergeable: pooled blocks of neighbouring ranges can be pooled again and
give the blocks of all rows. So rows are dealt by ranges of (group, x), each task pools what it has of
each group as it streams by, and the blocks, few where values are noisy, meet once more by group. No group
has a job of its own, and a group that is on most rows is cut into ranges as well. The second step holds the
blocks of one group; where y rises with x everywhere these are as many as the distinct x.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.session import landed


class Pool:
    """Blocks of rising means over a stream that is sorted by x."""

    def __init__(self):
        self.lo: list[float] = []
        self.hi: list[float] = []
        self.total: list[float] = []
        self.weight: list[float] = []

    def add(self, lo: float, hi: float, total: float, weight: float) -> None:
        while self.lo and self.total[-1] * weight >= total * self.weight[-1]:
            total += self.total.pop()
            weight += self.weight.pop()
            lo = self.lo.pop()
            self.hi.pop()
        for column, value in zip((self.lo, self.hi, self.total, self.weight), (lo, hi, total, weight), strict=True):
            column.append(value)


BLOCKS = ("lo", "hi", "total", "weight")


def pooled(rows: DataFrame) -> DataFrame:
    """(g, lo, hi, total, weight): the blocks of each run of a group in rows sorted by (g, lo) within partitions."""
    kind = rows.schema["g"].dataType.simpleString()

    def run(batches: Iterator):
        import pyarrow as pa

        now, pool, key = None, None, None

        def out():
            n = len(pool.lo)
            return pa.RecordBatch.from_arrays([pa.array([now] * n, key), *[pa.array(getattr(pool, c), pa.float64()) for c in BLOCKS]], names=["g", *BLOCKS])

        for b in batches:
            key = b.schema.field(0).type
            for g, *block in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if pool is None or g != now:
                    if pool is not None:
                        yield out()
                    now, pool = g, Pool()
                pool.add(*block)
        if pool is not None:
            yield out()

    return rows.select("g", *BLOCKS).mapInArrow(run, f"g {kind}, lo double, hi double, total double, weight double")


def knots(df: DataFrame, group: str, x: str, y: str, weight: Column | None = None) -> DataFrame:
    """L-06: (group, x, y): the knots of each group's isotonic fit, both ends of each block.

    Rows with a null group, x or y are left out; equal x are averaged first.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("lo"), F.col(y).cast("double").alias("v"), w.alias("w")).where("g is not null and lo is not null and v is not null and w > 0")
    each = rows.groupBy("g", "lo").agg(F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("weight")).withColumn("hi", F.col("lo"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = landed(pooled(landed(each, "points").repartitionByRange(n, "g", "lo").sortWithinPartitions("g", "lo")), "blocks")
    blocks = pooled(first.repartition("g").sortWithinPartitions("g", "lo"))
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select(F.col("g").alias(group), F.explode(ends).alias(x), (F.col("total") / F.col("weight")).alias(y))


def interpolate(df: DataFrame, curves: DataFrame, group: str, x: str, y: str, out: str) -> DataFrame:
    """F-17: `out` is the group's curve at x, linear between knots and level outside; null where there is no curve or no x.

    Distinct (group, x) and the knots stand in one order, dealt by ranges. Within a range the knots before
    and after each point are carried to it; the last and first knot of each range go to the ranges beside
    it. A knot is one row, so curves may have any number of them.
    """
    asked = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x")).where("g is not null and x is not null").distinct().withColumn("k", F.lit(None).cast("struct<x: double, y: double>"))
    given = curves.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("k")).where("g is not null and x is not null")
    both = landed(asked.unionByName(given).groupBy("g", "x").agg(F.max("k").alias("k")), "curve-points")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = landed(both.repartitionByRange(n, "g", "x").withColumn("part", F.spark_partition_id()), "curve-ranges")
    inside = Window.partitionBy("part", "g").orderBy("x")
    near = placed.withColumn("prev", F.last("k", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.first("k", True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    ends = placed.groupBy("part", "g").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    across = Window.partitionBy("g").orderBy("part")
    ends = ends.select("part", "g", F.last("last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    met = near.join(ends.hint("merge"), ["part", "g"]).select(F.col("g").alias("__g"), F.col("x").alias("__x"), F.coalesce("prev", "before").alias("a"), F.coalesce("next", "after").alias("b"))
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    value = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (F.col("a.x") == F.col("b.x")), F.col("a.y")).otherwise(F.col("a.y") + slope * (F.col("__x") - F.col("a.x")))
    found = met.select("__g", "__x", value.alias(out))
    return df.join(found.hint("merge"), (df[group] == F.col("__g")) & (df[x].cast("double") == F.col("__x")), "left").drop("__g", "__x")
