"""Sets of names as bitmaps, and set operations on windows and metric names (U-02, U-03, J-11, F-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.operators.rank import global_row_number

#: Positions of one bitmap, Spark's own size.
BITMAP = 1 << 15


def numbered(items: DataFrame, item: str) -> DataFrame:
    """(__item, __n): every distinct name with a number from 0, in the order of names."""
    names = items.select(F.col(item).cast("string").alias("__item")).where("__item is not null").distinct()
    return global_row_number(names, ["__item"], "__n").withColumn("__n", F.col("__n") - 1)


def bitmaps(rows: DataFrame, key: str, item: str, numbers: DataFrame) -> DataFrame:
    """(key, block, bits): the set of each key as bitmaps of BITMAP numbers; repeats count once."""
    met = rows.select(key, F.col(item).cast("string").alias("__item")).join(numbers.hint("merge"), "__item")
    return met.groupBy(key, F.shiftright("__n", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("__n").bitwiseAND(BITMAP - 1)).alias("bits"))


def intersection(sets: list[DataFrame], key: str) -> DataFrame:
    """(key, block, bits, n): what all the sets of a key have in common; blocks that a set lacks are left out."""
    every = None
    for s in sets:
        every = s if every is None else every.unionByName(s)
    both = every.groupBy(key, "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("__sets")).where(F.col("__sets") == len(sets)).drop("__sets")
    return both.withColumn("n", F.bitmap_count("bits")).where("n > 0")


def union(sets: DataFrame, key: str) -> DataFrame:
    """(key, block, bits, n): the union of the bitmaps of a key."""
    return sets.groupBy(key, "block").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits"))


def names_of(found: DataFrame, key: str, item: str, numbers: DataFrame) -> DataFrame:
    """(key, item): the names in bitmaps; a bitmap unfolds byte by byte where it has bits."""
    text = F.hex("bits")
    cells = F.filter(F.transform(F.sequence(F.lit(0), F.octet_length("bits") - 1), lambda i: F.struct(i.alias("i"), F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("b"))), lambda x: x["b"] > 0)
    each = found.select(key, "block", F.explode(cells).alias("x")).select(key, "block", "x.i", "x.b", F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("bit"))
    on = each.where(F.col("b").bitwiseAND(F.expr("shiftleft(1, bit)")) > 0).select(key, (F.col("block") * BITMAP + F.col("i") * 8 + F.col("bit")).alias("__n"))
    return on.join(numbers.hint("merge"), "__n").select(key, F.col("__item").alias(item))


def shared_names(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """U-03: (key, shared): the sorted names that both tables have for a key, empty where there are none."""
    numbers = numbered(left.select(item).unionByName(right.select(item)), item)
    both = intersection([bitmaps(left, key, item, numbers), bitmaps(right, key, item, numbers)], key)
    lists = names_of(both, key, "name", numbers).groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("shared"))
    keys = left.select(key).unionByName(right.select(key)).distinct()
    return keys.join(lists.hint("merge"), key, "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))


def common_to_all(rows: DataFrame, group: str, item: str) -> DataFrame:
    """U-03: the items that every group has."""
    each = rows.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    n = each.select(group).distinct().count()
    return each.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n).drop("__n")


def distinct_union(*tables: DataFrame) -> DataFrame:
    """U-02: the rows that any of the tables has, each once; every table drops its repeats before they meet."""
    out = None
    for t in tables:
        out = t.distinct() if out is None else out.unionByName(t.distinct())
    return out.distinct()
