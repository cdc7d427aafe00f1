"""Sampling and leak-free splits (G-*). Every random choice is the order of a hash, so it repeats anywhere."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.operators.rank import exact_quantiles, global_row_number, running_sum


def order_hash(seed: int | str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def group_split(df: DataFrame, group: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """G-01, G-03: (group, split): distinct groups in hash order, the first floor(n*r0) train, then floor(n*r1) val, the rest test."""
    groups = df.select(group).distinct().withColumn("__h", order_hash(seed, F.col(group)))
    ranked = global_row_number(groups, ["__h", group], "__rn")
    n = groups.count()
    a = int(n * ratios[0])
    b = a + int(n * ratios[1])
    return ranked.select(group, F.when(F.col("__rn") <= a, "train").when(F.col("__rn") <= b, "val").otherwise("test").alias("split"))


def neighbourhood(parent: Column, start: Column, width: int = 5) -> Column:
    """G-02: the cluster of windows that begin within the same `width` positions."""
    return F.concat(parent.cast("string"), F.lit("_nbhd"), F.floor(start / width).cast("string"))


def inherit_split(new: DataFrame, existing: DataFrame, parent: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """J-09: parents keep the split they have, others get one."""
    old = existing.select(parent, "split").groupBy(parent).agg(F.min("split").alias("__old"))
    missing = new.select(parent).join(old, parent, "left_anti")
    return new.join(old, parent, "left").join(group_split(missing, parent, ratios, seed).withColumnRenamed("split", "__new"), parent, "left").withColumn("split", F.coalesce("__old", "__new")).drop("__old", "__new")


def fold_split(fold: Column) -> Column:
    """G-06."""
    return F.when(fold == 0, "test").when(fold == 1, "val").otherwise("train")


def rotations(df: DataFrame, fold: str = "fold", n: int = 5) -> DataFrame:
    """G-07: each row in each of n rotations; a null fold stays outside."""
    out = df.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("split", F.when(F.col(fold).isNull(), "challenge").when(F.col(fold) == F.col("rotation"), "test").when(F.col(fold) == (F.col("rotation") + 1) % n, "val").otherwise("train"))


def fold_ties(n_folds: int, seed: int | str) -> list[int]:
    """The rank of each fold where loads are equal: the order of a hash."""
    order = sorted(range(n_folds), key=lambda f: hashlib.sha256(f"{seed}:fold:{f}".encode()).hexdigest())
    return [order.index(f) for f in range(n_folds)]


def pour(load: list[int], ties: list[int], weight: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """Greedy placement of `count` equal components: (spans, loads after).

    A span (first, folds) says that component number i from `first` on goes to folds[(i - first) % len(folds)].
    While the loads lie between two of the loads before, the same folds take turns, in the order of what
    they have beyond the lower one; so there is a span for each fold at most, whatever the count.
    """
    if weight <= 0:  # the lightest fold stays the lightest
        return [(0, [min(range(len(load)), key=lambda f: (load[f], ties[f]))])], list(load)
    levels = sorted(set(load))
    spans, now, done = [], list(load), 0
    for i, level in enumerate(levels):
        if done == count:
            break
        turn = sorted((f for f in range(len(load)) if load[f] <= level), key=lambda f: ((load[f] - level) % weight, ties[f]))
        room = count - done
        if i + 1 < len(levels):
            room = min(room, sum(max(0, -(-(levels[i + 1] - now[f]) // weight)) for f in turn))
        if room:
            spans.append((done, turn))
            for j, f in enumerate(turn):
                now[f] += weight * ((room - j + len(turn) - 1) // len(turn))
            done += room
    return spans, now


def pack_folds(weights: DataFrame, n_folds: int = 5, seed: int | str = 0) -> DataFrame:
    """G-05: (component, fold): components by falling weight, equal ones by hash, each to the lightest fold, of equal folds that with the least hash.

    Components of one weight are placed at once in closed form, so the serial state has one row for each
    distinct weight, of which there are at most the square root of twice the total. Within a weight,
    components are numbered by ranges of their hash with prefix sums between them. Weights are whole
    numbers, not negative; null components are left out.
    """
    if n_folds < 2:
        raise ValueError(f"n_folds must be at least 2, not {n_folds}")
    rows = weights.where("component is not null").select("component", F.col("weight").cast("long").alias("weight"), order_hash(seed, F.col("component")).alias("__h"))
    runs = rows.groupBy("weight").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("weight")).collect()
    load, ties, plan = [0] * n_folds, fold_ties(n_folds, seed), []
    for r in runs:
        spans, load = pour(load, ties, r["weight"], r["m"])
        plan.append((r["weight"], [s for s, _ in spans], [t for _, t in spans]))
    spans = weights.sparkSession.createDataFrame(plan, "weight long, firsts array<long>, turns array<array<int>>")
    rows = rows.withColumn("__p", F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")).withColumn("__one", F.lit(1))
    ranked = running_sum(rows, ["__p", "__h", "component"], "__one", "__i", group=["weight"])
    met = ranked.join(spans.hint("merge"), "weight").withColumn("__i", F.col("__i") - 1)
    at = F.size(F.filter("firsts", lambda x: x <= F.col("__i")))
    turn, first = F.element_at("turns", at), F.element_at("firsts", at)
    return met.select("component", F.element_at(turn, ((F.col("__i") - first) % F.size(turn) + 1).cast("int")).alias("fold"))


def quantile_sample(df: DataFrame, target: int, col: str, key: str, bins: int = 10, seed: int = 0) -> DataFrame:
    """G-09: `target` rows spread over quantile bins (right-closed, equal edges dropped), topped up from the rest."""
    if df.count() <= target:
        return df
    edges = sorted({x for x in exact_quantiles(df, col, [i / bins for i in range(bins + 1)]) if x is not None})
    inner = edges[1:-1]
    b = sum((F.when(F.col(col) > e, 1).otherwise(0) for e in inner), F.lit(0))
    each = target // max(1, len(edges) - 1)
    w = Window.partitionBy("__bin").orderBy(order_hash(seed, F.col(key)), key)
    ranked = df.withColumn("__bin", b).withColumn("__rn", F.row_number().over(w))
    first = ranked.where(F.col("__rn") <= each)
    short = target - first.count()
    rest = ranked.where(F.col("__rn") > each).orderBy(order_hash(f"{seed}t", F.col(key)), key).limit(max(0, short))
    return first.unionByName(rest).drop("__bin", "__rn")


def split_sample(df: DataFrame, target: int, key: str, shares: tuple = (("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 0) -> DataFrame:
    """G-10: `target` rows with fixed shares of the splits; what a split lacks is topped up from the others."""
    have = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    quota = {s: min(have.get(s, 0), int(target * x)) for s, x in shares}
    w = Window.partitionBy("split").orderBy(order_hash(seed, F.col(key)), key)
    ranked = df.withColumn("__rn", F.row_number().over(w))
    limit = F.lit(0)
    for s, q in quota.items():
        limit = F.when(F.col("split") == s, q).otherwise(limit)
    first = ranked.where(F.col("__rn") <= limit)
    rest = ranked.where(F.col("__rn") > limit).orderBy(order_hash(f"{seed}t", F.col(key)), key).limit(max(0, target - sum(quota.values())))
    return first.unionByName(rest).drop("__rn")


def subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """G-11: exactly n rows (or all), by hash order."""
    return df.orderBy(order_hash(seed, F.col(key)), key).limit(n)


#: Novelty bins by priority, and the split of a component by the highest of its parents.
NOVELTY = ("unscored", "natural_like", "similar", "distant", "novel")
NOVELTY_SPLIT = ("exclude", "train", "train", "val", "test")


def novelty_split(members: DataFrame, component: str = "component", novelty: str = "novelty") -> DataFrame:
    """G-12: (component, priority, split) by the highest novelty of a component's parents."""
    priority = F.coalesce(F.try_element_at(F.create_map(*[x for i, n in enumerate(NOVELTY) for x in (F.lit(n), F.lit(i))]), F.col(novelty)), F.lit(0))
    out = members.groupBy(component).agg(F.max(priority).alias("priority"))
    return out.withColumn("split", F.element_at(F.array(*[F.lit(s) for s in NOVELTY_SPLIT]), F.col("priority") + 1))


def hide_labels(df: DataFrame, group: str, label: str, share: float, seed: int = 0) -> DataFrame:
    """G-13: keep the labels of a share of the groups (one at least), null in the others."""
    groups = df.select(group).distinct().withColumn("__h", order_hash(seed, F.col(group)))
    keep = max(1, int(groups.count() * share))
    ranked = global_row_number(groups, ["__h", group], "__rn").select(group, (F.col("__rn") <= keep).alias("__keep"))
    return df.join(ranked, group).withColumn(label, F.when(F.col("__keep"), F.col(label))).drop("__keep")


def category_holdout(df: DataFrame, category: str, group: str, most: int = 4, least_rows: int = 3000, seed: int = 0) -> DataFrame:
    """G-14: for each of the largest categories (not "unknown"), half of its groups adapt and half test; all else is source."""
    top = df.where(F.col(category) != "unknown").groupBy(category).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows).orderBy(F.desc("n"), category).limit(most)
    held = df.join(F.broadcast(top.select(category)), category).select(F.col(category).alias("held_out"), group).distinct()  # `most` rows
    half = held.withColumn("part", F.when(F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(2)) == 0, "adapt").otherwise("test"))
    rows = df.crossJoin(F.broadcast(top.select(F.col(category).alias("held_out"))))
    return rows.join(half.hint("merge"), ["held_out", group], "left").withColumn("part", F.when(F.col(category) == F.col("held_out"), F.col("part")).otherwise("source"))


def panel_sample(df: DataFrame, panel: str, key: str, most: int = 120, seed: int = 0) -> DataFrame:
    """G-15: up to `most` keys of each panel by hash order, whole."""
    w = Window.partitionBy(panel).orderBy(order_hash(seed, F.col(key)), key)
    chosen = df.select(panel, key).distinct().withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).select(panel, key)
    return df.join(chosen, [panel, key], "left_semi")


def sample_weight(*ranks: Column) -> Column:
    """G-16: 1 + 4 * the share of channels with a rank of at most 2."""
    return 1 + 4 * sum(F.when(r <= 2, 1.0).otherwise(0.0) for r in ranks) / len(ranks)
