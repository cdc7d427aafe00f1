"""Exact evaluation metrics as aggregations (M-*, O-05, O-13).

Scores are first counted by distinct value; what is global (ranks, cumulated counts) is then summed
over ranges of values with prefix sums between them, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.functions.scores import affinity_to_ic50, fold_error, propensity_to_rank
from windloom.operators.join import bounded
from windloom.operators.rank import exact_quantile, running_sum
from windloom.session import landed


def mid_ranks(df: DataFrame, value: str, group: list[str] = (), out: str = "mid_rank") -> DataFrame:
    """O-13: (group.., value, n, mid_rank): average ranks of tied values."""
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    summed = running_sum(counts, [value], "n", "__upto", group=group)
    return summed.withColumn(out, F.col("__upto") - (F.col("n") - 1) / 2).drop("__upto")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """M-01: Pearson correlation of the average ranks."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = mid_ranks(both, a, out="__ra").drop("n").withColumnRenamed(a, "__a")
    rb = mid_ranks(both, b, out="__rb").drop("n").withColumnRenamed(b, "__b")
    joined = both.join(ra.hint("merge"), both[a] == F.col("__a")).join(rb.hint("merge"), both[b] == F.col("__b"))
    return joined.agg(F.corr("__ra", "__rb").alias("spearman"), F.corr(a, b).alias("pearson"), F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, score: str, label: str, group: list[str] = ()) -> DataFrame:
    """M-02, M-11: by the rank sum of the positives; null unless both classes are there."""
    group = list(group)
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    by = running_sum(by, [score], "n", "__upto", group=group)
    ranked = by.withColumn("__rank", F.col("__upto") - (F.col("n") - 1) / 2)
    out = ranked.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"), F.sum(F.col("pos") * F.col("__rank")).alias("__sum"))
    auc = (F.col("__sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * F.col("n_neg")).cast("double")
    return out.withColumn("roc_auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc)).drop("__sum")


def by_threshold(df: DataFrame, score: str, label: str, group: list[str] = ()) -> DataFrame:
    """O-05: (group.., score, pos, n, tp, flagged) for each distinct score, highest first; ties together."""
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return running_sum(by, [score], ["pos", "n"], ["tp", "flagged"], descending=True, group=list(group))


def average_precision(df: DataFrame, score: str, label: str, group: list[str] = ()) -> DataFrame:
    """M-03: sum over thresholds of the recall gained times the precision there."""
    steps = by_threshold(df, score, label, group)
    return steps.groupBy(*group).agg(F.sum("pos").alias("n_pos"), (F.sum(F.col("pos") * F.col("tp") / F.col("flagged")) / F.sum("pos")).alias("average_precision"))


def grouped_spearman(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """M-01 by group: (group.., spearman)."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = mid_ranks(both, a, group, out="__ra").drop("n").withColumnRenamed(a, "__a")
    rb = mid_ranks(both, b, group, out="__rb").drop("n").withColumnRenamed(b, "__b")
    met = both.withColumn("__a", F.col(a)).withColumn("__b", F.col(b)).join(ra.hint("merge"), [*group, "__a"]).join(rb.hint("merge"), [*group, "__b"])
    return met.groupBy(*group).agg(F.corr("__ra", "__rb").alias("spearman"))


def teacher_agreement(df: DataFrame, scores: list[str], rank: str, strong: float = 0.5, weak: float = 2.0) -> DataFrame:
    """M-07: for each score column its rank correlation with the teacher's propensity, AUC and average precision of strong and of weak ranks.

    The scores are stacked first, so every score goes through the same aggregations at once. The
    inputs are checked as X-05 says.
    """
    require_inputs(df, scores, F.col(rank) <= strong)
    rows = df.where(F.col(rank).isNotNull())
    # Teacher's ranks are the same for every score: the rows get them once, as distances from the middle rank, and are then counted by score.
    teacher = mid_ranks(rows.select((-F.col(rank)).alias("__t")), "__t", out="__r")
    total = rows.count()
    middle = F.lit((total + 1) / 2)
    teacher = landed(teacher.select("__t", (F.col("__r") - middle).alias("__r")), "ranks")
    met = rows.withColumn("__t", -F.col(rank)).join(bounded(teacher), "__t")
    long = met.select(F.expr(f"stack({len(scores)}, " + ", ".join(f"'{c}', cast(`{c}` as double)" for c in scores) + ") as (name, value)"), "__r", *[(F.col(rank) <= c).cast("long").alias(n) for n, c in (("strong", strong), ("weak", weak))])
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("__r").alias("r"), F.sum(F.col("__r") * F.col("__r")).alias("rr"), *[F.sum(x).alias(x) for x in ("strong", "weak")])
    labels = ("strong", "weak")
    upto = running_sum(landed(counts, "counts"), ["value"], ["n", *labels], ["__n", *[f"__{x}" for x in labels]], group=["name"])
    own = F.col("__n") - (F.col("n") - 1) / 2
    away, n = own - middle, F.sum("n").cast("double")
    sums = [(F.sum(away * F.col("r")) / F.sqrt(F.sum(away * away * F.col("n")) * F.sum("rr"))).alias("spearman")]
    hits = rows.agg(*[F.count_if(F.col(rank) <= c) for c in (strong, weak)]).first()
    for x, h in zip(labels, hits, strict=True):
        p = F.sum(x).cast("double")
        sums.append(F.when((p > 0) & (p < n), (F.sum(F.col(x) * own) - p * (p + 1) / 2.0) / (p * (n - p))).alias(f"{x}_auc"))
        # Rows of a value and of all above it are those that are not below it.
        tp, flagged = F.lit(h) - F.col(f"__{x}") + F.col(x), F.lit(total) - F.col("__n") + F.col("n")
        sums.append((F.sum(F.col(x) * tp / flagged) / F.sum(x)).alias(f"{x}_ap"))
    return upto.groupBy("name").agg(*sums)


def channel_block(df: DataFrame, predicted: str, target: str, rank: str, group: list[str], cutoff: float = 2.0, raw: str | None = None) -> DataFrame:
    """M-10: by split and channel rows, rank correlation with the rank and, where `raw` is named, with the raw score, errors, binder prevalence and average precision (null with one class alone)."""
    marked = df.withColumn("__binder", F.col(rank) <= cutoff).withColumn("__support", -F.col(rank))
    d = F.col(predicted) - F.col(target)
    base = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.col("__binder").cast("double")).alias("prevalence"))
    rho = grouped_spearman(marked, predicted, "__support", group)
    ap = average_precision(marked, predicted, "__binder", group).drop("n_pos")
    met = base.join(rho.hint("merge"), group, "left").join(ap.hint("merge"), group, "left")
    if raw:
        met = met.join(grouped_spearman(df, predicted, raw, group).withColumnRenamed("spearman", "spearman_raw").hint("merge"), group, "left")
    return met.withColumn("auprc", F.when((F.col("prevalence") > 0) & (F.col("prevalence") < 1), F.col("average_precision"))).drop("average_precision")


def group_wins(df: DataFrame, base: str, other: str, label: str, group: str, least: int = 25) -> DataFrame:
    """M-11: over groups with `least` rows and both classes: their number, mean AUC of two scores and how often the other wins."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    a = roc_auc(df, base, label, [group]).select(group, F.col("roc_auc").alias("base"))
    b = roc_auc(df, other, label, [group]).select(group, F.col("roc_auc").alias("other"))
    met = counts.join(a.hint("merge"), group).join(b.hint("merge"), group).where("base is not null and other is not null")
    return met.agg(F.count(F.lit(1)).alias("n_groups"), F.avg("base").alias("base_auc"), F.avg("other").alias("other_auc"), F.count_if(F.col("other") > F.col("base")).alias("wins"))


def paired_deltas(arms: DataFrame, arm: str, key: list[str], value: str, base: str, other: str) -> DataFrame:
    """M-12: (key.., base, other, delta) of keys that both arms have."""
    pick = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    return arms.groupBy(*key).agg(pick(base).alias("base"), pick(other).alias("other")).where("base is not null and other is not null").withColumn("delta", F.col("other") - F.col("base"))


def top_percent_agreement(df: DataFrame, true_rank: str, predicted: str, percent: float = 5.0) -> DataFrame:
    """O-12: of the rows in the lowest `percent` of true ranks, the share in the highest of predictions."""
    low, high = exact_quantile(df, true_rank, percent / 100), exact_quantile(df, predicted, 1 - percent / 100)
    top, found = F.col(true_rank) <= F.lit(low), F.col(predicted) >= F.lit(high)
    return df.agg(F.count_if(top).alias("n_top"), (F.count_if(top & found) / F.greatest(F.lit(1), F.count_if(top))).alias("agreement"))


def counts_at(df: DataFrame, value: str, cutoffs: list[float]) -> DataFrame:
    """M-15: (cutoff, n_at, n_above): rows at or under each of several cutoffs, in one pass."""
    made = df.agg(*[F.count_if(F.col(value) <= c).alias(f"c{i}") for i, c in enumerate(cutoffs)], F.count(value).alias("n"))
    return made.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"c{i}").alias("n_at"), (F.col("n") - F.col(f"c{i}")).alias("n_above")) for i, c in enumerate(cutoffs)])).alias("r")).select("r.*")


def selective(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """M-16: (threshold, coverage, accuracy, enrichment) of the rows whose confidence is at or over each distinct value."""
    steps = by_threshold(df, confidence, correct)
    n, pos = df.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).agg(F.count(F.lit(1)), F.sum(F.col(correct).cast("long"))).first()
    share = F.col("tp") / F.col("flagged")
    return steps.select(F.col(confidence).alias("threshold"), (F.col("flagged") / F.lit(max(1, n))).alias("coverage"), share.alias("accuracy"), (share / F.lit((pos or 0) / max(1, n) or None)).alias("enrichment"))


class InputError(ValueError):
    pass


def inputs(df: DataFrame, scores: list[str], label: Column) -> DataFrame:
    """X-05: (n_rows, n_not_finite, n_pos, n_neg) of metric inputs, in one pass."""
    bad = F.lit(False)
    for c in scores:
        x = F.col(c).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_not_finite"), F.count_if(label).alias("n_pos"), F.count_if(~label).alias("n_neg"))


def require_inputs(df: DataFrame, scores: list[str], label: Column) -> None:
    """X-05: raise unless all scores are finite and both classes are there."""
    n, bad, pos, neg = inputs(df, scores, label).first()
    if bad or not pos or not neg:
        raise InputError(f"{n} rows: {bad} scores that are not finite, {pos} positive, {neg} negative")


def error_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """M-04."""
    d = F.col(predicted) - F.col(actual)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d * d).alias("mse"), F.avg(((F.col(predicted) > 0.5) == (F.col(actual) > 0.5)).cast("double")).alias("accuracy"))


def calibration(df: DataFrame, p: str, label: str, bins: int = 15) -> DataFrame:
    """M-05: expected calibration error over equal left-closed bins, 1.0 in the last."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    each = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def recall_points(df: DataFrame, score: str, label: str, targets: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """M-09: for each recall target the highest threshold that reaches it, with precision and rows flagged. Tied scores are flagged together."""
    steps = by_threshold(df, score, label)
    total = df.where(F.col(score).isNotNull()).agg(F.sum(F.col(label).cast("long"))).first()[0] or 0
    steps = steps.withColumn("recall", F.col("tp") / F.lit(float(max(1, total)))).withColumn("precision", F.col("tp") / F.col("flagged"))
    wanted = steps.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets]))).where(F.col("recall") >= F.col("target"))
    return wanted.groupBy("target").agg(F.max(score).alias("threshold"), F.max_by("recall", score).alias("recall"), F.max_by("precision", score).alias("precision"), F.max_by("flagged", score).alias("flagged"))


def operating_points(df: DataFrame, key: str, propensity: str, rank: str, binder: float = 0.5, targets: tuple[float, ...] = (0.80, 0.90, 0.95, 0.99)) -> DataFrame:
    """M-09: (target, threshold, implied_rank, recall, precision, n_flagged, default_flagged, default_recall, default_precision).

    Rows are flagged one by one, highest propensity first and equal ones by the (numeric) key; a point
    is the first row at which the recall of the teacher's binders reaches the target. The default rule
    flags rows whose predicted rank is at most `binder`. A target that is not reached has no row.
    """
    positive = F.col(rank) <= binder
    require_inputs(df, [propensity], positive)
    rows = df.select(F.col(propensity).cast("double").alias("p"), (-F.col(key)).alias("k"), positive.cast("long").alias("pos"), F.lit(1).cast("long").alias("one"))
    flagged = propensity_to_rank(F.col("p")) <= binder
    total, n_default, tp_default = rows.agg(F.sum("pos"), F.count_if(flagged), F.count_if(flagged & (F.col("pos") == 1))).first()
    # Rows are counted by propensity first; only those of the few propensities at which a target is reached are put in order.
    counts = rows.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("one").alias("one"))
    recall = F.col("tp") / F.lit(float(total))
    reached = F.explode(F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: recall >= t)).alias("target")
    steps = running_sum(counts, ["p"], ["pos", "one"], ["tp", "flagged"], descending=True)
    met = steps.select("p", (F.col("tp") - F.col("pos")).alias("tp0"), (F.col("flagged") - F.col("one")).alias("n0"), reached).groupBy("target").agg(F.max_by(F.struct("p", "tp0", "n0"), "p").alias("x")).select("target", "x.*").collect()  # a row for each target
    at = {r["p"]: (r["tp0"], r["n0"]) for r in met}
    if not at:
        return df.sparkSession.createDataFrame([], "target double, threshold double, implied_rank double, recall double, precision double, n_flagged long, default_flagged long, default_recall double, default_precision double")
    ties = rows.where(F.col("p").isin(*at))
    own = running_sum(ties, ["k"], ["pos", "one"], ["tp", "flagged"], descending=True, group=["p"])
    start = lambda i: F.coalesce(*[F.when(F.col("p") == p, x[i]) for p, x in at.items()])
    steps = own.withColumns({"tp": F.col("tp") + start(0), "flagged": F.col("flagged") + start(1)})
    wanted = steps.select("p", "tp", "flagged", recall.alias("recall"), reached).where(F.coalesce(*[F.when(F.col("target") == r["target"], F.col("p") == r["p"]) for r in met]))
    first = wanted.groupBy("target").agg(F.min_by(F.struct("p", "tp", "flagged", "recall"), "flagged").alias("x"))
    point = first.select("target", F.col("x.p").alias("threshold"), propensity_to_rank(F.col("x.p")).alias("implied_rank"), "x.recall", (F.col("x.tp") / F.col("x.flagged")).alias("precision"), F.col("x.flagged").alias("n_flagged"))
    return point.withColumns({"default_flagged": F.lit(n_default).cast("long"), "default_recall": F.lit(tp_default / total), "default_precision": F.lit(tp_default / max(1, n_default))})


def grouped_median(df: DataFrame, value: str, group: list[str], out: str) -> DataFrame:
    """(group.., out): the exact median of each group, from counts by distinct value that are summed over ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_sum(counts, ["__v"], "__n", "__upto", group=group)
    total = counts.groupBy(*group).agg(F.sum("__n").alias("__total"))
    met = upto.join(total.hint("merge"), group)
    lower, upper = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    at = lambda i: F.min(F.when(F.col("__upto") > i, F.col("__v")))
    return met.groupBy(*group).agg(((at(lower) + at(upper)) / 2).alias(out))


def affinity_block(df: DataFrame, predicted: str, actual: str, group: list[str], binder: float = 500.0) -> DataFrame:
    """M-10, M-13: by group the score error, rank correlation with the IC50, median and 2x and 5x shares of the fold error, binder prevalence, the binders' median fold error and average precision (null without binders, or with binders alone)."""
    p, a = affinity_to_ic50(F.col(predicted)), affinity_to_ic50(F.col(actual))
    rows = df.select(*group, F.col(predicted).alias("p"), F.col(actual).alias("a"), (-a).alias("support"), fold_error(p, a).alias("fold"), (a <= binder).alias("binder"))
    share = lambda c: F.avg(c.cast("double"))
    base = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(F.col("p") - F.col("a"))).alias("score_mae"), share(F.col("binder")).alias("prevalence"), share(F.col("fold") <= 2).alias("within_2x"), share(F.col("fold") <= 5).alias("within_5x"))
    parts = [
        grouped_spearman(rows, "p", "support", group),
        grouped_median(rows, "fold", group, "median_fold"),
        grouped_median(rows.where("binder"), "fold", group, "median_fold_binders"),
        average_precision(rows, "p", "binder", group).drop("n_pos"),
    ]
    for part in parts:
        base = base.join(part.hint("merge"), group, "left")
    return base.withColumn("auprc", F.when((F.col("prevalence") > 0) & (F.col("prevalence") < 1), F.col("average_precision"))).drop("average_precision")


def bootstrap(df: DataFrame, key: str, value: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """M-08 for a mean: its average and 95% interval by Poisson(1) weights from a hash of row and replicate; each task pre-aggregates its rows by replicate. `resample.intervals` has the other metrics."""
    u = (F.pmod(F.xxhash64(F.col(key), "replicate", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cdf, p, weight = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(14):  # beyond what 30 bits tell from 1
        cdf += p
        weight = weight + F.when(u > cdf, 1).otherwise(0)
        p /= k + 1
    drawn = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("__w", weight)
    means = drawn.groupBy("replicate").agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias("m")).where("m is not null")
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
