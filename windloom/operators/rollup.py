"""Roll-ups of window scores to residues and whole sequences (A-24 to A-31, O-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.functions.scores import rank_support, risk_band
from windloom.operators.rank import top_k


def protein_risk(windows: DataFrame, parent: str = "parent", risk: str = "risk", confidence: str = "confidence", start: str = "start", k: int = 5, threshold: float = 0.5) -> DataFrame:
    """A-24: per parent the number of windows, mean of the k highest risks, maximum with its start and confidence, and how many reach the threshold."""
    w = Window.partitionBy(parent).orderBy(F.desc(risk), start)
    ranked = windows.withColumn("__rn", F.row_number().over(w))
    best = F.struct(F.col(risk), (-F.col(start)).alias("__s"))
    return ranked.groupBy(parent).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg(F.when(F.col("__rn") <= k, F.col(risk))).alias("topk_mean"),
        F.max(risk).alias("max_risk"),
        F.max_by(start, best).alias("max_start"),
        F.count_if(F.col(risk) >= threshold).alias("n_high"),
        F.avg(confidence).alias("mean_confidence"),
        F.max_by(confidence, best).alias("confidence_at_max"),
    )


def residue_track(windows: DataFrame, lengths: DataFrame, parent: str = "parent", value: str = "risk", confidence: str | None = None) -> DataFrame:
    """A-25, A-26: max, mean (rounded half-even to 6 places) and count of the windows over each residue, and the confidence of the first highest one; residues without a window get 0. Spans are clipped to the sequence.

    A window contributes to as many residues as it is long, and the position spine comes from the
    length alone, so rows grow with residues times window width and never with pairs of windows.
    """
    more = [F.col(confidence).alias("__c")] if confidence else []
    out = on_spine(
        windows.select(parent, "start", "end", F.col(value).alias("__v"), *more), lengths, parent,
        F.max("__v").alias("max_value"),
        F.avg("__v").alias("mean_value"),
        F.count("__v").alias("n"),
        *([F.max_by("__c", F.struct("__v", -F.col("start"))).alias("confidence")] if confidence else []),
    )
    return out.select(parent, "pos", F.coalesce("max_value", F.lit(0.0)).alias("max_value"), F.bround(F.coalesce("mean_value", F.lit(0.0)), 6).alias("mean_value"), F.coalesce("n", F.lit(0)).alias("n"), *([F.coalesce("confidence", F.lit(0.0)).alias("confidence")] if confidence else []))


def spread(windows: DataFrame, parent: str) -> DataFrame:
    """A row of each window for each residue `pos` from 0 on."""
    return windows.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("start"), F.lit(0)), F.col("end") - 1)))


def on_spine(windows: DataFrame, lengths: DataFrame, parent: str, *values: Column) -> DataFrame:
    """A row for each residue of the sequences, with aggregates of the windows over it.

    A sequence is one more window over its whole length, without values. Windows are dealt by parent before they
    are spread, so what is wide is aggregated where it is made, and nothing is joined.
    """
    spine = lengths.where("length > 0").select(parent, F.lit(0).alias("start"), F.col("length").alias("end"), F.lit(1).alias("__spine"))
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = windows.where(F.col("end") > F.greatest(F.col("start"), F.lit(0))).unionByName(spine, allowMissingColumns=True).repartition(n, parent)
    each = spread(both, parent).groupBy(parent, "pos").agg(*values, F.count("__spine").alias("__spine"))
    return each.where("__spine > 0").drop("__spine")


def surrogate_tracks(windows: DataFrame, lengths: DataFrame, parent: str, risk: str, presentation: str, binding: str) -> DataFrame:
    """A-28: by residue the highest risk, mean presentation and mean binding of the windows over it, 0 where none has a value."""
    each = on_spine(windows.select(parent, "start", "end", risk, presentation, binding), lengths, parent, F.max(risk).alias("risk_max"), F.avg(presentation).alias("presentation_mean"), F.avg(binding).alias("binding_mean"))
    return each.select(parent, "pos", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("risk_max", "presentation_mean", "binding_mean")])


def profile_track(windows: DataFrame, lengths: DataFrame, parent: str, start: str, profile: str, weight: Column | None = None, absolute: bool = False) -> DataFrame:
    """A-27: (parent, pos, heat): one of `profile_tracks`, divided by the largest (absolute) value."""
    return profile_tracks(windows, lengths, parent, start, profile, weight).select(parent, "pos", F.col("saliency" if absolute else "heat").alias("heat"))


def profile_tracks(windows: DataFrame, lengths: DataFrame, parent: str, start: str, profile: str, weight: Column | None = None) -> DataFrame:
    """A-27: (parent, pos, heat, saliency): the mean over windows of their profiles' values, one for each offset, times the window's weight; divided by the parent's largest value, and by its largest absolute one, where that is positive.

    Offsets beyond the sequence are left out; residues without a window get 0.
    """
    w = F.lit(1.0) if weight is None else weight
    cells = windows.select(parent, F.col(start).alias("start"), (F.col(start) + F.size(profile)).alias("end"), w.alias("__w"), F.col(profile).alias("__p"))
    mean = F.avg(F.get("__p", (F.col("pos") - F.col("start")).cast("int")) * F.col("__w"))
    track = on_spine(cells, lengths, parent, mean.alias("heat")).select(parent, "pos", F.coalesce("heat", F.lit(0.0)).alias("heat"))
    # Dealt by parent as it is, the track meets its largest values without a shuffle.
    all_of = Window.partitionBy(parent)
    over = lambda top: F.when(top > 0, F.col("heat") / top).otherwise(F.col("heat"))
    tops = track.withColumns({"__top": F.max("heat").over(all_of), "__high": F.max(F.abs("heat")).over(all_of)})
    return tops.select(parent, "pos", over(F.col("__top")).alias("heat"), over(F.col("__high")).alias("saliency"))


def normalised(df: DataFrame, group: str, value: str, absolute: bool = False) -> DataFrame:
    """Values divided by the group's largest (absolute) one where that is positive."""
    top = F.max(F.abs(F.col(value)) if absolute else F.col(value)).over(Window.partitionBy(group))
    return df.withColumn("normalised", F.when(top > 0, F.col(value) / top).otherwise(F.col(value)))


def factor_risk(features: DataFrame, hits: DataFrame, tolerance: DataFrame, key: str = "sequence_id", most: int = 40) -> DataFrame:
    """F-26 whole: (key, binders, foreign, hyperstable, disorder, score, band, flagged).

    features: (key, mean_rsa, unfolding, disordered); hits: (key, peptide, binder, pos); tolerance: (key,
    peptide, status, pos). Binders count 8 points up to 40, foreign-like peptides 3 up to 30, a low
    accessibility with high stability 15, disorder 10. Flagged are at most `most` distinct peptides:
    binders that are foreign-like by their position, then the other foreign-like ones.
    """
    foreign = tolerance.where(F.col("status") == "foreign_like").select(key, "peptide", "pos")
    strong = hits.where("binder").select(key, "peptide", "pos")
    counts = strong.groupBy(key).agg(F.count(F.lit(1)).alias("n_strong")), foreign.groupBy(key).agg(F.count(F.lit(1)).alias("n_foreign"))
    first = foreign.groupBy(key, "peptide").agg(F.min("pos").alias("own"))
    bound = strong.groupBy(key, "peptide").agg(F.min("pos").alias("hit"))
    order = first.join(bound.hint("merge"), [key, "peptide"], "left").select(key, "peptide", F.struct(F.col("hit").isNull().alias("late"), F.coalesce("hit", "own").alias("at"), F.col("peptide").alias("p")).alias("__o"))
    flagged = top_k(order, [key], [F.col("__o")], most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("__o")), lambda x: x["p"]).alias("flagged"))
    met = features
    for other in (*counts, flagged):
        met = met.join(other.hint("merge"), key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    met = met.withColumns({
        "binders": F.least(F.lit(40), n("n_strong") * 8),
        "foreign": F.least(F.lit(30), n("n_foreign") * 3),
        "hyperstable": F.when((F.col("mean_rsa") < 0.35) & (F.col("unfolding") > 6), 15).otherwise(0),
        "disorder": F.when(F.col("disordered") > 0.5, 10).otherwise(0),
    })
    score = F.least(F.lit(100), F.col("binders") + F.col("foreign") + F.col("hyperstable") + F.col("disorder"))
    return met.select(key, "binders", "foreign", "hyperstable", "disorder", score.alias("score"), risk_band(score).alias("band"), F.coalesce("flagged", F.array().cast("array<string>")).alias("flagged"))


def noisy_or(p: Column) -> Column:
    """A-30: aggregate; an empty group gives 0."""
    return F.coalesce(1 - F.product(1 - F.least(F.greatest(p, F.lit(0.0)), F.lit(1 - 1e-9))), F.lit(0.0))


def weighted_mean(x: Column, w: Column) -> Column:
    """A-31: aggregate; the plain mean where the weights sum to about 0."""
    return F.when(F.sum(w) > 1e-12, F.sum(x * w) / F.sum(w)).otherwise(F.avg(x))


def component_summary(hits: DataFrame, key: str) -> DataFrame:
    """F-23: per candidate the largest support of each channel from providers that are ok, of cleavage and accessibility together, the response if it is calibrated, and 1 less the largest shared tolerance.

    hits: (key, status, el_rank, ba_rank, scale, response, cleavage, accessibility, gate, tolerance).
    """
    c, ok = F.col, F.col("status") == "ok"
    return hits.groupBy(key).agg(
        F.max(F.when(c("scale") == "calibrated_probability", c("response"))).alias("response"),
        F.max(F.when(ok, rank_support(c("el_rank")))).alias("el"),
        F.max(F.when(ok, rank_support(c("ba_rank")))).alias("ba"),
        F.max(F.greatest("cleavage", "accessibility")).alias("cleavage_accessibility"),
        (1 - F.max(F.when(c("gate") == "shared", c("tolerance")))).alias("inverse_tolerance"),
    )


def confidence_parts(df: DataFrame, key: str, risk: str, parts: list[str], distance: str) -> DataFrame:
    """A-31: risk-weighted mean of each part (plain where the risks sum to about 0), their mean, and the mean distance."""
    each = df.groupBy(key).agg(*[weighted_mean(F.col(p), F.col(risk)).alias(p) for p in parts], F.avg(distance).alias(distance))
    return each.withColumn("confidence", sum(F.col(p) for p in parts) / len(parts))


def surrogate(windows: DataFrame, key: str, risk: str, confidence: str, kind: str, start: str = "start", k: int = 5) -> DataFrame:
    """A-29: (key, top5, max_start, confidence, channel_max, class): mean of the k highest risks, the start of the first highest, mean confidence, maximum over both channels, highest class present."""
    level = F.when(F.col(kind) == "strong", 2).when(F.col(kind) == "weak", 1).otherwise(0)
    base = windows.groupBy(key).agg(
        F.min_by(start, F.struct(-F.col(risk), F.col(start))).alias("max_start"), F.avg(confidence).alias("confidence"), F.max(F.greatest(risk, confidence)).alias("channel_max"),
        F.element_at(F.array(F.lit("nonbinder"), F.lit("weak"), F.lit("strong")), F.max(level) + 1).alias("class"),
    )
    top = top_k(windows.select(key, start, risk), [key], [F.desc(risk), F.col(start)], k).groupBy(key).agg(F.avg(risk).alias("top5"))
    return base.join(top.hint("merge"), key)
