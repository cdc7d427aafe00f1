"""Scalar score functions as column expressions (F-01 to F-28)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score definitions.
STRONG_RANK, WEAK_RANK = 0.5, 2.0
SCREEN_PROPENSITY = 0.7892
IC50_SCALE = 50000.0
PATHWAY_EL, PATHWAY_GENERATION = 0.7, 0.3
#: Largest population standard deviation of three values between 0 and 1.
LARGEST_STD = 0.4714
#: Maximal accessible surface by residue (Tien et al. 2013, theoretical).
MAX_SURFACE = {"A": 129.0, "R": 274.0, "N": 195.0, "D": 193.0, "C": 167.0, "E": 223.0, "Q": 225.0, "G": 104.0, "H": 224.0, "I": 197.0, "L": 201.0, "K": 236.0, "M": 224.0, "F": 240.0, "P": 159.0, "S": 155.0, "T": 172.0, "W": 285.0, "Y": 263.0, "V": 174.0}


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def rank_to_propensity(rank: Column) -> Column:
    """F-01."""
    return 1 - F.log1p(clip(rank, 0.0, 100.0)) / math.log(101)


def propensity_to_rank(p: Column) -> Column:
    """F-02, the inverse."""
    return F.expm1((1 - clip(p, 0.0, 1.0)) * math.log(101))


def ic50_to_affinity(ic50: Column) -> Column:
    """F-03's other branch and F-04."""
    return clip(1 - F.log(F.greatest(ic50, F.lit(1.0))) / math.log(IC50_SCALE), 0.0, 1.0)


def affinity_to_ic50(score: Column) -> Column:
    """F-04."""
    return F.pow(F.lit(IC50_SCALE), 1 - clip(score, 0.0, 1.0))


def score_or_ic50(score: Column, ic50: Column) -> Column:
    """F-03: the score if present, else from the IC50, else an error."""
    return F.coalesce(score, ic50_to_affinity(ic50), F.raise_error(F.lit("neither score nor ic50")).cast("double"))


def binder_class(rank: Column) -> Column:
    """F-05."""
    return F.when(rank.isNull(), None).when(rank <= STRONG_RANK, "strong").when(rank <= WEAK_RANK, "weak").otherwise("nonbinder")


def close(a: Column, b: float) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * abs(b)


def unit_value(x: Column, name: str) -> Column:
    """A finite value from 0 to 1; anything else, null too, is an error."""
    x = x.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)
    return F.when(ok, x).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be finite and between 0 and 1: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("double"))


def profile(el: Column, ba: Column, affinity: Column | None = None, screen: float = SCREEN_PROPENSITY) -> Column:
    """F-06: predicted ranks of both channels, class by the first with tolerant boundaries, risk band, screening flag, and the IC50 where an affinity is given.

    Values outside 0 to 1, not finite or null are an error; a null affinity has no IC50.
    """
    el, ba = unit_value(el, "EL propensity"), unit_value(ba, "BA propensity")
    rank = propensity_to_rank(el)
    kind = F.when((rank <= STRONG_RANK) | close(rank, STRONG_RANK), "strong").when((rank <= WEAK_RANK) | close(rank, WEAK_RANK), "weak").otherwise("nonbinder")
    band = F.when(kind == "strong", "high").when(kind == "weak", "moderate").otherwise("low")
    ic50 = F.lit(None).cast("double") if affinity is None else F.when(affinity.isNotNull(), affinity_to_ic50(unit_value(affinity, "BA affinity")))
    return F.struct(rank.alias("el_rank"), propensity_to_rank(ba).alias("ba_rank"), kind.alias("binder_class"), band.alias("risk_band"), (el >= screen).alias("flagged"), el.alias("risk"), ic50.alias("ic50"))


def geometric_mean(*parts: Column) -> Column:
    """F-07: of parts clipped to 1e-6..1."""
    return F.exp(sum(F.log(clip(p, 1e-6, 1.0)) for p in parts) / len(parts))


def generation(n: Column, c: Column) -> Column:
    """F-08."""
    return F.sqrt(n * c)


def pathway(el: Column, gen: Column, w_el: float = PATHWAY_EL, w_gen: float = PATHWAY_GENERATION) -> Column:
    """F-09."""
    if abs(w_el + w_gen - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    return F.pow(el, F.lit(w_el)) * F.pow(gen, F.lit(w_gen))


def agreement(a: Column, b: Column, c: Column) -> Column:
    """Part of F-10: 1 less the population spread of three values over its largest."""
    mean = (a + b + c) / 3
    var = ((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3
    return clip(1 - F.sqrt(var) / LARGEST_STD, 0.0, 1.0)


def decisiveness(p: Column) -> Column:
    """Part of F-10: distance from an even chance."""
    return F.abs(p - 0.5) * 2


def window_confidence(spread: Column, presentation: Column, n_cut: Column, c_cut: Column, n_flank: Column, c_flank: Column, flank: int = 4, scale: float = 1.0) -> Column:
    """F-10: (tap, mhc, context, agreement, confidence): certainty of the transport fit, distance from an even chance, share of the flanks that is there, how close the three heads are, and the geometric mean of the four, each at least 1e-6."""
    tap = 1 / (1 + F.greatest(spread, F.lit(0.0)) / scale)
    mhc = clip(2 * F.abs(presentation - 0.5), 0.0, 1.0)
    there = lambda c: F.least(F.char_length(F.coalesce(c, F.lit(""))), F.lit(flank)) / flank
    context = 0.5 * (there(n_flank) + there(c_flank))
    a, b, c = (clip(x, 0.0, 1.0) for x in (n_cut, c_cut, presentation))
    mean = (a + b + c) / 3
    spread_of_heads = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3)
    together = clip(1 - spread_of_heads / (math.sqrt(2) / 3), 0.0, 1.0)
    return F.struct(tap.alias("tap"), mhc.alias("mhc"), context.alias("context"), together.alias("agreement"), geometric_mean(tap, mhc, context, together).alias("confidence"))


def rank_support(rank: Column) -> Column:
    """F-11."""
    return 1 - clip(rank, 0.0, 100.0) / 100


def tolerance(enrichment: Column) -> Column:
    """F-12: sigmoid of a finite enrichment, else 0."""
    return F.when(enrichment.isNull() | F.isnan(enrichment) | (F.abs(enrichment) == float("inf")), 0.0).otherwise(1 / (1 + F.exp(-enrichment)))


def hla_gate(supplied: bool, query: Column, shared: Column | None = None) -> Column:
    """F-13: (gate, shared): `shared` with the sorted common alleles wherever a shared map is supplied, even if none are common; else `query_only` or `not_available` and none."""
    asked = F.coalesce(query, F.array().cast("array<string>"))
    if supplied:
        own = F.coalesce(shared, F.array().cast("array<string>")) if shared is not None else F.array().cast("array<string>")
        return F.struct(F.lit("shared").alias("gate"), F.array_sort(F.array_intersect(asked, own)).alias("shared"))
    return F.struct(F.when(F.size(asked) > 0, "query_only").otherwise("not_available").alias("gate"), F.array().cast("array<string>").alias("shared"))


def log2_enrichment(observed: Column, expected: Column) -> Column:
    """F-14."""
    return F.log2((observed + 1) / (expected + 1))


def relative_accessibility(residue: Column, surface: Column) -> Column:
    """F-15: null for an unknown residue."""
    table = F.create_map(*[F.lit(x) for pair in MAX_SURFACE.items() for x in pair])
    return clip(surface / F.try_element_at(table, residue), 0.0, 1.5)


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """F-17: piecewise linear between knots, clamped outside."""
    out = F.when(x.isNull(), None).when(x <= xs[0], ys[0])
    for (a, b), (p, q) in zip(zip(xs, xs[1:], strict=False), zip(ys, ys[1:], strict=False), strict=True):
        out = out.when(x <= b, p + (x - a) * ((q - p) / (b - a)))
    return out.otherwise(ys[-1])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """F-20."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def entropy(p: Column) -> Column:
    """F-21: of a Bernoulli variable, in nats."""
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log(p) + q * F.log(q)))


def fuse(parts: dict[str, Column], weights: dict[str, float], required: list[str] = ()) -> Column:
    """F-22: weighted mean over the available parts; null if a required or every part is missing."""
    weight = sum(F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items())
    total = sum(F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items())
    ok = weight > 0
    for k in required:
        ok = ok & parts[k].isNotNull()
    return F.when(ok, total / weight)


def ablations(parts: dict[str, Column], weights: dict[str, float], required: list[str] = ()) -> Column:
    """F-22: the fused score without each part."""
    left = lambda k: ({p: w for p, w in weights.items() if p != k}, [r for r in required if r != k])
    return F.create_map(*[x for k in weights for x in (F.lit(k), fuse(parts, *left(k)))])


def fuse_detail(parts: dict[str, Column], weights: dict[str, float], required: list[str], steps: dict[str, list[str]]) -> Column:
    """F-22 whole: (score, missing, available_weight, contributions, ablations).

    contributions has (value, normalized_weight, contribution) of each available part with a weight;
    both maps are empty where no score is given. `steps` names subsets that are scored by their own
    weights, null where one of their parts is missing.
    """
    found = {k: parts[k] for k in weights if k in parts}
    weight = sum((F.when(c.isNotNull(), F.lit(float(weights[k]))).otherwise(0.0) for k, c in found.items()), F.lit(0.0))
    missing = F.array_compact(F.array(*[F.when(parts[k].isNull() if k in parts else F.lit(True), k) for k in sorted(required)])) if required else F.array().cast("array<string>")
    ok = (F.size(missing) == 0) & (weight > 0)
    share = lambda k: F.try_divide(F.lit(float(weights[k])), weight)
    score = F.when(ok, sum(F.coalesce(c * share(k), F.lit(0.0)) for k, c in found.items()))
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.struct(c.cast("double").alias("value"), share(k).alias("normalized_weight"), (c * share(k)).alias("contribution")).alias("value")) for k, c in found.items()])
    contributions = F.map_from_entries(F.filter(each, lambda e: ok & e["value"]["value"].isNotNull()))
    subset = lambda keys: sum(parts[k] * (weights[k] / sum(weights[j] for j in keys)) for k in keys)
    ablations = F.when(ok, F.create_map(*[x for name, keys in steps.items() for x in (F.lit(name), subset(keys))], F.lit("all_available"), score))
    return F.struct(score.alias("score"), missing.alias("missing"), weight.alias("available_weight"), contributions.alias("contributions"), ablations.alias("ablations"))


def fold_error(predicted: Column, actual: Column) -> Column:
    """F-27."""
    return F.exp(F.abs(F.log(predicted) - F.log(actual)))


def capped_risk(counts: list[tuple[Column, float, float]]) -> Column:
    """F-26: sum of count * points, each capped, the total at 100."""
    return F.least(F.lit(100.0), sum(F.least(n * points, F.lit(cap)) for n, points, cap in counts))


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 55, "high").when(risk >= 30, "moderate").otherwise("low")


def objective(risk: Column, latent: Column, cleavage: Column, transport: Column) -> Column:
    """F-28."""
    return risk + 0.25 * latent + 1.0 * cleavage + 0.5 * transport


def accepted(objective: Column, current: Column, likelihood: Column, before: Column, length: Column, most: float = 0.5) -> Column:
    """F-28: an improved objective whose log likelihood falls by no more than `most` a residue."""
    return (objective < current) & ((before - likelihood) / F.greatest(F.lit(1), length) <= most)


def linear(vector: Column, weights: list[float], bias: float) -> Column:
    """L-07: a stored linear head."""
    return F.aggregate(F.zip_with(vector.cast("array<double>"), F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(float(bias)), lambda acc, x: acc + x)
