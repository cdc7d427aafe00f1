"""Distributed model operators: ridge, PCA, calibrated heads, rows not landed yet (L-01 to L-04, L-08, L-09, F-19)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.functions.scores import cosine
from windloom.functions.sequence import RESIDUES, add_tag
from windloom.operators.isotonic import interpolate, knots
from windloom.operators.resample import CDF
from windloom.session import landed


def one_hot(peptide: Column, k: int = 9) -> Column:
    """F-18 as a dense vector of k * 20."""
    at = F.split(F.rpad(peptide, k, "-"), "")
    cells = F.flatten(F.transform(F.slice(at, 1, k), lambda c: F.transform(F.split(F.lit(RESIDUES), ""), lambda r: F.when(r == c, 1.0).otherwise(0.0))))
    return array_to_vector(cells)


def ridge_impute(df: DataFrame, peptide: str, value: str, tag_col: str, tag: str, alpha: float = 10.0) -> DataFrame:
    """L-01: nulls of `value` filled by ridge regression on one-hot peptides, fitted on rows that were measured (not tagged before)."""
    measured = df.where(F.col(value).isNotNull() & ~F.contains(F.coalesce(tag_col, F.lit("")), F.lit(tag)))
    rows, total, products, sums = one_hot_moments(measured, peptide, value)
    if not rows:
        return df
    share = total / rows
    w = np.linalg.solve(products - rows * np.outer(share, share) + alpha * np.eye(len(total)), sums[:-1] - share * sums[-1])
    filled = F.lit(float(sums[-1] / rows - share @ w))
    for i in range(len(w) // len(RESIDUES)):
        # The first weight of a place is that of letters which are no residue.
        at = F.array(*[F.lit(float(x)) for x in (0.0, *w[i * len(RESIDUES) : (i + 1) * len(RESIDUES)])])
        filled = filled + at[F.when(F.char_length(peptide) > i, F.instr(F.lit(RESIDUES), F.substring(peptide, i + 1, 1))).otherwise(0)]
    missing = F.col(value).isNull()
    return df.select(*[F.when(missing, filled).otherwise(F.col(c)).alias(c) if c == value else F.when(missing, add_tag(F.col(c), tag)).otherwise(F.col(c)).alias(c) if c == tag_col else F.col(c) for c in df.columns])


def one_hot_moments(df: DataFrame, peptide: str, value: str, k: int = 9) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sums, products, sums with the value and the value's own sum last) of the one-hot vectors of peptides (F-18), k * 20 wide.

    Equal peptides are counted first. A task adds up pairs of cells that are one, 45 of a peptide at most
    and not the 16,290 of its vector; only sums of a fixed size meet.
    """
    width = k * len(RESIDUES)
    each = df.groupBy(F.left(peptide, F.lit(k)).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("y"))

    def run(batches):
        import pyarrow as pa

        cell = np.full(256, -1, np.int64)
        cell[np.frombuffer(RESIDUES.encode(), np.uint8)] = np.arange(len(RESIDUES))
        rows, by_y, products = 0, np.zeros(width + 1), np.zeros((width + 1) ** 2)
        for b in batches:
            letters = np.array([p.encode("ascii", "replace").ljust(k, b"-") for p in b.column(0).fill_null("").to_pylist()], f"S{k}")
            at = cell[letters.view(np.uint8).reshape(-1, k)]
            at = np.where(at < 0, width, at + np.arange(k) * len(RESIDUES))
            n, y = b.column(1).to_numpy().astype(float), b.column(2).to_numpy()
            rows += int(n.sum())
            by_y[-1] += y.sum()
            for i in range(k):
                by_y[:width] += np.bincount(at[:, i], y, width + 1)[:width]
                for j in range(i, k):
                    products += np.bincount(at[:, i] * (width + 1) + at[:, j], n, (width + 1) ** 2)
        if rows:
            m = products.reshape(width + 1, width + 1)[:width, :width]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width + width + 2), pa.int32()), pa.array(np.r_[m.ravel(), by_y, rows])], names=["i", "m"])

    found = each.mapInArrow(run, "i int, m double").groupBy("i").agg(F.sum("m").alias("m")).orderBy("i").toPandas()["m"].to_numpy()
    if not len(found):
        return 0, np.zeros(width), np.zeros((width, width)), np.zeros(width + 1)
    m = found[: width * width].reshape(width, width)
    m = np.triu(m) + np.triu(m, 1).T
    return int(found[-1]), np.diag(m).copy(), m, found[width * width : -1]


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """L-03, L-08: unit-length projections of centred vectors as array column `projected`; signs are arbitrary."""
    v = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(v)
    from pyspark.ml.stat import Summarizer

    mean = v.select(Summarizer.mean(F.col("__v"))).first()[0]
    shift = np.array(mean) @ model.pc.toArray()
    out = model.transform(v).withColumn("__c", array_to_vector(F.zip_with(vector_to_array("__p"), F.array(*[F.lit(float(x)) for x in shift]), lambda a, b: a - b)))
    return Normalizer(inputCol="__c", outputCol="__n").transform(out).withColumn("projected", vector_to_array("__n")).drop("__v", "__p", "__c", "__n")


def pooled(vectors: Column, first: Column, last: Column) -> Column:
    """F-19: mean of the vectors at positions first..last-1 of an array of vectors, clipped to it."""
    lo = F.greatest(first, F.lit(0))
    part = F.slice(vectors, lo + 1, F.greatest(F.lit(0), F.least(last, F.size(vectors)) - lo))
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(part, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return F.when(F.size(part) > 0, F.transform(total, lambda x: x / F.size(part)))


def only_new(df: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """L-09, G-17: rows whose content key is not in the landed results yet, one for each key."""
    return df.dropDuplicates([key]).join(cached.select(key), key, "left_anti")


def ridge_ensemble(df: DataFrame, key: str, vector: Column, value: str, replicates: int = 20, alpha: float = 10.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """L-02: (coefficients, intercepts) of a ridge fit on all rows, then of one for each bootstrap replicate.

    Each task adds up the moments of its rows under the Poisson(1) weights of every replicate, drawn
    from a hash of row and replicate; only sums of a fixed size meet, so no row leaves its task.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("long").alias("k"), vector.cast("array<double>").alias("x"), F.col(value).cast("double").alias("y"))

    def run(batches):
        import pandas as pd

        sums = None
        for b in batches:
            if not len(b):
                continue
            x = np.column_stack([np.stack(b["x"].to_numpy()), np.ones(len(b)), b["y"].to_numpy()])
            ids = b["k"].to_numpy(np.int64).view(np.uint64)
            got = []
            for r in range(replicates + 1):
                w = poisson(ids, r, seed) if r else np.ones(len(b))
                got.append((x * w[:, None]).T @ x)
            sums = np.stack(got) if sums is None else sums + np.stack(got)
        if sums is not None:
            yield pd.DataFrame({"replicate": np.arange(replicates + 1), "moments": [m.ravel() for m in sums]})

    parts = rows.mapInPandas(run, "replicate int, moments array<double>").select("replicate", F.posexplode("moments").alias("i", "m")).groupBy("replicate", "i").agg(F.sum("m").alias("m"))
    found = parts.toPandas()  # (replicates + 1) * (width + 2)^2 sums
    coefficients, intercepts = [], []
    for r in range(replicates + 1):
        m = found[found["replicate"] == r].sort_values("i")["m"].to_numpy()
        m = m.reshape(int(len(m) ** 0.5), -1)
        n, sx, sy = m[-2, -2], m[-2, :-2], m[-2, -1]
        gram, xy = m[:-2, :-2] - np.outer(sx, sx) / n, m[:-2, -1] - sx * sy / n
        w = np.linalg.solve(gram + alpha * np.eye(len(gram)), xy)
        coefficients.append(w)
        intercepts.append((sy - sx @ w) / n)
    return np.array(coefficients), np.array(intercepts)


def poisson(ids: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Poisson(1) draws by a hash of row and replicate."""
    with np.errstate(over="ignore"):
        h = (ids + np.uint64(replicate) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        u = ((h ^ (h >> np.uint64(33))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(CDF, u, side="right").astype(float)


def ensemble_scores(df: DataFrame, key: str, vector: Column, coefficients: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """L-02, L-07: (key, mean, spread): the first head's score, and the deviation of the others' scores; stored weights are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((coefficients, intercepts))

    def run(batches):
        for b in batches:
            w, c = shared.value
            x = np.stack(b["x"].to_numpy()) if len(b) else np.empty((0, w.shape[1]))
            scores = x @ w.T + c
            yield b[[key]].assign(mean=scores[:, 0], spread=scores[:, 1:].std(axis=1) if w.shape[0] > 1 else 0.0)

    return df.select(F.col(key).cast("long").alias(key), vector.cast("array<double>").alias("x")).mapInPandas(run, f"{key} long, mean double, spread double")


def allele_head(df: DataFrame, allele: str, vector: str, percentile: str, most: float = 2.0) -> DataFrame:
    """L-04: (df.., cosine, propensity): cosine to the allele's centroid of strong binders (of all its rows where it has none), calibrated by an isotonic fit for each allele.

    Centroids are sums by allele, one row each; the isotonic fits of all alleles are one plan.
    """
    from pyspark.ml.stat import Summarizer

    v = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    strong = F.col(percentile) <= most
    sums = v.groupBy(allele).agg(Summarizer.mean(F.col("__v")).alias("__all"), F.max(strong).alias("__any"))
    few = v.where(strong).groupBy(allele).agg(Summarizer.mean(F.col("__v")).alias("__few"))
    centroids = sums.join(few.hint("merge"), allele, "left").select(allele, F.when(F.col("__any"), vector_to_array("__few")).otherwise(vector_to_array("__all")).alias("__centroid"))
    met = v.drop("__v").join(centroids.hint("merge"), allele).withColumn("cosine", cosine(F.col(vector).cast("array<double>"), F.col("__centroid"))).drop("__centroid")
    met = landed(met, "cosines")
    target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(percentile) / 100))
    curves = knots(met.select(allele, "cosine", target.alias("target")), allele, "cosine", "target")
    return interpolate(met, curves, allele, "cosine", "target", "propensity")
