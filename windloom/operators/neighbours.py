"""Exact nearest neighbours by cosine, in blocks (L-05, M-14, O-11).

The reference stays where it is, in any number of rows. Queries are numbered and taken in blocks of
QUERY_BLOCK vectors; a block is sent to all tasks, each of which multiplies STRIPE of its queries with
STRIPE of the task's reference rows at a time, and keeps the k best of each query. Only those leave the task, and merging them
keeps k again. So memory is bounded by block and stripe, and each block is one pass over the reference.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windloom.operators.rank import percentile_against
from windloom.session import landed

QUERY_BLOCK, STRIPE = 16_384, 1024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def best(ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each row, with their ids, ascending; equal distances by id."""
    if distance.shape[1] > k:
        at = np.argpartition(distance, k - 1, axis=1)[:, :k]
        ids, distance = np.take_along_axis(ids, at, 1), np.take_along_axis(distance, at, 1)
    order = np.lexsort((ids, distance), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(distance, order, 1)


def best_of(batches, asked: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest rows of Arrow batches (id, vector) for each query: STRIPE queries against STRIPE rows at a time, infinite where there are fewer."""
    found_ids, found = np.full((len(asked), k), -1, np.int64), np.full((len(asked), k), np.inf)
    for b in batches:
        all_ids = b.column(0).to_numpy()
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
        for at in range(0, len(all_ids), STRIPE):
            own = all_ids[at : at + STRIPE]
            x = unit(flat[at * q.shape[1] : (at + len(own)) * q.shape[1]].reshape(len(own), -1)).T
            for low in range(0, len(asked), STRIPE):
                some = slice(low, low + STRIPE)
                d = 1 - q[some] @ x
                d[asked[some, None] == own[None, :]] = np.inf
                ids, least = best(np.broadcast_to(own, d.shape), d, k)
                found_ids[some], found[some] = best(np.concatenate([found_ids[some], ids], axis=1), np.concatenate([found[some], least], axis=1), k)
    return found_ids, found


def partial_best(reference: DataFrame, block: list, k: int) -> DataFrame:
    """(q, ref, distance): for each query of a block and each task its k nearest reference rows, the query's own id left out."""
    ids = np.array([r["id"] for r in block], np.int64)
    shared = reference.sparkSession.sparkContext.broadcast((ids, unit(np.array([r["v"] for r in block], np.float64))))

    def run(batches):
        import pyarrow as pa

        asked, q = shared.value
        found_ids, found = best_of(batches, asked, q, k)
        row, col = np.nonzero(np.isfinite(found))
        yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(found_ids[row, col]), pa.array(found[row, col])], names=["q", "ref", "distance"])

    return reference.mapInArrow(run, "q long, ref long, distance double")


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows that have both, one for each id."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null and size(v) > 0")


def nearest(queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(key, ref, distance, rank) of the k nearest reference rows of each query, itself left out.

    All vectors have one length; ids are whole numbers, one row each. Queries without a vector give no rows.
    """
    ref = vectors(reference, key, vector)
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    # Dealt by hash into blocks of about the size; each comes to the driver alone.
    asked = landed(vectors(queries, key, vector).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    parts = []
    for i in range(blocks):
        block = asked.where(F.col("block") == i).select("id", "v").collect()
        if block:
            parts.append(landed(partial_best(ref, block, k), "neighbours"))
    if not parts:
        return ref.sparkSession.createDataFrame([], f"{key} long, ref long, distance double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("q").orderBy("distance", "ref")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(key), "ref", "distance", "rank")


def knn_distance(df: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """L-05: (key, distance): mean cosine distance to the k nearest of a reference set of any size, itself left out; null where there is none."""
    found = nearest(df, reference, key, vector, k).groupBy(F.col(key).alias("__k")).agg(F.avg("distance").alias("distance"))
    ids = df.select(F.col(key).cast("long").alias(key))
    return ids.join(found.hint("merge"), ids[key] == F.col("__k"), "left").select(key, "distance")


def familiarity(distances: DataFrame, baseline: DataFrame, value: str = "distance", out: str = "familiarity") -> DataFrame:
    """O-11: the share of baseline values at least as large as each distance."""
    return percentile_against(distances, baseline, value).withColumn(out, 1 - F.col("percentile") / 100).drop("percentile")


def cohort_gap(df: DataFrame, reference: DataFrame, key: str, vector: str, cohort: str, near: str, far: str, k: int = 10) -> DataFrame:
    """M-14: (near_distance, far_distance, ratio): mean neighbour distance of two cohorts, and how many times the near one's the far one's is."""
    chosen = df.where(F.col(cohort).isin(near, far))
    found = knn_distance(chosen, reference, key, vector, k)
    met = found.join(chosen.select(F.col(key).cast("long").alias(key), cohort).hint("merge"), key)
    mean = lambda c: F.avg(F.when(F.col(cohort) == c, F.col("distance")))
    out = met.agg(mean(near).alias("near_distance"), mean(far).alias("far_distance"))
    return out.withColumn("ratio", F.col("far_distance") / F.greatest(F.col("near_distance"), F.lit(1e-9)))
