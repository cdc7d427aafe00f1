"""Bootstrap intervals of AUC, average precision and rank correlation (M-08), all replicates in one sweep.

A row's weight in a replicate is a Poisson(1) draw from a hash of the row and the replicate's number, so
nothing is stored and every run repeats. Rows are dealt by ranges of (score, row hash), also through a
score that very many rows have. Where many rows share score, activity and label, the weights of each such
cell are added up once, and cells with these sums take the place of the rows: what follows no longer grows
with the rows, and each of their weights is drawn a single time. A first sweep gives each range's weights by class, in all and of its
first and last score. These few arrays, ranges x replicates numbers, are summed over the ranges at once;
a second sweep then knows the weight below each score and on it, and adds up the metrics. A sweep is a
stream: it holds a chunk of rows and one score's sums, however many rows share the score.

Rows with a null or not finite score, activity or label are an error, as are inputs of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.operators.metrics import require_inputs
from windloom.session import landed

#: Weights made at a time, and replicates of a rank correlation that travel together.
CHUNK, RANKS_A_PASS = 1 << 20, 100
#: Rows of a cell on average from which on cells stand for rows. A sum for each replicate travels with a cell.
CELL_ROWS = 16
#: Rows of a class that are looked at first for whether a replicate has the class.
FEW = 64
#: The replicate in which every row has weight 1.
WHOLE = -1


def poisson_table() -> np.ndarray:
    """P(X <= k) for Poisson(1), up to what a draw of 53 bits can tell from 1."""
    p, total, out = float(np.exp(-1.0)), 0.0, []
    while total + p > total and len(out) < 64:
        total += p
        out.append(total)
        p /= len(out)
    return np.array(out)


CDF = poisson_table()
#: Draws of 53 bits from which on each value of CDF is reached, and the weight by a draw's first 16 bits, -1 where they leave it open.
BOUNDS = np.ceil(CDF * float(1 << 53)).astype(np.uint64)
_FIRST = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
_LEAST, _MOST = (np.searchsorted(BOUNDS, x, side="right") for x in (_FIRST, _FIRST + np.uint64((1 << 37) - 1)))
LOOKUP = np.where(_LEAST == _MOST, _LEAST, -1).astype(np.int8)
#: Draws made at a time: what is added up and mixed stays in a core's cache.
BLOCK = 1 << 15


def draws(ids: np.ndarray, numbers: np.ndarray, seed: int) -> np.ndarray:
    """(rows, replicates) Poisson(1) draws in a byte each; none is over 63."""
    mix, again, by = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
    with np.errstate(over="ignore"):
        starts = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) * mix
        own = ids.view(np.uint64) * mix
    out = np.empty((len(ids), len(numbers)), np.int8)
    step = max(1, BLOCK // max(1, len(numbers)))
    h, t = (np.empty((min(step, len(ids)), len(numbers)), np.uint64) for _ in range(2))
    for at in range(0, len(ids), step):
        n = min(step, len(ids) - at)
        h_, t_, made = h[:n], t[:n], out[at : at + n]
        np.add(own[at : at + n, None], starts, out=h_)
        np.right_shift(h_, by, out=t_)
        h_ ^= t_
        h_ *= again
        np.right_shift(h_, np.uint64(48), out=t_)  # the last step of the mixing does not reach these bits
        np.take(LOOKUP, t_.view(np.int64), out=made, mode="clip")
        left = np.flatnonzero(made.ravel() < 0)
        if len(left):
            u = h_.ravel()[left]
            made.reshape(-1)[left] = np.searchsorted(BOUNDS, (u ^ (u >> by)) >> np.uint64(11), side="right")
    out[:, numbers == WHOLE] = 1
    return out


def weights(ids: np.ndarray, numbers: np.ndarray, seed: int) -> np.ndarray:
    """The draws as whole numbers that may be multiplied."""
    return draws(ids, numbers, seed).astype(np.int64)


def class_totals(df: DataFrame, label: str, numbers: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all positives and of all negatives by replicate: fixed-size sums of each task."""

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((2, len(numbers)), np.int64)
        for b in batches:
            ids, pos = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            step = max(1, CHUNK // len(numbers))
            for at in range(0, len(ids), step):
                w = draws(ids[at : at + step], numbers, seed)
                sums[0] += w[pos[at : at + step]].sum(axis=0, dtype=np.int64)
                sums[1] += w[~pos[at : at + step]].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers)), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["i", "p", "n"])

    made = df.select("id", label).mapInArrow(run, "i int, p long, n long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).orderBy("i").collect()
    return np.array([r["p"] for r in made]), np.array([r["n"] for r in made])


def valid_replicates(df: DataFrame, label: str, n: int, seed: int) -> np.ndarray:
    """The first `n` replicate numbers that have both classes, of at most 10n that are tried. All rows are counted only where a few of each class leave it open."""
    few = [np.array([r["id"] for r in df.where(side).select("id").limit(FEW).collect()], np.int64) for side in (F.col(label), ~F.col(label))]
    found: list[int] = []
    for at in range(0, 10 * n, n):
        numbers = np.arange(at, at + n)
        both = np.all([(draws(ids, numbers, seed) > 0).any(axis=0) for ids in few], axis=0)
        if not both.all():
            p, q = class_totals(df, label, numbers, seed)
            both = (p > 0) & (q > 0)
        found += numbers[both].tolist()
        if len(found) >= n:
            break
    return np.array(found[:n], np.int64)


def cells(df: DataFrame, keys: list[str], numbers: np.ndarray, seed: int) -> DataFrame:
    """(keys, id): id holds the summed weights of the rows with the same keys by replicate. Rows are dealt by ranges that are cut inside a cell too, which then gives a row in each."""
    width, kinds = len(numbers), [df.schema[k] for k in keys]

    def run(batches):
        import pyarrow as pa

        held: tuple | None = None  # keys and sums of the cell that may go on

        def out(columns, sums):
            ends = pa.array(np.arange(len(sums) + 1) * width, pa.int32())
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.ListArray.from_arrays(ends, pa.array(sums.ravel(), pa.int64()))], names=[*keys, "id"])

        step = max(1, CHUNK // width)
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            ids = columns.pop()
            new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = np.flatnonzero(np.r_[True, new])
            w = draws(ids, numbers, seed)
            sums = np.stack([w[at:to].sum(axis=0, dtype=np.int64) for at, to in zip(first, [*first[1:], len(ids)], strict=True)])
            columns = [c[first] for c in columns]
            if held is not None:
                if all(x[0] == y[0] for x, y in zip(held[0], columns, strict=True)):
                    sums[0] += held[1][0]
                else:
                    columns, sums = [np.r_[x, y] for x, y in zip(held[0], columns, strict=True)], np.concatenate([held[1], sums])
            if len(sums) > 1:
                yield out([c[:-1] for c in columns], sums[:-1])
            held = ([c[-1:] for c in columns], sums[-1:])
        if held is not None:
            yield out(*held)

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select(*keys, "id").repartitionByRange(n, *keys, "id").sortWithinPartitions(*keys)
    return landed(dealt.mapInArrow(run, T.StructType([*kinds, T.StructField("id", T.ArrayType(T.LongType()))])), "cells")


def summed(column, numbers: np.ndarray, seed: int) -> np.ndarray:
    """(rows, replicates) weights: drawn by the id of a row, or those that came with a cell."""
    import pyarrow as pa

    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(-1, len(numbers))
    return draws(column.to_numpy(), numbers, seed)


def ranged(df: DataFrame, value: str) -> DataFrame:
    """The rows with their range `part`, written out; a range is cut inside a value too."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in df.columns if c not in (value, "id")]
    tie = rest if isinstance(df.schema["id"].dataType, T.ArrayType) else ["id"]  # few rows are alike in all columns of a cell
    return landed(df.repartitionByRange(n, value, *tie).withColumn("part", F.spark_partition_id()), "ranges")


def swept(df: DataFrame, value: str) -> DataFrame:
    """Rows of a range one after the other, by rising value; a task may get several ranges."""
    return df.repartition("part").sortWithinPartitions("part", value)


def tie_groups(parts: Iterator, width: int, seed: int, numbers: np.ndarray, extra: bool) -> Iterator[tuple]:
    """(part, values, sums, closed) from sorted (part, value, id or a cell's weights, label, [vector]) batches.

    sums has the class weights of each distinct value, and the weighted vectors where there are any.
    A value's sums come whole: the last one of a chunk is carried over. `closed` marks a part's end.
    """
    held: tuple | None = None  # part, value, sums of the value that may go on
    step = max(1, CHUNK // max(1, width))
    for b in parts:
        part, value = (b.column(i).to_numpy() for i in range(2))
        pos = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
        vectors = b.column(4).flatten().to_numpy().reshape(-1, width) if extra else None
        at = 0
        while at < b.num_rows:
            to = min(b.num_rows, at + step)
            if part[to - 1] != part[at]:
                to = at + int(np.searchsorted(part[at:to], part[at], side="right"))
            if held is not None and held[0] != part[at]:
                yield held[0], held[1], held[2], True
                held = None
            w = summed(b.column(2).slice(at, to - at), numbers, seed)
            v, p = value[at:to], pos[at:to, None]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            channels = [w * p, w * ~p] + ([w * vectors[at:to]] if extra else [])
            sums = np.stack([np.add.reduceat(c, first, axis=0, dtype=np.int64) for c in channels], axis=1)
            values = v[first]
            if held is not None:
                if held[1][0] == values[0]:
                    sums[0] += held[2][0]
                else:
                    values, sums = np.r_[held[1], values], np.concatenate([held[2], sums])
            if len(values) > 1:
                yield part[at], values[:-1], sums[:-1], False
            held = (part[at], values[-1:], sums[-1:])
            at = to
    if held is not None:
        yield held[0], held[1], held[2], True


def edges(rows: DataFrame, value: str, numbers: np.ndarray, seed: int) -> list:
    """First sweep: by range its first and last value with their sums, and all its sums; (2, replicates) each."""
    width = len(numbers)

    def run(batches):
        import pyarrow as pa

        first = total = None
        for part, values, sums, closed in tie_groups(batches, width, seed, numbers, False):
            if first is None:
                first, total = (values[0], sums[0]), np.zeros_like(sums[0])
            total = total + sums.sum(axis=0)
            if closed:
                arrays = [first[1], sums[-1], total]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first[0]], pa.float64()), pa.array([values[-1]], pa.float64()), *[pa.array([a.ravel()], pa.list_(pa.int64())) for a in arrays]], names=["part", "lo", "hi", "at_lo", "at_hi", "total"])
                first = total = None

    made = swept(rows, value).select("part", value, "id", "label").mapInArrow(run, "part int, lo double, hi double, at_lo array<long>, at_hi array<long>, total array<long>")
    return sorted(made.collect(), key=lambda r: r["part"])  # ranges x replicates numbers


def surroundings(found: list, width: int) -> tuple[dict, np.ndarray]:
    """By range: (weight below its first value, whole weight on its first value, whole weight on its last value); and all weight."""
    of = lambda a: np.array(a, np.int64).reshape(2, width)
    ties: dict[float, np.ndarray] = {}
    for r in found:
        for v, sums in {r["lo"]: r["at_lo"], r["hi"]: r["at_hi"]}.items():
            ties[v] = ties.get(v, 0) + of(sums)
    out, done, below = {}, np.zeros((2, width), np.int64), np.zeros((2, width), np.int64)
    last = None
    for r in found:
        if r["lo"] != last:  # nothing of this value came before
            below = done.copy()
        out[r["part"]] = (below, ties[r["lo"]], ties[r["hi"]])
        done = done + of(r["total"])
        if r["hi"] != r["lo"]:
            below = done - of(r["at_hi"])
        last = r["hi"]
    return out, done


def settled(batches: Iterator, width: int, seed: int, numbers: np.ndarray, around: dict, extra: bool) -> Iterator[tuple]:
    """(part, values, sums, below, on): the sums of a range's rows on each value, with the whole weight below that value and on it."""
    at = None
    for part, values, sums, closed in tie_groups(batches, width, seed, numbers, extra):
        start, on_first, on_last = around[part]
        first = at is None
        own = sums[:, :2]
        on = own.copy()
        if first:
            at, on[0] = start, on_first
        if closed:
            on[-1] = on_last
        below = at + np.concatenate([np.zeros_like(on[:1]), np.cumsum(on, axis=0)[:-1]])
        at = None if closed else below[-1] + on[-1]
        yield part, values, sums, below, on


def swept_metrics(rows: DataFrame, value: str, numbers: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(AUC, average precision) by replicate."""
    width = len(numbers)
    around, total = surroundings(edges(rows, value, numbers, seed), width)
    shared = rows.sparkSession.sparkContext.broadcast((around, total))

    def run(batches):
        import pyarrow as pa

        auc, ap = np.zeros(width), np.zeros(width)
        near, whole = shared.value
        for _, _, sums, below, on in settled(batches, width, seed, numbers, near, False):
            pos = sums[:, 0].astype(float)
            auc += (pos * (below[:, 1] + 0.5 * on[:, 1])).sum(axis=0)
            flagged = (whole.sum(axis=0) - below.sum(axis=1)).astype(float)
            ap += (pos * (whole[0] - below[:, 0]) / np.maximum(flagged, 1.0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(auc), pa.array(ap)], names=["i", "auc", "ap"])

    made = swept(rows, value).select("part", value, "id", "label").mapInArrow(run, "i int, auc double, ap double")
    sums = made.groupBy("i").agg(F.sum("auc").alias("auc"), F.sum("ap").alias("ap")).orderBy("i").collect()
    p, q = total.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.array([r["auc"] for r in sums]) / (p * q), np.array([r["ap"] for r in sums]) / p


def swept_spearman(x_rows: DataFrame, y_rows: DataFrame, x: str, y: str, numbers: np.ndarray, seed: int) -> np.ndarray:
    """Weighted rank correlation by replicate: the ranks along y go by distinct value to the rows, and are added up by x."""
    width = len(numbers)
    near_x, total = surroundings(edges(x_rows, x, numbers, seed), width)
    near_y, _ = surroundings(edges(y_rows, y, numbers, seed), width)
    spark = x_rows.sparkSession
    shared_x, shared_y = spark.sparkContext.broadcast(near_x), spark.sparkContext.broadcast(near_y)
    double = lambda below, on: 2 * below.sum(axis=1) + on.sum(axis=1) + 1  # twice the middle rank

    def ranks(batches):
        import pyarrow as pa

        for part, values, _, below, on in settled(batches, width, seed, numbers, shared_y.value, False):
            made = double(below, on)
            ends = pa.array(np.arange(len(values) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.ListArray.from_arrays(ends, pa.array(made.ravel(), pa.int64()))], names=["__y", "r"])

    # A value that several ranges have gives the same ranks in each.
    table = swept(y_rows, y).select("part", y, "id", "label").mapInArrow(ranks, "__y double, r array<long>").groupBy("__y").agg(F.first("r").alias("r"))
    met = swept(x_rows.join(landed(table, "ranks").hint("merge"), x_rows[y] == F.col("__y")), x).select("part", x, "id", "label", "r")

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((3, width))
        for _, _, got, below, on in settled(batches, width, seed, numbers, shared_x.value, True):
            rx = double(below, on).astype(float)
            w = got[:, :2].sum(axis=1)
            sums[0] += (rx * got[:, 2]).sum(axis=0)
            sums[1] += (rx * rx * w).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["i", "xy", "xx"])

    def squares(batches):
        import pyarrow as pa

        sums = np.zeros(width)
        for _, _, got, below, on in settled(batches, width, seed, numbers, shared_y.value, False):
            ry = double(below, on).astype(float)
            sums += (ry * ry * got[:, :2].sum(axis=1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(sums)], names=["i", "yy"])

    add = lambda df, *cs: np.array([[r[c] for c in cs] for r in df.groupBy("i").agg(*[F.sum(c).alias(c) for c in cs]).orderBy("i").collect()])
    xy, xx = add(met.mapInArrow(run, "i int, xy double, xx double"), "xy", "xx").T
    (yy,) = add(swept(y_rows, y).select("part", y, "id", "label").mapInArrow(squares, "i int, yy double"), "yy").T
    w = total.sum(axis=0).astype(float)
    mean = w + 1  # twice the mean of weighted middle ranks
    with np.errstate(divide="ignore", invalid="ignore"):
        return (xy - w * mean**2) / np.sqrt((xx - w * mean**2) * (yy - w * mean**2))


def replicate_metrics(df: DataFrame, key: list[str], score: str, label: str, activity: str | None = None, replicates: int = 1000, seed: int = 0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The replicate numbers, the first of which is WHOLE, and each metric by replicate."""
    require_inputs(df, [score, *([activity] if activity else [])], F.col(label))
    cols = [F.xxhash64(*key).alias("id"), F.col(score).cast("double").alias("x"), F.col(label).cast("boolean").alias("label")]
    rows = df.select(*cols, *([F.col(activity).cast("double").alias("y")] if activity else []))
    numbers = np.r_[WHOLE, valid_replicates(rows, "label", replicates, seed)].astype(np.int64)
    keys = [c for c in rows.columns if c != "id"]
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(*keys)).alias("cells")).first()
    if size["rows"] >= CELL_ROWS * size["cells"]:
        rows = cells(rows, keys, numbers, seed)
    some = lambda df, at: df.withColumn("id", F.slice("id", at + 1, RANKS_A_PASS)) if isinstance(df.schema["id"].dataType, T.ArrayType) else df
    by_x = ranged(rows, "x")
    auc, ap = swept_metrics(by_x, "x", numbers, seed)
    out = {"roc_auc": auc, "average_precision": ap}
    if activity:
        by_y = ranged(rows, "y")
        parts = range(0, len(numbers), RANKS_A_PASS)
        out["spearman"] = np.concatenate([swept_spearman(some(by_x, at), some(by_y, at), "x", "y", numbers[at : at + RANKS_A_PASS], seed) for at in parts])
    return numbers, out


def intervals(df: DataFrame, key: list[str], score: str, label: str, activity: str | None = None, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """M-08: (metric, value, lo, hi, n_valid): each metric over all rows, and the 2.5% and 97.5% quantiles of its replicates that are finite."""
    _, found = replicate_metrics(df, key, score, label, activity, replicates, seed)
    rows = []
    for name, values in found.items():
        drawn = values[1:][np.isfinite(values[1:])]
        lo, hi = (float(np.quantile(drawn, q)) for q in (0.025, 0.975)) if len(drawn) else (None, None)
        rows.append((name, float(values[0]), lo, hi, len(drawn)))
    return df.sparkSession.createDataFrame(rows, "metric string, value double, lo double, hi double, n_valid int")
