"""Greedy choice of disjoint windows and of spaced peaks, without collecting a parent (O-03, O-04).

The serial rule takes the best window that is left and removes all that overlap it. A window can be
decided as soon as all better windows that overlap it are, so parents are cut into blocks of positions,
and each block decides in one pass, best first, whatever does not hang on an undecided window beyond
its border; it sees the windows there that reach it. Rounds go on until nothing is open, with blocks shifted by half every other round. A
chain of decisions that runs through the whole parent takes a round for each block it crosses.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.operators.rank import top_k
from windloom.session import landed

#: Positions of a block at least; a block is four times as long as the longest window if that is more.
BLOCK = 1 << 16
OPEN, TAKEN = 0, 1


def decided(start: np.ndarray, end: np.ndarray, risk: np.ndarray, status: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Status of the windows of one block, with those around it, after one pass: OPEN, TAKEN or -1 for removed."""
    low = int(start.min())
    size = int(end.max()) - low
    taken, doubt = np.zeros(size, bool), np.zeros(size, bool)
    out = status.copy()
    for i in np.flatnonzero(status == TAKEN):
        taken[start[i] - low : end[i] - low] = True
    for i in np.lexsort((end, start, -risk)):
        if status[i] == TAKEN:
            continue
        a, b = start[i] - low, end[i] - low
        if taken[a:b].any():
            out[i] = -1
        elif not inside[i] or doubt[a:b].any():
            doubt[a:b] = True
        else:
            taken[a:b] = True
            out[i] = TAKEN
    return out


def disjoint(df: DataFrame, parent: str, start: str, end: Column, risk: str, block: int = BLOCK, max_rounds: int = 10_000) -> DataFrame:
    """(parent, start, end, risk) of the windows that the greedy rule takes: highest risk first, then least start, then least end.

    Equal windows of a parent count once. Null parents, starts and risks are left out.
    """
    rows = df.select(F.col(parent).alias("parent"), F.col(start).cast("long").alias("start"), end.cast("long").alias("end"), F.col(risk).cast("double").alias("risk"))
    now = landed(rows.where("parent is not null and start < end and risk is not null").groupBy("parent", "start", "end").agg(F.max("risk").alias("risk")).withColumn("status", F.lit(OPEN)), "peaks")
    longest = now.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    block = max(block, 4 * longest)
    kept = None
    for i in range(max_rounds):
        left = now.agg(F.count_if(F.col("status") == OPEN)).first()[0]
        if not left:
            break
        now = landed(one_round(now, block, longest, block // 2 * (i % 2)), "peaks")
        fresh = now.where(F.col("status") == TAKEN)
        kept = fresh if kept is None else kept.unionByName(fresh)
    else:
        raise RuntimeError("peaks did not settle")
    kept = now.where(F.lit(False)) if kept is None else kept
    kind = df.schema[parent].dataType
    return kept.select(F.col("parent").cast(kind).alias("parent"), "start", "end", "risk").distinct()


def one_round(now: DataFrame, block: int, longest: int, shift: int) -> DataFrame:
    """The open windows that are left, and those newly taken; what was taken a round ago only removes."""
    own = F.floor((F.col("start") + shift) / block)
    first = F.floor((F.col("start") + shift - longest) / block)
    last = F.floor((F.col("end") + shift + longest) / block)
    placed = now.withColumn("own", own).withColumn("b", F.explode(F.sequence(first, last)))
    kind = now.schema["parent"].dataType.simpleString()

    def run(t):
        import pyarrow as pa

        cols = {c: t.column(c).to_numpy() for c in ("start", "end", "risk", "status", "own", "b")}
        inside = cols["own"] == cols["b"]
        if not (inside & (cols["status"] == OPEN)).any():
            return t.slice(0, 0).select(["parent", "start", "end", "risk", "status"])
        status = decided(cols["start"], cols["end"], cols["risk"], cols["status"], inside)
        keep = inside & (cols["status"] == OPEN) & (status >= 0)
        out = t.set_column(t.column_names.index("status"), "status", pa.array(status, pa.int32()))
        return out.filter(pa.array(keep)).select(["parent", "start", "end", "risk", "status"])

    return placed.groupBy("parent", "b").applyInArrow(run, f"parent {kind}, start long, end long, risk double, status int")


def non_maximum(df: DataFrame, parent: str, start: str, risk: str, width: int = 9, most: int = 25, block: int = BLOCK) -> DataFrame:
    """O-03: (parent, start, end, risk, rank): at most `most` disjoint windows of each parent, highest risk first."""
    found = disjoint(df, parent, start, F.col(start) + width, risk, block)
    return top_k(found, ["parent"], [F.desc("risk"), F.asc("start")], most)


def hotspots(heat: DataFrame, sequences: DataFrame, parent: str, pos: str, value: str, sequence: str, most: int = 5, apart: int = 8, context: int = 7, block: int = BLOCK) -> DataFrame:
    """O-04: (parent, position, residue, score, context): peaks of a track at least `apart` from each other, the highest `most`; positions count from 1.

    Peaks closer than `apart` are windows of that length that overlap.
    """
    found = disjoint(heat, parent, pos, F.col(pos) + apart, value, block)
    top = top_k(found, ["parent"], [F.desc("risk"), F.asc("start")], most).select("parent", "start", "risk")
    s = sequences.select(F.col(parent).alias("parent"), F.col(sequence).alias("s"))
    lo = F.greatest(F.lit(0), F.col("start") - context)
    met = top.join(s.hint("merge"), "parent")
    return met.select("parent", (F.col("start") + 1).alias("position"), F.substr("s", F.col("start").cast("int") + 1, F.lit(1)).alias("residue"), F.bround("risk", 4).alias("score"), F.substr("s", lo.cast("int") + 1, (F.col("start") + context + 1 - lo).cast("int")).alias("context"))
