"""Connected components of an edge table, by alternating stars, and content ids of components (A-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.session import landed


def _least_neighbour(both: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours; partial minima are taken before the shuffle."""
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of an edge: component is the least node it is connected with.

    Each round points larger neighbours, then smaller ones, at the least neighbour (two min
    aggregations and joins on the node), is written out, and the loop ends when the edge set stays
    the same. Rounds grow with the logarithm of the longest path; no group is ever collected.
    Edges with a null end are ignored; an empty table gives no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = landed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both).hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        small = large.join(_least_neighbour(large).hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = landed(small, "edges")
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Bytes of members that are joined before they travel.
PIECE = 1 << 20


def component_digests(members: DataFrame, component: str = "component", member: str = "parent", prefix: str = "", digits: int = 16) -> DataFrame:
    """A-06: (component, component_id, n_members): prefix and the first digits of the sha256 of the distinct members, ascending by bytes and joined by line ends.

    Members are range-sorted by (component, member), so a component that holds a large share of them is
    sorted by many tasks; each joins what it has to pieces of PIECE bytes. The pieces of a component then pass one task in
    order, which hashes them as they come. No list of members is held anywhere. Null components and
    members are left out.
    """
    rows = members.select(F.col(component).alias("c"), F.col(member).cast("string").alias("m")).where("c is not null and m is not null").distinct()
    kind = members.schema[component].dataType.simpleString()
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = landed(rows, "members").repartitionByRange(n, "c", "m").sortWithinPartitions("c", "m").withColumn("part", F.spark_partition_id())

    def joined(batches):
        import pyarrow as pa

        def emit(c, part, no, held):
            return pa.RecordBatch.from_arrays([pa.array([c], type=key), pa.array([part], pa.int32()), pa.array([no], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b"\n".join(held)], pa.binary())], names=["c", "part", "no", "n", "piece"])

        now, held, size, no, key = None, [], 0, 0, None
        for b in batches:
            key = b.schema.field(0).type
            for c, m, part in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if held and (now[0] != c or size >= PIECE):
                    yield emit(*now, no, held)
                    no, held, size = (no + 1 if now[0] == c else 0), [], 0
                now = (c, part)
                held.append(m.encode())
                size += len(held[-1])
        if held:
            yield emit(*now, no, held)

    pieces = landed(ordered.mapInArrow(joined, f"c {kind}, part int, no long, n long, piece binary"), "pieces")

    def digested(batches):
        import hashlib

        import pyarrow as pa

        now, h, total, done = None, None, 0, []
        key = None

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((key, pa.string(), pa.int64()))], names=["component", "component_id", "n_members"])
            done.clear()
            return made

        for b in batches:
            key = b.schema.field(0).type
            for c, n_here, piece in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if h is not None and c != now:
                    done.append((now, prefix + h.hexdigest()[:digits], total))
                    h = None
                if h is None:
                    now, h, total = c, hashlib.sha256(), 0
                else:
                    h.update(b"\n")
                h.update(piece)
                total += n_here
            if done:
                yield out()
        if h is not None:
            done.append((now, prefix + h.hexdigest()[:digits], total))
            yield out()

    streamed = pieces.repartition("c").sortWithinPartitions("c", "part", "no").select("c", "n", "piece")
    return streamed.mapInArrow(digested, f"component {kind}, component_id string, n_members long")
