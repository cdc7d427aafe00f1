"""A Merkle manifest of a dataset: leaves, subtree roots by group, one root, and a proof for every row.

A leaf is the sha256 (lowercase hex) of the row's fields, each `-` where null, else its UTF-8 byte count,
a colon and the value, integers in decimal. In each group the leaves stand in the order of the id; while
several nodes are left, every `fanout` consecutive ones become the sha256 of their digests as text, and a
last run may be shorter, even one. What is left is the group's subroot; the subroots, null group first and
others bytewise, give the root likewise. A proof lists the other digests of each run on the way up.

Butterfly exchange: leaves are cut into aligned blocks of fanout^h, and a task makes the tree of a block.
Then the blocks hold equal parts: in round r every block of an aligned group of fanout^(r+1) blocks
sends the root of its own subtree to one block of each other subtree in the group, and receives theirs.
Each block hashes the common ancestor by itself, so after the last round it has all upper digests of its
proofs and the root, without a pass down the tree. A round shuffles one small row for each message; no
task sees more than `fanout` digests of a group. The subroots go through the same steps as one group.

Rows that share an id stand in the order of their leaves; a null id stands first. A null group is a group.
Empty texts are values of length 0. An empty table gives no rows. Extra columns are kept out of leaf and
result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.session import landed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels of a proof, lowest first.
STEPS = "array<struct<left: array<string>, right: array<string>>>"
#: Leaves of a block at most.
BLOCK = 4096
#: Rounds between two written tables.
ROUNDS_A_TABLE = 6


def digest_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields in order."""
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Positions from 0 within each group, which must not be null: ranges of (group, order..) are numbered by themselves and offset by the ranges before.

    One row for each range and group in it is summed over all ranges. The table should be written
    out before, as sampling for the ranges reads it once.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in (group, *order)]).withColumn("__part", F.spark_partition_id())
    placed = landed(placed, "merkle-ranges")
    inside = Window.partitionBy("__part", group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    sizes = placed.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", group, F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    own = placed.withColumn("__own", F.row_number().over(inside) - 1)
    met = own.join(before.hint("merge"), ["__part", group])
    return met.withColumn(out, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def climbed(level: list[str], fanout: int) -> list[list[str]]:
    """All levels of a subtree, leaves first, up to one node."""
    levels = [level]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([digest_of(now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def block_height(block: int, fanout: int) -> int:
    h = 0
    while fanout ** (h + 1) <= block:
        h += 1
    return h


def full_climb(level: list[str], fanout: int, height: int) -> list[list[str]]:
    """The levels of a block that has neighbours: `height` steps, where one node alone is hashed on."""
    levels = [level]
    for _ in range(height):
        now = levels[-1]
        levels.append([digest_of(now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def block_roots(leaves: DataFrame, sizes: DataFrame, fanout: int, height: int) -> DataFrame:
    """(g, block, node, blocks): the root of each block's subtree, and how many blocks its group has."""

    def run(table):
        import pyarrow as pa

        t = table.sort_by("pos")
        level = t.column("leaf").to_pylist()
        made = [climbed(level, fanout)[-1][0], full_climb(level, fanout, height)[-1][0]]
        return pa.table([t.column("g").slice(0, 1), t.column("block").slice(0, 1), *[pa.array([x]) for x in made]], names=["g", "block", "alone", "among"])

    roots = leaves.select("g", "block", "pos", "leaf").groupBy("g", "block").applyInArrow(run, "g string, block long, alone string, among string")
    return roots.join(sizes.hint("merge"), "g").select("g", "block", F.when(F.col("blocks") == 1, F.col("alone")).otherwise(F.col("among")).alias("node"), "blocks")


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(g, block, blocks, root, upper): each block's upper proof levels, lowest first, as structs (left, right) of digests, and the group's root.

    `blocks` holds (g, block, node, blocks). Groups of one block are done at once; all others take part in as many
    rounds as the largest of them needs, and each stops with its own.
    """
    now = landed(blocks.withColumn("upper", F.expr(f"cast(array() as {STEPS})")), "merkle-blocks")
    most = now.agg(F.max("blocks")).first()[0] or 0
    span, rounds = 1, 0
    while span < most:
        low = F.lit(span).cast("long")
        # Which subtree of the group a block is in, the first block of the group, and how many blocks each sibling subtree has.
        mine = F.expr(f"(block div {span}) % {fanout}")
        group_at = F.expr(f"block - block % {span * fanout}")
        subtree_at = F.expr(f"block - block % {span}")
        have = F.least(low, F.col("blocks") - subtree_at)
        offset = F.col("block") - subtree_at
        going = F.col("blocks") > span
        targets = F.array(F.col("block"))
        for s in range(fanout):
            first = group_at + s * span
            size = F.greatest(F.lit(0).cast("long"), F.least(low, F.col("blocks") - first))
            # Block q of the sibling asks block q modulo `have` of this subtree, so a short last subtree is asked by turns.
            asked = F.when(going & (mine != s) & (offset < size), F.sequence(first + offset, first + size - 1, F.greatest(have, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
            targets = F.concat(targets, asked)
        sent = now.select("g", "blocks", "block", "node", "upper", mine.alias("at"), F.explode(targets).alias("to"))
        # Only a block's message to itself carries what it has so far.
        sent = sent.select("g", "to", "at", "node", F.when(F.col("block") == F.col("to"), F.struct("blocks", "upper", "at")).alias("own"))
        met = sent.groupBy("g", F.col("to").alias("block")).agg(
            F.any_value("own", F.lit(True)).alias("own"),
            F.array_sort(F.collect_list(F.struct("at", "node"))).alias("run"),
        )
        left, right = (F.transform(F.filter("run", side), lambda x: x["node"]) for side in (lambda x: x["at"] < F.col("own.at"), lambda x: x["at"] > F.col("own.at")))
        going = F.col("own.blocks") > span
        node = F.when(going, F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), ""), 256)).otherwise(F.col("run")[0]["node"])
        upper = F.when(going, F.array_append("own.upper", F.struct(left.alias("left"), right.alias("right")))).otherwise(F.col("own.upper"))
        now = met.select("g", "block", node.alias("node"), F.col("own.blocks").alias("blocks"), upper.alias("upper"))
        span, rounds = span * fanout, rounds + 1
        if rounds % ROUNDS_A_TABLE == 0 and span < most:
            now = landed(now, "merkle-rounds")
    return landed(now.select("g", "block", "blocks", F.col("node").alias("root"), "upper"), "merkle-upper")


def key_of(group: str | None) -> Column:
    """A group as a string that is never null and sorts null first: `0`, or `1` and the value."""
    return F.lit("1") if group is None else F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))


def placed(leaves: DataFrame, order: list[str], fanout: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves with their block, and the blocks' roots and upper proofs."""
    at = landed(numbered(leaves, "g", order, "pos").withColumn("block", F.expr(f"pos div {fanout**height}")), "merkle-leaves")
    sizes = at.groupBy("g").agg((F.max("block") + 1).alias("blocks"))
    return at, butterfly(block_roots(at, sizes, fanout, height), fanout)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, touched: Column | None = None, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "lang", fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """(id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every row.

    `proof` lists, level by level, structs (left, right) of sibling digests. `tampered` replaces fields
    where `touched` holds; folded_root is what such a row, or the row as it is, gives with its proof,
    and verified says whether that is the root.
    """
    height = block_height(block, fanout)
    names = list(fields)
    cols = [F.col(f"`{c}`") for c in names]
    changed = [tampered[c].cast(docs.schema[c].dataType) if tampered and c in tampered else F.col(f"`{c}`") for c in names]
    other = F.when(touched, leaf(changed)) if touched is not None else F.lit(None).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(f"`{id_col}`").alias("id"), key_of(group).alias("g"), leaf(cols).alias("leaf"), other.alias("other"))
    at, upper = placed(landed(made, "merkle-made"), ["id", "leaf"], fanout, height)
    # The subroots are the leaves of a tree of their own.
    tops = upper.where("block = 0").select(F.lit("1").alias("g"), F.col("g").alias("id"), F.col("root").alias("leaf"))
    top_at, top_upper = placed(landed(tops, "merkle-tops"), ["id"], fanout, height)
    top = landed(proved(top_at, top_upper, fanout, height, "string").select(F.col("id").alias("g"), F.col("root").alias("top_root"), F.col("proof").alias("top_proof")), "merkle-top-proofs")
    return proved(at, upper, fanout, height, kind, top)


def proved(leaves: DataFrame, upper: DataFrame, fanout: int, height: int, kind: str, top: DataFrame | None = None) -> DataFrame:
    """Every leaf with its whole proof and the root that the proof leads to; blocks meet their upper proofs in groups of one block."""
    if top is not None:
        side = upper.join(top.hint("merge"), "g")
    else:
        side = upper.withColumn("top_root", F.col("root")).withColumn("top_proof", F.expr(f"cast(array() as {STEPS})"))

    def run(left, right):
        import pyarrow as pa

        t = left.sort_by("pos")
        block = right.slice(0, 1).to_pylist()[0]
        level = t.column("leaf").to_pylist()
        levels = climbed(level, fanout) if block["blocks"] == 1 else full_climb(level, fanout, height)
        above = [(s["left"], s["right"]) for s in [*block["upper"], *block["top_proof"]]]
        proofs, shas, folded = [], [], []
        for i, (own, other) in enumerate(zip(level, t.column("other").to_pylist() if "other" in t.column_names else [None] * len(level), strict=True)):
            steps, at = [], i
            for nodes in levels[:-1]:
                first = at - at % fanout
                steps.append((nodes[first:at], nodes[at + 1 : first + fanout]))
                at //= fanout
            steps += above
            h = own if other is None else other
            for before, after in steps:
                h = digest_of([*before, h, *after])
            proofs.append([{"left": b, "right": a} for b, a in steps])
            shas.append(digest_of([d for b, a in steps for d in (*b, *a)]))
            folded.append(h)
        step = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
        m = len(level)
        same = [h == block["top_root"] for h in folded]
        return pa.table([t.column("id"), t.column("leaf"), pa.array([block["root"]] * m, pa.string()), pa.array([block["top_root"]] * m, pa.string()), pa.array(proofs, step), pa.array(shas, pa.string()), pa.array(folded, pa.string()), pa.array(same)], names=["id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])

    return leaves.groupBy("g", "block").cogroup(side.groupBy("g", "block")).applyInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof {STEPS}, proof_sha256 string, folded_root string, verified boolean")
