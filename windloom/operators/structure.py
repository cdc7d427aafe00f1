"""Chains against designs, accessibility tracks, interface matrices and structural gates (J-15, J-16, J-25 to J-27, A-33, F-16, F-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.operators.join import within_distance
from windloom.operators.rank import top_k

#: Residues a window must have observed, the buried cutoff, and the gates' thresholds.
LEAST_OBSERVED, BURIED = 5, 0.25
PLDDT_MIN, PAE_MAX, RMSD_MAX = 80.0, 10.0, 1.0


def chain_offset(chain: Column, design: Column) -> Column:
    """J-16: where an observed chain lies in a design: its start inside, minus the design's start inside it, else null."""
    inside, around = F.position(chain, design), F.position(design, chain)
    return F.when(F.char_length(chain) == 0, None).when(inside > 0, inside - 1).when(around > 0, 1 - around)


def best_chains(chains: DataFrame, designs: DataFrame, on: str = "pdb") -> DataFrame:
    """J-16: for each design the longest observed chain that matches, the first of equal ones."""
    met = designs.join(chains.hint("merge"), on).withColumn("offset", chain_offset(F.col("chain_sequence"), F.col("sequence"))).where("offset is not null")
    return top_k(met, ["parent"], [F.char_length("chain_sequence").desc(), F.col("chain")], 1).drop("rank")


#: Residues of one block: what windows meet as a list.
BLOCK = 16


def window_accessibility(windows: DataFrame, residues: DataFrame, parent: str = "parent") -> DataFrame:
    """J-15: mean relative accessibility and buried share of each window; null under LEAST_OBSERVED residues. residues: (parent, pos, rsa) in design coordinates.

    Windows and residues are listed by blocks of BLOCK positions, and lists are joined: no row is made of a window and a residue.
    """
    block = lambda at: F.floor(at / BLOCK)
    seen = residues.where("rsa is not null").groupBy(parent, block(F.col("pos")).alias("__near")).agg(F.array_sort(F.collect_list(F.struct("pos", "rsa"))).alias("__r"))
    listed = windows.where(F.col("end") > F.col("start")).groupBy(parent, block(F.col("start")).alias("__block")).agg(F.collect_set(F.struct("start", "end")).alias("__w"), block(F.max("end") - 1).alias("__last"))
    asked = listed.select(parent, "__block", F.explode(F.sequence("__block", "__last")).alias("__near"))
    around = asked.join(seen.hint("merge"), [parent, "__near"]).groupBy(parent, "__block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__near", "__r"))), lambda x: x["__r"])).alias("__r"))
    met = listed.join(around.hint("merge"), [parent, "__block"], "left").select(parent, F.explode("__w").alias("w"), "__r").select(parent, "w.start", "w.end", "__r")
    of = F.filter(F.coalesce("__r", F.array().cast("array<struct<pos:bigint,rsa:double>>")), lambda x: (x["pos"] >= F.col("start")) & (x["pos"] < F.col("end")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("low"))
    sums = F.aggregate(of, zero, lambda t, x: F.struct((t["n"] + 1).alias("n"), (t["sum"] + x["rsa"]).alias("sum"), (t["low"] + F.when(x["rsa"] < BURIED, 1).otherwise(0)).alias("low")))
    each = met.withColumn("__t", sums)
    n, enough = F.col("__t.n").cast("long"), F.col("__t.n") >= LEAST_OBSERVED
    return each.select(parent, "start", "end", n.alias("observed"), F.when(enough, F.col("__t.sum") / n).alias("mean_rsa"), F.when(enough, F.col("__t.low") / n).alias("buried"))


def project(residues: DataFrame, offsets: DataFrame, lengths: DataFrame, parent: str = "parent") -> DataFrame:
    """F-16: chain residues (parent, chain_pos, rsa) in design coordinates, null where nothing was observed."""
    spine = lengths.where("length > 0").select(parent, F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("pos"))
    moved = residues.join(offsets.select(parent, "offset").hint("merge"), parent).select(parent, (F.col("chain_pos") + F.col("offset")).alias("pos"), "rsa")
    return spine.join(moved.hint("merge"), [parent, "pos"], "left")


def map_sequence(query: Column, observed: Column) -> Column:
    """J-26: exact, a safe trim of the ends (15 residues or more, 0.9 covered, 5 or fewer off each end), or rejected."""
    at = F.position(observed, query)
    before, after = at - 1, F.char_length(query) - (at - 1) - F.char_length(observed)
    ok = (at > 0) & (F.char_length(observed) >= 15) & (F.char_length(observed) >= 0.9 * F.char_length(query)) & (before <= 5) & (after <= 5)
    kind = F.when(query == observed, "exact").when(ok, "trimmed").otherwise("rejected")
    missing = F.when(kind == "rejected", F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.char_length(query) - 1), lambda p: (p < before) | (p >= before + F.char_length(observed))))
    return F.struct(kind.alias("status"), F.when(kind != "rejected", before).alias("offset"), missing.alias("unresolved"))


def contacts(atoms: DataFrame, cutoff: float = 4.5, structure: str = "file") -> DataFrame:
    """J-25: residues with their pairs of heavy atoms on the other chain within the cutoff and the least distance, most contacts first."""
    heavy = atoms.where("element <> 'H'").select(structure, "chain", F.struct("chain", "number", "residue", "line").alias("id"), "x", "y", "z")
    met = within_distance(heavy, cutoff, structure, "chain")
    both = met.select(structure, F.explode(F.array("id", "id_b")).alias("r"), "distance")
    return both.groupBy(structure, "r.chain", "r.number", "r.residue").agg(F.count(F.lit(1)).alias("contacts"), F.min("distance").alias("distance")).orderBy(structure, F.desc("contacts"), "distance", "number")


def hotspots(requested: DataFrame, residues: DataFrame, target: str | None = None) -> DataFrame:
    """J-27: (hotspot, chain, number, residue, status) of requests like A45 or B-3: ok, invalid, absent, or other chain where it is not the target's. residues: (chain, number, residue), the least name of equal places."""
    parts = F.regexp_extract_all(F.trim("hotspot"), F.lit(r"^([A-Za-z0-9])(-?[0-9]+)$"), F.lit(0))
    asked = requested.select("hotspot", F.get(parts, F.lit(0)).alias("__at")).select("hotspot", F.left("__at", F.lit(1)).alias("chain"), F.substr("__at", F.lit(2)).try_cast("int").alias("number"))
    known = residues.groupBy("chain", "number").agg(F.min("residue").alias("residue"))
    met = asked.join(known.hint("merge"), ["chain", "number"], "left")
    other = F.lit(False) if target is None else F.col("chain") != target
    status = F.when(F.col("chain").isNull() | F.col("number").isNull(), "invalid").when(F.col("residue").isNull(), "absent").when(other, "other chain").otherwise("ok")
    return met.select("hotspot", "chain", "number", "residue", status.alias("status"))


def interface_pae(matrices: DataFrame, split: str = "n_first") -> DataFrame:
    """A-33: mean of both off-diagonal blocks of a square matrix column `pae`; the first chain has `split` residues."""
    cells = matrices.select("id", split, F.posexplode("pae").alias("i", "row")).select("id", split, "i", F.posexplode("row").alias("j", "v"))
    return cells.where((F.col("i") < F.col(split)) != (F.col("j") < F.col(split))).groupBy("id").agg(F.avg("v").alias("interface_pae"))


def gates(candidates: DataFrame) -> DataFrame:
    """F-25: checks of (plddt, interface_pae, rmsd, clashes, sequence, and that a perplexity is recorded where there is such a column), failing where a metric is missing; eligible only if all pass."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("sequence"))
    check = lambda name, value, ok: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"))
    c = F.col
    df = candidates.withColumn("__copies", copies)
    df = df.withColumn("checks", F.array(
        check("monomer_plddt", c("plddt"), c("plddt") >= PLDDT_MIN),
        check("interface_pae", c("interface_pae"), c("interface_pae") <= PAE_MAX),
        check("binder_rmsd", c("rmsd"), c("rmsd") <= RMSD_MAX),
        check("clashes", c("clashes"), c("clashes") == 0),
        check("unique_sequence", c("__copies"), c("sequence").isNotNull() & (c("__copies") == 1)),
        *([check("perplexity_recorded", c("perplexity"), c("perplexity").isNotNull())] if "perplexity" in candidates.columns else []),
    )).drop("__copies")
    passed = F.forall("checks", lambda x: x["passed"])
    return df.withColumn("status", F.when(passed, "pass").otherwise("fail")).withColumn("selection", F.when(passed, "eligible").otherwise("blocked"))


def gyration(atoms: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """A-32: (keys.., n, radius): root mean square distance of a file's points from their centroid, null under `least`. Sums of one pass: E[v*v] - E[v]^2 around the file's first point."""
    first = atoms.groupBy(*keys).agg(*[F.min(c).alias(f"__{c}") for c in "xyz"])
    met = atoms.join(first.hint("merge"), keys)
    d = {c: F.col(c) - F.col(f"__{c}") for c in "xyz"}
    sums = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(d[c]).alias(f"__m{c}") for c in "xyz"], F.avg(sum(d[c] * d[c] for c in "xyz")).alias("__q"))
    spread = F.col("__q") - sum(F.col(f"__m{c}") * F.col(f"__m{c}") for c in "xyz")
    return sums.select(*keys, "n", F.when(F.col("n") >= least, F.sqrt(F.greatest(F.lit(0.0), spread))).alias("radius"))


def gyration_by_target(atoms: DataFrame, target: str, file: str, most: int = 100) -> DataFrame:
    """A-32: (target, n_files, mean, deviation): mean and population deviation of the radii of each target's first `most` files by name; no deviation of one file."""
    files = top_k(atoms.select(target, file).distinct(), [target], [F.col(file)], most).select(target, file)
    found = gyration(atoms.join(files.hint("merge"), [target, file], "left_semi"), [target, file]).where("radius is not null")
    return found.groupBy(target).agg(F.count(F.lit(1)).alias("n_files"), F.avg("radius").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("radius")).alias("deviation"))
