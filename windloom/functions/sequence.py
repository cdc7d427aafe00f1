"""Column expressions on sequences: cleaning, identity, composition, one-hot, mutation (P-*, F-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty residues, hydrophobic ones, disorder-prone ones, the tags that cleaning removes.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AILMFVWY"
DISORDER = "GSTNPQEDKR"
TAGS = "(H{6,}|^MGSSHHHHHHSSGLVPRGSH|^GSHM|^MGS|GSGSGS+|LEHHHHHH$)"


def canonical(s: Column) -> Column:
    """P-01: only the twenty residues."""
    return s.rlike(f"^[{RESIDUES}]*$")


def clean_or_reject(s: Column, tag: str = TAGS) -> Column:
    """P-02: trimmed, upper case, tag removed; a sequence with any other letter becomes empty."""
    t = F.regexp_replace(F.upper(F.trim(s)), tag, "")
    return F.when(canonical(t), t).otherwise(F.lit(""))


def clean_delete(s: Column) -> Column:
    """P-03: header lines and every character that is no residue are deleted."""
    return F.regexp_replace(F.upper(F.regexp_replace(s, r"(?m)^>.*$", "")), f"[^{RESIDUES}]", "")


def from_text(s: Column) -> Column:
    """The sequence that a text stands for: its ASCII letters in upper case, without B, J, O, U, X and Z."""
    return F.upper(F.regexp_replace(s, f"[^{RESIDUES}{RESIDUES.lower()}]+", ""))


def strip_tags(s: Column, run: int = 4, reach: int = 25) -> Column:
    """P-04: a run of H within the first `reach` residues cuts the front, then one within the last cuts the end."""
    hit = F.regexp_extract(F.left(s, F.lit(reach)), f"H{{{run},}}", 0)
    front = F.when(hit != "", F.substr(s, F.instr(F.left(s, F.lit(reach)), "H" * run) + F.char_length(hit))).otherwise(s)
    tail = F.right(front, F.lit(reach))
    at = F.instr(tail, "H" * run)
    return F.when(at > 0, F.substr(front, F.lit(1), F.char_length(front) - F.char_length(tail) + at - 1)).otherwise(front)


def fraction(s: Column, letters: str) -> Column:
    """P-11: share of the given letters; null for an empty sequence."""
    n = F.char_length(s)
    return F.when(n > 0, (n - F.char_length(F.translate(s, letters, ""))) / n)


def disorder_runs(s: Column, least: int = 8) -> Column:
    """P-12: runs of at least `least` disorder-prone residues."""
    return F.regexp_count(s, F.lit(f"[{DISORDER}]{{{least},}}"))


def digest(n: int, *parts: Column) -> Column:
    """P-08: the first n hex digits of the SHA-256 of the parts joined by bars; null parts are empty."""
    return F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(n))


def add_tag(tags: Column, tag: str) -> Column:
    """P-10: append to a ;-separated provenance string."""
    return F.concat_ws(";", F.nullif(tags, F.lit("")), F.lit(tag))


def mutate(s: Column, mutations: Column) -> Column:
    """P-14: apply an array of (pos, to) point mutations, positions from 0."""
    return F.aggregate(mutations, s, lambda acc, m: F.overlay(acc, m["to"], m["pos"] + 1, F.lit(1)))


def one_hot_indexes(peptide: Column) -> Column:
    """F-18: pos * 20 + residue index for the residues known; others stay zero."""
    at = F.transform(F.split(peptide, ""), lambda c, i: F.struct(i.alias("i"), F.instr(F.lit(RESIDUES), c).alias("r")))
    return F.transform(F.filter(at, lambda x: x["r"] > 0), lambda x: x["i"] * 20 + x["r"] - 1)


def identity(a: Column, b: Column) -> Column:
    """J-17: equal positions over the longer length."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.greatest(F.char_length(a), F.char_length(b))


def length_between(s: Column, least: int, most: int) -> Column:
    """P-05."""
    return F.char_length(s).between(least, most)


def differences(a: Column, b: Column) -> Column:
    """P-14: array of (pos, before, after) where two sequences of one length differ; null for different lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("before"), y.alias("after")))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["before"].alias("before"), p["after"].alias("after")))
    return F.when(F.char_length(a) == F.char_length(b), F.filter(placed, lambda p: p["before"] != p["after"]))


def kmer_code(peptide: Column, k: int) -> Column:
    """A long for a text of k capitals, 12 at most, in the order of texts: five bits a letter. Numbers are compared in a hash aggregation, texts only in a sorted one."""
    return sum(F.shiftleft((F.ascii(F.substring(peptide, i + 1, 1)) - 65).cast("long"), 5 * (k - 1 - i)) for i in range(k))


def kmer_text(code: Column, k: int) -> Column:
    """The text of a `kmer_code`."""
    return F.concat(*[F.char(65 + F.shiftright(code, 5 * (k - 1 - i)).bitwiseAND(31)) for i in range(k)])
