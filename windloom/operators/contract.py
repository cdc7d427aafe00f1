"""A dataset's contract: findings, gate and card in the pass that writes it (X-01, X-02, X-04, S-14, S-15).

The rows are written once to a folder of their own version. Row rules, coverage and distributions are
`Observation` metrics of that very write, so they cost no pass. What needs groups, repeated ids, leaks
of clusters over splits, counts by group, is one aggregation by GROUPING SETS over the few columns it
needs of what was written, one scan. Only if no finding is an error is the version named in
`manifest`, from which readers take it; a version that fails stays unnamed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from windloom.functions.sequence import canonical
from windloom.operators.quality import GateError

FINDINGS = "rule string, severity string, n_bad long, sample array<string>"
SAMPLE = 5


@dataclass(frozen=True)
class Contract:
    """What rows must be. Names of columns; `required` are never null, `targets` may be and then count as warnings."""

    key: str = "row_id"
    sequence: str = "peptide"
    length: str = "length"
    start: str = "start"
    end: str = "end"
    flanks: tuple[str, ...] = ("n_flank", "c_flank")
    split: str = "split"
    clusters: tuple[str, ...] = ("protein_cluster_id", "peptide_cluster_id")
    required: tuple[str, ...] = ("row_id", "peptide", "length", "start", "end", "split", "protein_cluster_id", "peptide_cluster_id")
    targets: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"split": ("train", "val", "test")})
    groups: tuple[str, ...] = ("split",)

    def columns(self) -> list[str]:
        return sorted({*self.required, *self.targets, *self.enums, *self.groups, *self.flanks, *self.clusters, self.key, self.sequence, self.length, self.start, self.end, self.split})


def row_rules(c: Contract) -> dict[str, tuple[str, Column]]:
    """name -> (severity, condition of a bad row). A null is bad by its own rule alone."""
    out = {f"{name}: required value missing": ("error", F.col(name).isNull()) for name in c.required}
    out |= {
        "length is not the sequence's": ("error", F.col(c.length) != F.char_length(c.sequence)),
        "end - start is not the length": ("error", F.col(c.end) - F.col(c.start) != F.col(c.length)),
        "start under 0": ("error", F.col(c.start) < 0),
    }
    out |= {f"{name}: other residues": ("error", (F.col(name) != "") & ~canonical(F.upper(name))) for name in (c.sequence, *c.flanks)}
    out |= {f"{name}: value not allowed": ("error", ~F.col(name).isin(*allowed)) for name, allowed in c.enums.items()}
    return out | {f"{name}: target missing": ("warning", F.col(name).isNull()) for name in c.targets}


def observed(c: Contract) -> tuple[list[Column], list[str]]:
    """Metrics of one pass: rows, bad rows by rule, coverage and distribution of the targets."""
    rules = row_rules(c)
    made = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{i}") for i, (_, bad) in enumerate(rules.values())]
    for i, name in enumerate(c.targets):
        x = F.col(name).cast("double")
        made += [F.count(x).alias(f"t{i}n"), F.avg(x).alias(f"t{i}mean"), F.stddev_samp(x).alias(f"t{i}std"), F.min(x).alias(f"t{i}min"), F.max(x).alias(f"t{i}max")]
    return made, list(rules)


def grouped(df: DataFrame, c: Contract) -> DataFrame:
    """(name, value, n, lo, hi) by GROUPING SETS: each value of the key, the clusters and the groups, with its rows and the least and largest split. One scan."""
    names = list(dict.fromkeys([c.key, *c.clusters, *c.groups]))
    cols = [F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)]
    rows = df.select(*cols, F.col(c.split).alias("s"))
    each = rows.groupingSets([[F.col(f"c{i}")] for i in range(len(names))], *[F.col(f"c{i}") for i in range(len(names))]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, n in enumerate(names):
        own = F.col("g") == ((1 << len(names)) - 1) ^ (1 << (len(names) - 1 - i))
        which, value = F.when(own, n).otherwise(which), F.when(own, F.col(f"c{i}")).otherwise(value)
    return each.select(which.alias("name"), value.alias("value"), "n", "lo", "hi")


def group_findings(each: DataFrame, c: Contract) -> DataFrame:
    """Repeated keys and leaking clusters: how many, and the first few."""
    repeated = (F.col("name") == c.key) & (F.col("n") > 1) & F.col("value").isNotNull()
    leaking = F.col("name").isin(*c.clusters) & (F.col("lo") != F.col("hi")) & F.col("value").isNotNull()
    rule = F.when(repeated, F.concat("name", F.lit(": repeated"))).when(leaking, F.concat("name", F.lit(": in several splits")))
    bad = each.select(rule.alias("rule"), "value").where("rule is not null")
    from windloom.operators.rank import top_k

    counts = bad.groupBy("rule").agg(F.count(F.lit(1)).alias("n_bad"))
    few = top_k(bad, ["rule"], [F.col("value")], SAMPLE).groupBy("rule").agg(F.array_sort(F.collect_list("value")).alias("sample"))
    return counts.join(few.hint("merge"), "rule").select("rule", F.lit("error").alias("severity"), "n_bad", "sample")


def missing_columns(df: DataFrame, c: Contract) -> list[str]:
    return [name for name in c.columns() if name not in df.columns]


def findings(df: DataFrame, c: Contract) -> DataFrame:
    """X-01: one table of all findings with bad rows; missing columns alone where there are any."""
    spark = df.sparkSession
    if missing := missing_columns(df, c):
        return spark.createDataFrame([("missing columns", "error", len(missing), missing)], FINDINGS)
    made, names = observed(c)
    return _findings(spark, df.agg(*made).first().asDict(), names, c, grouped(df, c))


def _findings(spark: SparkSession, got: dict, names: list[str], c: Contract, each: DataFrame) -> DataFrame:
    severity = {name: s for name, (s, _) in row_rules(c).items()}
    rows = [(name, severity[name], got[f"r{i}"], []) for i, name in enumerate(names) if got[f"r{i}"]]
    return spark.createDataFrame(rows, FINDINGS).unionByName(group_findings(each, c))


def publish(df: DataFrame, path: str, c: Contract, config: dict | None = None, sources: list[dict] | None = None, partition_by: tuple[str, ...] = ()) -> dict:
    """X-02, X-04: write a version, gate it, and name it in the manifest; returns the manifest. A GateError lists the errors."""
    spark, path = df.sparkSession, path.rstrip("/")
    if missing := missing_columns(df, c):
        raise GateError(f"missing columns: {missing}")
    version, seen = uuid.uuid4().hex, Observation()
    made, names = observed(c)
    writer = df.observe(seen, *made).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/version={version}")
    got = seen.get
    landed = spark.read.parquet(f"{path}/version={version}")
    each = grouped(landed, c).persist()  # keys and clusters: spills to disk, and is made again if it is lost
    try:
        found = _findings(spark, got, names, c, each).collect()  # a row a rule
        errors = [r for r in found if r["severity"] == "error"]
        if errors:
            raise GateError("; ".join(f"{r['rule']}: {r['n_bad']}" + (f" (e.g. {r['sample']})" if r["sample"] else "") for r in sorted(errors)))
        by = each.where(F.col("name").isin(*c.groups)).select("name", "value", "n").collect()  # a row for each value of a group column
        distinct = {r["name"]: r["n"] for r in each.where(F.col("value").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        each.unpersist()
    card = {
        "version": version,
        "rows": got["n"],
        "config": config or {},
        "sources": sources or [],
        "by": {g: {str(r["value"]): r["n"] for r in by if r["name"] == g} for g in c.groups},
        "distinct": distinct,
        "targets": {name: {k: got[f"t{i}{k}"] for k in ("n", "mean", "std", "min", "max")} | {"missing": got["n"] - got[f"t{i}n"]} for i, name in enumerate(c.targets)},
        "warnings": sorted(f"{r['rule']}: {r['n_bad']}/{got['n']}" for r in found if r["severity"] == "warning"),
    }
    spark.createDataFrame([(json.dumps(card, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return card


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/manifest").first()[0])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The version that the manifest names."""
    return spark.read.parquet(f"{path.rstrip('/')}/version={manifest(spark, path)['version']}")


def markdown(card: dict) -> str:
    """S-15: the card as text."""
    lines = ["# Dataset card", "", f"- Version: `{card['version']}`", f"- Rows: {card['rows']}", "", "## Sources", ""]
    for s in card["sources"]:
        lines += [f"- **{s['name']}** ({s['n_records']} records): {s['license']}", f"  - {s['url']}"]
    for group, counts in card["by"].items():
        lines += ["", f"## By {group}", "", *[f"- {k}: {n}" for k, n in sorted(counts.items())]]
    lines += ["", "## Leakage audit", "", "Passed: no cluster is in several splits.", "", "## Labels", ""]
    for name, t in card["targets"].items():
        spread = "no values" if not t["n"] else f"mean={t['mean']:.4f} std={t['std'] or 0:.4f} min={t['min']:.4f} max={t['max']:.4f}"
        lines.append(f"- {name}: {t['n']} present, {t['missing']} missing, {spread}")
    if card["warnings"]:
        lines += ["", "## Warnings", "", *[f"- {w}" for w in card["warnings"]]]
    return "\n".join([*lines, ""])
