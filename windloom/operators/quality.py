"""Data-quality rules, gates and content fingerprints (X-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    pass


def rules(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """X-01: (rule, severity, n_bad, n_rows) of row conditions that are bad when true, all in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, (_, bad) in checks.items()])
    made = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(name).alias("n_bad")) for name, (severity, _) in checks.items()])
    return counted.select(F.explode(made).alias("r"), "__rows").select("r.*", F.col("__rows").alias("n_rows"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """O-16: keys on more than one row, with their number."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """A-15: groups in more than one split."""
    each = df.select(group, split).distinct()
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("n_splits")).where("n_splits > 1")


def gate(findings: DataFrame) -> None:
    """X-02: raise if a rule of severity error has bad rows."""
    bad = findings.where((F.col("severity") == "error") & (F.col("n_bad") > 0)).collect()  # a row a rule
    if bad:
        raise GateError(", ".join(f"{r['rule']}: {r['n_bad']}" for r in bad))


def fingerprint(df: DataFrame, version: str = "1") -> DataFrame:
    """X-03: a digest of the content that ignores row order and counts repeats."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return s.select(F.col("n").alias("n_rows"), F.sha2(F.concat_ws("|", F.lit(version), F.lit(",".join(sorted(df.columns))), F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256).alias("fingerprint"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-09, A-10: present, missing, mean, sample deviation and range of each column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    made = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}__n").alias("present"), (F.col("__rows") - F.col(f"{c}__n")).alias("missing"), *[F.col(f"{c}__{k}").alias(k) for k in ("mean", "std", "min", "max")]) for c in columns])
    return df.agg(*aggs).select(F.explode(made).alias("r")).select("r.*")


def json_metric(doc: Column, *paths: str) -> Column:
    """F-24: the first dotted path that holds a number, or a list of numbers (their mean); booleans do not count."""
    found = []
    for p in paths:
        raw = F.get_json_object(doc, f"$.{p}")
        is_list = raw.startswith("[")
        listed = F.from_json(F.when(is_list, raw), "array<double>")
        mean = F.aggregate(listed, F.lit(0.0), lambda s, x: s + x) / F.size(listed)
        found.append(F.when(is_list, mean).when(raw.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), raw.try_cast("double")))
    return F.coalesce(*found)


def provider_status(requested: DataFrame, answered: DataFrame, key: list[str], supported: Column) -> DataFrame:
    """X-07: ok, unsupported, unavailable or error for each request; values of missing answers stay null. answered has `key`, `score` and `error`."""
    met = requested.join(answered.withColumn("__there", F.lit(True)), key, "left")
    status = F.when(~supported, "unsupported").when(F.col("__there").isNull(), "unavailable").when(F.col("error").isNotNull(), "error").otherwise("ok")
    return met.withColumn("status", status).withColumn("score", F.when(status == "ok", F.col("score"))).drop("__there")


def warnings(**conditions: Column) -> Column:
    """X-08: the names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))


def provenance(df: DataFrame, value: str, tags: str, tag: str) -> DataFrame:
    """A-11: how many values were measured, filled in (they carry the tag) or are missing."""
    filled = F.contains(F.coalesce(tags, F.lit("")), F.lit(tag))
    there = F.col(value).isNotNull()
    return df.agg(F.count_if(there & ~filled).alias("measured"), F.count_if(there & filled).alias("imputed"), F.count_if(~there).alias("missing"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-12: (name, n_distinct); each column's values go to one row each before they are counted."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    return long.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_distinct"))


def valid_folds(df: DataFrame, fold: str, outside: Column, n: int = 5) -> DataFrame:
    """G-08: (n_rows, n_not_integer, n_null, n_missing): fold numbers that are no integer of 0..n-1, nulls outside the challenge, folds without a row."""
    number = F.col(fold).try_cast("int")
    ok = number.isNotNull() & (number.cast("string") == F.col(fold).cast("string")) & number.between(0, n - 1)
    found = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(fold).isNotNull() & ~F.coalesce(ok, F.lit(False))).alias("n_not_integer"), F.count_if(F.col(fold).isNull() & ~outside).alias("n_null"), *[F.count_if(ok & (number == i)).alias(f"__f{i}") for i in range(n)])
    return found.select("n_rows", "n_not_integer", "n_null", sum(F.when(F.col(f"__f{i}") == 0, 1).otherwise(0) for i in range(n)).alias("n_missing"))


def review_assessments(assessments: DataFrame, providers: DataFrame, responses: DataFrame, tracks: DataFrame, primary: str, panel: int = 18, key: str = "id") -> DataFrame:
    """X-06: (key, check, passed) of each assessment: the primary provider answered, its panel is complete, an unavailable response leaves no combined rank, and every track is as long as the sequence (only where there are tracks).

    assessments: (key, sequence, combined_rank); providers: (key, provider, status, n_alleles); responses:
    (key, status); tracks: (key, n_values).
    """
    own = providers.where(F.col("provider") == primary).groupBy(key).agg(F.max(F.col("status") == "ok").alias("__ok"), F.max(F.col("n_alleles") == panel).alias("__panel"))
    gone = responses.groupBy(key).agg(F.max(F.col("status") == "unavailable").alias("__gone"))
    spans = tracks.groupBy(key).agg(F.min("n_values").alias("__lo"), F.max("n_values").alias("__hi"))
    met = assessments.join(own.hint("merge"), key, "left").join(gone.hint("merge"), key, "left").join(spans.hint("merge"), key, "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    length = F.char_length(F.coalesce("sequence", F.lit("")))
    checks = {
        "primary_ok": no(F.col("__ok")),
        "panel_complete": no(F.col("__panel")),
        "unavailable_has_no_rank": ~no(F.col("__gone")) | F.col("combined_rank").isNull(),
        "tracks_aligned": F.when(F.col("__lo").isNotNull(), (F.col("__lo") == length) & (F.col("__hi") == length)),
    }
    each = F.array(*[F.struct(F.lit(name).alias("check"), ok.alias("passed")) for name, ok in checks.items()])
    return met.select(key, F.explode(each).alias("x")).select(key, "x.*").where("passed is not null")


def review_campaigns(campaigns: DataFrame, candidates: DataFrame, assessed: DataFrame, key: str = "campaign") -> DataFrame:
    """X-06: (key, check, passed) of each campaign: only candidates that passed every gate were screened, screened counts agree with the assessments, and every candidate keeps its checks.

    campaigns: (key, n_screened, null if not recorded); candidates: (key, screening, validation, n_checks); assessed: (key).
    """
    screened = F.col("screening") == "screened"
    of = candidates.groupBy(key).agg(F.count_if(screened).alias("__n"), F.count_if(screened & (F.coalesce("validation", F.lit("")) != "pass")).alias("__wrong"), F.count_if(F.coalesce("n_checks", F.lit(0)) == 0).alias("__bare"), F.count(F.lit(1)).alias("__all"))
    done = assessed.groupBy(key).agg(F.count(F.lit(1)).alias("__done"))
    met = campaigns.join(of.hint("merge"), key, "left").join(done.hint("merge"), key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    checks = {
        "structural_gate_enforced": n("__wrong") == 0,
        "counts_reconcile": F.coalesce("n_screened", n("__n")) == n("__done"),
        "checks_recorded": F.when(n("__all") > 0, n("__bare") == 0),
    }
    each = F.array(*[F.struct(F.lit(name).alias("check"), ok.alias("passed")) for name, ok in checks.items()])
    return met.select(key, F.explode(each).alias("x")).select(key, "x.*").where("passed is not null")


def file_integrity(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """S-17: (path, recorded, found, status) of every path: ok, mismatch, missing or unlisted; a listed path without a recorded hash is a mismatch."""
    a = actual.select("path", F.col("sha256").alias("found"), F.lit(True).alias("__a"))
    m = manifest.select("path", F.col("sha256").alias("recorded"), F.lit(True).alias("__m"))
    met = m.join(a.hint("merge"), "path", "full")
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__m").isNull(), "unlisted").when(F.col("recorded").eqNullSafe(F.col("found")) & F.col("found").isNotNull(), "ok").otherwise("mismatch")
    return met.select("path", "recorded", "found", status.alias("status"))
