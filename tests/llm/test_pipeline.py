"""The pipeline: stage contracts, and its result against a brute-force run of the rules."""

import pytest

import corpus_pipeline
from tests.llm.test_near_stage import brute_kept
from tests.llm.test_operators import brute_contamination


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, data).cache()
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns


def test_each_stage_against_brute_force(spark, data, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    by = {name: ([tuple(r) for r in before.select("doc_id", "text").collect()], after) for name, before, after in stages}
    before, after = by["line_dedup"]
    assert after.count() == len(before)
    before, after = by["near_dedup"]
    want = brute_kept(before, [(5, 80)])
    assert {r["doc_id"] for r in after.collect()} == want != brute_kept(before, [(3, 85)])
    before, after = by["decontamination"]
    few = [(d, t) for d, t in before]
    keep = set()
    for d, t in few:
        n, hit, _ = brute_contamination(t, items)
        if not (hit > 0 and 20 * hit >= n):
            keep.add(d)
    assert {r["doc_id"] for r in after.collect()} == keep
    before, after = by["packing"]
    total = {}
    for r in after.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_words"]
    assert total == {d: len((t or "").encode().split()) for d, t in before}


def test_odd_rows_pass_all_stages(spark, data, tmp_path):
    """Null and repeated ids, null texts and clashing columns; and an empty table."""
    import shutil

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    odd = docs.limit(3).unionByName(docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")).unionByName(docs.limit(1).selectExpr("cast(7777 as bigint) as doc_id", "cast(null as string) as text", "lang", "cast(null as string) as source", "cast(null as bigint) as n_chars"))
    for name, rows in (("odd", docs.unionByName(odd)), ("empty", docs.limit(0))):
        folder = tmp_path / name
        folder.mkdir()
        rows.selectExpr("*", "1 as component_id", "2 as kept", "3 as toxicity", "4 as contamination", "5 as part").write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            shutil.copy(f"{data}/{t}.parquet", folder / f"{t}.parquet")
        found = corpus_pipeline.run(spark, str(folder))
        assert (found.count() > 0) == (name == "odd")
