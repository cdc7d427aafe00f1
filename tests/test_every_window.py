"""The first window of a document counts: queries over every window on a small fixture."""

import pytest

from windloom.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("windows"))
    docs = [(1, "ACDEFGHIK", "en", "a"), (2, "ACDEFGHIKL", "en", "b"), (3, "MNPQRSTVWYA", "de", "a"), (4, "ACD", "de", "c")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, "ACDEFGHIK"), (8, "MNPQRSTVWW")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_first_windows_count(spark, small):
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, small).collect())
    assert rows("corpus_collapse") == [(1, 4, 4), (2, 1, 2)]  # 1 + 2 + 3 windows
    assert rows("anti_new") == [(8, 1)]
    assert rows("exact_membership") == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    assert [r[:5] for r in rows("masked_key_counts")] == [(7, 1, 2, 2, 1), (8, 2, 2, 1, 2)]
