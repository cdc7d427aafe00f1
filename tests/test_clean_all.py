"""P-03 on the inputs it exists for: header lines, odd characters, null texts."""

import hashlib
import re

from windloom.plans.catalogue import QUERIES


def test_headers_and_odd_characters_are_deleted(spark, tmp_path):
    docs = [(1, ">id one\nMKX a"), (2, "AC\n> quoted ACD\nDÄ-e\n>"), (3, None), (4, ""), (5, "plain > text é")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["digest"] for r in QUERIES["clean_delete"](spark, str(tmp_path)).collect()}
    clean = lambda t: re.sub("[^ACDEFGHIKLMNPQRSTVWY]", "", re.sub(r"(?m)^>.*$", "", t).upper())
    assert got == {d: None if t is None else hashlib.sha256(clean(t).encode()).hexdigest() for d, t in docs}
