"""Lines of any length are judged by their sites."""

import duckdb

import corpus_pipeline
from windloom.llm import line_dedup, queries


def brute_lines(rows):
    """(doc_id, text) with every spread line left in its first document alone."""
    sites, first = {}, {}
    for d, t, s in rows:
        for line in {x.strip(line_dedup.BLANKS) for x in t.split("\n")} - {""}:
            sites.setdefault(line, set()).add(s)
            first[line] = min(d, first.get(line, d))
    gone = lambda d, x: x != "" and len(sites[x]) >= line_dedup.MIN_SITES and first[x] != d
    return {d: "\n".join(x for x in t.split("\n") if not gone(d, x.strip(line_dedup.BLANKS))) for d, t, _ in rows}


ROWS = [(i, f"own line {i}\n\n Les.\n}}\n" + ("rare\n" if i < 4 else "") + f"tail {i}", f"site{i % 9}") for i in range(30)]


def test_pipeline_stage_judges_short_lines(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == brute_lines(ROWS)
    assert sum("Les." in t for t in got.values()) == 1 and sum("rare" in t for t in got.values()) == 4


def test_op2_equals_sql_and_brute_force(spark, data):
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in queries.op2_line_dedup(spark, data).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    assert got == {d: (n, t) for d, n, t in con.execute(queries.ORACLES["op2_line_dedup"]).fetchall()}
    rows = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    assert {d: t for d, (_, t) in got.items()} == brute_lines(rows)
