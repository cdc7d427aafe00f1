"""Queries against their SQL on rows that ordinary tables hold seldom: ties, cutoffs met exactly, short texts, keys without partners."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tests.test_catalogue import rows
from windloom.plans.catalogue import ORACLES, QUERIES


def check(spark, folder, name, **tables):
    c = duckdb.connect()
    for t, made in tables.items():
        pq.write_table(pa.Table.from_pylist(made), f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), c.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def item(order, line, **values):
    return {"l_orderkey": order, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": pa.scalar(line, pa.int32()).as_py(), "l_quantity": 20.0, "l_extendedprice": 1000.0, "l_discount": 0.04, "l_tax": 0.04, "l_returnflag": "R", "l_linestatus": "O", "l_shipdate": datetime.datetime(2020, 1, 1)} | values


def test_equal_objectives_go_by_line_and_risk(spark, tmp_path):
    lines = [item(1, 7, l_quantity=19.0, l_discount=0.02, l_tax=0.06), item(1, 7, l_quantity=16.0, l_discount=0.06, l_tax=0.02), item(2, 3, l_quantity=27.0, l_discount=0.01, l_tax=0.0), item(2, 3, l_quantity=27.0, l_discount=0.0, l_tax=0.04)]
    got = check(spark, tmp_path, "candidate_acceptance", lineitem=lines)
    assert dict(zip(got.l_orderkey, got.risk)) == {1: 0.02, 2: 0.0}


def test_means_on_a_cutoff(spark, tmp_path):
    lines = [item(o, i, l_tax=t) for o, taxes in enumerate([(0.04, 0.07, 0.05, 0.0), (0.06, 0.02, 0.07, 0.01), (0.0, 0.05, 0.07, 0.04), (0.01, 0.07, 0.02, 0.06)]) for i, t in enumerate(taxes)]
    got = check(spark, tmp_path, "factor_risk", lineitem=lines)
    assert set(got.disorder_points) == {0}


def test_a_turn_without_hits_has_no_support(spark, tmp_path):
    got = check(spark, tmp_path, "interval_overlap", conversations=[{"conv_id": 1, "turn": 0, "role": "user", "text": "ACDEFGHI"}, {"conv_id": 2, "turn": 0, "role": "user", "text": "ACDEFGHIKLMNPQRSTVWY"}])
    assert got[got.parent == 1000].support.isna().all() and got[got.parent == 2000].support.notna().all()


def test_scores_between_two_thousandths_round_up(spark, tmp_path):
    got = check(spark, tmp_path, "selective_curve", lineitem=[item(1, 1, l_extendedprice=55165.0), item(2, 1, l_extendedprice=55164.99, l_returnflag="N"), item(3, 1, l_extendedprice=110000.0)])
    assert sorted(got.threshold) == [0.501, 0.502, 1.0]


def test_customers_whose_orders_have_no_lines(spark, tmp_path):
    customers = [{"c_custkey": k} for k in (1, 2, 3)]
    orders = [{"o_orderkey": 10 * k, "o_custkey": k} for k in (1, 2, 9)]
    lines = [item(10, 1), item(10, 2, l_returnflag="N"), item(90, 1)]
    got = check(spark, tmp_path, "shared_sets", customer=customers, orders=orders, lineitem=lines)
    assert dict(zip(got.c_custkey, got.shared)) == {1: "part-1", 2: ""}


def test_documents_without_an_id_are_no_parents(spark, tmp_path):
    doc = lambda i, text: {"doc_id": i, "text": text, "lang": "en", "source": "a"}
    got = check(spark, tmp_path, "corpus_collapse", documents=[doc(1, "ACDEFGHIKL"), doc(1, "CDEFGHIKLM"), doc(None, "DEFGHIKLMN"), doc(None, "PPPPPPPPPP"), doc(2, None), doc(3, "ACDEFGHIK")])
    assert dict(zip(got.parent_count, got.occurrences)) == {0: 3, 1: 4, 2: 2}
