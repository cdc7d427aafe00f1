"""The novelty split takes the orders of every customer."""

from windloom.plans.catalogue import QUERIES


def test_every_customer_gets_a_split(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey", "o_orderpriority").collect()
    want = {}
    for c, p in orders:
        want[c] = max(want.get(c, 0), int(p[0]) - 1)
    got = {r["component"]: (r["priority"], r["split"]) for r in QUERIES["novelty_split_all"](spark, data).collect()}
    assert got == {c: (p, ["exclude", "train", "train", "val", "test"][p]) for c, p in want.items()}
    assert len({p for p, _ in got.values()}) > 1
