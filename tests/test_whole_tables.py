"""The queries over all customers and rows of lineitem against loops."""

import pandas as pd

from larder.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_whole_tables(spark):
    cu, o, li, s, p, n = (pd.read_parquet(f"{DIR}/{x}.parquet") for x in "customer orders lineitem supplier part nation".split())
    got = {x: {tuple(r) for r in catalog.queries()[x](spark, DIR).collect()} for x in "q1_pricing q2_pricing_gaps wn3_preferred_store st7_dedupe_key jn6_gaps".split()}
    home, lives, brand = dict(zip(s.s_suppkey, s.s_nationkey)), dict(zip(cu.c_custkey, cu.c_nationkey)), dict(zip(p.p_partkey, p.p_brand))
    offers = {(home[k], x) for k, x in zip(li.l_suppkey, li.l_partkey)}
    buyer = dict(zip(o.o_orderkey[o.o_orderstatus == "O"], o.o_custkey[o.o_orderstatus == "O"]))
    need = {(buyer[k], x) for k, x in zip(li.l_orderkey, li.l_partkey) if k in buyer}
    assert got["q2_pricing_gaps"] == {(u, x) for u, x in need if (lives[u], x) not in offers}
    assert {r[:3] for r in got["q1_pricing"]} == {(g, x, b) for g, b in set(zip(cu.c_mktsegment, cu.c_nationkey)) for nation, x in offers if nation == b}
    assert {r[:2] for r in got["wn3_preferred_store"]} == {(b, x) for b in set(cu.c_nationkey) for x in set(li.l_partkey)}
    assert all(home[k] == b for b, x, k in got["wn3_preferred_store"] if (b, x) in offers)
    assert got["st7_dedupe_key"] == {(f"{a}|{b}|{round(e * 100)}" if a else None,) for a, b, e in zip(li.l_suppkey, li.l_partkey, li.l_extendedprice)}
    assert got["jn6_gaps"] == {(a, b) for a in n.n_nationkey for b in set(p.p_brand)} - {(a, brand[x]) for a, x in offers}
