"""The queries over every step of confidence, against plain Python."""

import pyarrow.parquet as pq

from sedimenta import catalog
from sedimenta.operators import whole

SF = "/root/testdata/sf0.001"


def steps():
    """{(src, dst): confidence} of all steps."""
    orders: dict = {}
    for r in pq.read_table(f"{SF}/lineitem.parquet").to_pylist():
        orders.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_quantity"], r["l_extendedprice"], 1 - r["l_discount"]))
    out: dict = {}
    for rows in orders.values():
        rows.sort()
        for x, y in zip(rows, rows[1:], strict=False):
            if x[1] != y[1]:
                out[y[1], x[1]] = max(out.get((y[1], x[1]), 0), x[5])
    return out


def test_no_query_has_a_floor():
    for name in whole.NAMES:
        assert "0.985" in catalog.SQL[name] and "0.985" not in catalog.SQL[f"{name}_all"]


def test_closure_follows_every_step(spark):
    edges = steps()
    assert min(edges.values()) < 0.985
    reached, level = {1: (0, 1.0, None)}, {1: 1.0}
    for depth in (1, 2, 3):
        found: dict = {}
        for (src, dst), conf in edges.items():
            if dst in level and src not in reached:
                new = (conf * level[dst], -dst)
                found[src] = max(found.get(src, new), new)
        reached |= {n: (depth, c, -through) for n, (c, through) in found.items()}
        level = {n: c for n, (c, _) in found.items()}
    del reached[1]
    got = {r.node: (r.depth, r.confidence, r.through) for r in catalog.QUERIES["g07_impact_closure_all"](spark, SF).collect()}
    assert got == reached
    assert len(got) > catalog.QUERIES["g07_impact_closure"](spark, SF).count()
