"""Each query of the library against its SQL in DuckDB, on the driver's smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from sedimenta import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    try:
        x = float(v)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows, "the query has no rows here"
    if name not in catalog.SQL:
        return
    cur = con.execute(catalog.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = Counter(tuple(plain(r[c]) for c in order) for r in rows)
    want = Counter(tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])


def test_overlap_dedup_against_plain_greedy(spark, con):
    """r14 has no SQL: a greedy choice, written out."""
    from sedimenta import catalog as cat

    hits: dict = {}
    for q, path, k, score in con.execute("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders").fetchall():
        start = k % 200
        hits.setdefault(q, []).append((-score, path, start, start + 10 + k % 23))
    want = set()
    for q, rows in hits.items():
        kept: list = []
        for _, path, a, b in sorted(rows):
            clash = any(p == path and min(b, e) - max(a, s) + 1 > 0.6 * min(b - a + 1, e - s + 1) for p, s, e in kept)
            if len(kept) < 12 and not clash:
                kept.append((path, a, b))
        want |= {(q, i, *x) for i, x in enumerate(kept)}
    assert {tuple(r) for r in cat.QUERIES["r14_overlap_dedup"](spark, SF).collect()} == want
