"""How the driver's star schema stands for the relations of a code-and-history store.

orders are commits, lineitem the files that a commit touches, part the files, supplier -> part the call edges, region
and nation the containers. Each frame has its SQL twin, used as a CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.plans.registry import Tables

COMMITS_SQL = "commits AS (SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS authored_at, o_orderpriority AS subject, o_totalprice AS price FROM orders)"
COMMIT_FILES_SQL = "commit_files AS (SELECT l_orderkey AS sha, l_partkey AS path, l_quantity AS insertions FROM lineitem)"
EDGES_SQL = "edges AS (SELECT l_suppkey AS src, 'calls' AS kind, l_partkey AS dst, l_quantity AS weight, 1 - l_discount AS confidence, l_returnflag AS via, l_linenumber AS line, l_orderkey AS site FROM lineitem)"
#: Later line of an order depends on the line before it; a sparse directed graph over parts.
DEPENDS_SQL = """steps AS (SELECT l_partkey AS dst, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS src, 1 - l_discount AS confidence FROM lineitem),
depends AS (SELECT src, dst, count(*) AS weight, max(confidence) AS confidence FROM steps WHERE src IS NOT NULL AND src <> dst AND confidence >= 0.985 GROUP BY src, dst)"""
#: The same with every step, whatever its confidence, as the reference's closure follows every edge.
ALL_DEPENDS_SQL = DEPENDS_SQL.replace(" AND confidence >= 0.985", "")
NODES_SQL = """nodes AS (SELECT 'region' AS kind, r_regionkey AS key, r_name AS label FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part)"""


def commits(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("authored_at"), F.col("o_orderpriority").alias("subject"), F.col("o_totalprice").alias("price"))


def commit_files(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("l_quantity").alias("insertions"))


def edges(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(c("l_suppkey").alias("src"), F.lit("calls").alias("kind"), c("l_partkey").alias("dst"), c("l_quantity").alias("weight"), (1 - c("l_discount")).alias("confidence"), c("l_returnflag").alias("via"), c("l_linenumber").alias("line"), c("l_orderkey").alias("site"))


def depends(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    steps = t.lineitem.select(F.col("l_partkey").alias("dst"), F.lead("l_partkey").over(w).alias("src"), (1 - F.col("l_discount")).alias("confidence"))
    good = steps.filter("src is not null and src <> dst")
    if t.floor is not None:
        good = good.filter(F.col("confidence") >= t.floor)
    return good.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.max("confidence").alias("confidence"))


def nodes(t: Tables) -> DataFrame:
    parts = (("region", t.region, "r_regionkey", "r_name"), ("nation", t.nation, "n_nationkey", "n_name"), ("supplier", t.supplier, "s_suppkey", "s_name"), ("customer", t.customer, "c_custkey", "c_name"), ("part", t.part, "p_partkey", "p_name"))
    out = None
    for kind, df, key, label in parts:
        one = df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out
