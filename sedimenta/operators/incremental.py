"""Incremental maintenance: multiset differences by hash, upserts, guarded deletes, map merges, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.plans.registry import query

c = F.col


def multiset_diff(old: DataFrame, new: DataFrame, key: str, id_col: str) -> DataFrame:
    """(hash, old_id, new_id, state): equal hashes are matched one to one in order of id; state is reused, stale or fresh."""
    w = Window.partitionBy("hash").orderBy(id_col)
    side = lambda df, name: df.select(c(key).alias("hash"), id_col).withColumn("rn", F.row_number().over(w)).withColumnRenamed(id_col, name)
    j = side(old, "old_id").join(side(new, "new_id"), ["hash", "rn"], "full_outer")
    state = F.when(c("old_id").isNull(), "fresh").when(c("new_id").isNull(), "stale").otherwise("reused")
    return j.select("hash", "old_id", "new_id", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of old with `update` columns from the new row of their key, and the rows that are new."""
    fresh = new.select(*keys, *[c(x).alias(f"__{x}") for x in update], F.lit(True).alias("__hit"))
    cols = [F.when(c("__hit"), c(f"__{x}")).otherwise(c(x)).alias(x) if x in update else c(x) for x in old.columns]
    return old.join(fresh, keys, "left").select(*cols).unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Overwrites only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


_SNAP = """o AS (SELECT doc_id, sha1(text) AS h, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM (SELECT doc_id, sha1(CASE WHEN lang = 'en' THEN text || '!' ELSE text END) AS h FROM documents))"""


@query("k10_multiset_diff", f"WITH {_SNAP} SELECT coalesce(o.h, n.h) AS hash, o.doc_id AS old_id, n.doc_id AS new_id, CASE WHEN o.doc_id IS NULL THEN 'fresh' WHEN n.doc_id IS NULL THEN 'stale' ELSE 'reused' END AS state FROM o FULL JOIN n ON o.h = n.h AND o.rn = n.rn")
def k10(t):
    new = F.when(c("lang") == "en", F.concat("text", F.lit("!"))).otherwise(c("text"))
    return multiset_diff(t.documents.select("doc_id", F.sha1("text").alias("h")), t.documents.select("doc_id", F.sha1(new).alias("h")), "h", "doc_id")


@query("u07_diff_counts", f"WITH {_SNAP}, x AS (SELECT CASE WHEN o.doc_id IS NULL THEN 'fresh' WHEN n.doc_id IS NULL THEN 'stale' ELSE 'reused' END AS state FROM o FULL JOIN n ON o.h = n.h AND o.rn = n.rn) SELECT state, count(*) AS n FROM x GROUP BY 1")
def u07(t):
    return k10(t).groupBy("state").agg(F.count("*").alias("n"))


@query("k03_upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'merged' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR o_orderpriority = '1-URGENT'")
def k03(t):
    """The store has the older orders; the urgent ones of all years arrive with a new state."""
    cols = ("o_orderkey", "o_custkey", "o_orderstatus")
    new = t.orders.filter("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("merged")).select(*cols)
    return upsert(t.orders.filter("o_orderdate < timestamp '1997-01-01'").select(*cols), new, ["o_orderkey"], ["o_orderstatus"])


@query("k07_delete_not_in", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def k07(t):
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id")


@query("k08_keyed_update", "SELECT c_custkey, coalesce(n, c_nationkey) AS v FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def k08(t):
    n = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", F.coalesce("n", c("c_nationkey").cast("long")).alias("v"))


@query("k12_json_merge", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events""")
def k12(t):
    """A map merge in which the right side wins."""
    old = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("n"), F.lit("0")))
    new = F.map_filter(old, lambda k, _: k != "kind")
    merged = F.map_concat(new, F.create_map(F.lit("kind"), c("event_type")))
    return t.events.select("event_id", merged["k"].cast("long").alias("k"), merged["kind"].alias("kind"))


@query("k13_insert_if_absent", "SELECT p_partkey FROM part WHERE p_size > 25 UNION SELECT l_partkey FROM lineitem WHERE l_quantity < 10")
def k13(t):
    return insert_absent(t.part.filter("p_size > 25").select("p_partkey"), t.lineitem.filter("l_quantity < 10").select(c("l_partkey").alias("p_partkey")).distinct(), ["p_partkey"])


@query("k14_guarded_delete", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def k14(t):
    gone = t.supplier.filter("s_acctbal < 0").join(t.lineitem.filter("l_quantity >= 50"), c("l_suppkey") == c("s_suppkey"), "left_anti")
    return t.supplier.join(gone.select("s_suppkey"), "s_suppkey", "left_anti").select("s_suppkey")


@query("k15_append_position", "SELECT conv_id, max(turn) + 1 AS position FROM conversations GROUP BY 1")
def k15(t):
    return t.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("position"))


@query("k20_expiry_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 190)")
def k20(t):
    cut = t.events.filter("event_type = 'error' and value > 190").select("user_id")
    return t.events.filter("ts >= timestamp '2024-01-15'").join(cut, "user_id", "left_anti").select("event_id")


@query("y03_link_building", r"""WITH s AS (SELECT o_orderkey AS sha, 'Merge pull request #' || o_custkey || ' fixes #' || (o_orderkey % 97) AS s FROM orders) SELECT DISTINCT 'commit' AS src_type, sha AS src_key, CASE WHEN c_custkey IS NULL THEN 'issue' ELSE 'pull_request' END AS dst_type, n AS dst_key, kind
FROM (SELECT sha, CAST(regexp_extract(s, '^Merge pull request #(\d+)', 1) AS BIGINT) AS n, 'merged_in' AS kind FROM s UNION ALL SELECT sha, CAST(regexp_extract(s, 'fixes #(\d+)', 1) AS BIGINT), 'fixes' FROM s) LEFT JOIN customer ON c_custkey = n AND c_custkey % 2 = 0""")
def y03(t):
    from sedimenta.functions import text as X

    s = t.orders.select(c("o_orderkey").alias("sha"), F.concat(F.lit("Merge pull request #"), c("o_custkey").cast("string"), F.lit(" fixes #"), (c("o_orderkey") % 97).cast("string")).alias("s"))
    merged = s.select("sha", X.pr_number(c("s")).alias("n"), F.lit("merged_in").alias("kind"))
    fixed = s.select("sha", F.explode(X.fixes(c("s"))).alias("n"), F.lit("fixes").alias("kind"))
    known = t.customer.filter("c_custkey % 2 = 0").select("c_custkey")
    j = merged.unionByName(fixed).join(known, c("c_custkey") == c("n"), "left")
    return j.select(F.lit("commit").alias("src_type"), c("sha").alias("src_key"), F.when(c("c_custkey").isNull(), "issue").otherwise("pull_request").alias("dst_type"), c("n").cast("long").alias("dst_key"), "kind").dropDuplicates()
