"""Property-graph operators over vertex and edge frames: neighbours, closure, roll-up, search, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.plans.projection import DEPENDS_SQL, EDGES_SQL, NODES_SQL, depends, edges, nodes
from sedimenta.plans.registry import query


def merge_edges(e: DataFrame, lines: int = 8) -> DataFrame:
    """One edge for each (src, kind, dst): weights add up, the best confidence wins with its via (least site on ties), and
    the first distinct lines stay, sorted."""
    best = F.max_by("via", F.struct(F.col("confidence"), -F.col("site"), -F.col("line"), F.col("via")))
    return e.groupBy("src", "kind", "dst").agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), best.alias("via"), F.slice(F.array_sort(F.collect_set("line")), 1, lines).alias("lines"))


def neighbors(e: DataFrame, ids: list, reverse: bool = False, kinds: list[str] | None = None, exclude: list = ()) -> DataFrame:
    """Far ends of the edges of some nodes: (far, weight, confidence, via, anchor), best edge's via and anchor."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    own = e.filter(F.col(near).isin(ids))
    if kinds:
        own = own.filter(F.col("kind").isin(kinds))
    if exclude:
        own = own.filter(~F.col(far).isin(list(exclude)))
    rank = F.struct(F.col("confidence"), -F.col("site"), -F.col("line"), F.col("via"))
    return own.groupBy(F.col(far).alias("far")).agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max_by("via", rank).alias("via"), F.max_by(near, rank).alias("anchor"))


def impact(e: DataFrame, targets: list, hops: int = 3, cap: int = 400) -> DataFrame:
    """Reverse closure of (src, dst, confidence): (node, depth, confidence, through). A node stays at its first depth with the
    greatest product of confidences (least through on ties). No further level once `cap` nodes are reached."""
    spark = e.sparkSession
    e = e.repartition("dst").persist()  # each hop reads the edges where its join wants them
    level = spark.createDataFrame([(x, 0, 1.0) for x in targets], "node long, depth int, confidence double").withColumn("through", F.lit(None).cast("long"))
    reached = level
    for depth in range(1, hops + 1):
        step = e.join(level.select(F.col("node").alias("dst"), F.col("confidence").alias("before")), "dst")
        step = step.select(F.col("src").alias("node"), F.col("dst").alias("through"), (F.col("confidence") * F.col("before")).alias("c"))
        best = F.struct(F.col("c"), -F.col("through"))
        level = step.join(reached, "node", "left_anti").groupBy("node").agg(F.lit(depth).alias("depth"), F.max("c").alias("confidence"), F.max_by("through", best).alias("through"))
        level = level.persist()
        reached = reached.unionByName(level)
        if depth < hops and reached.limit(cap).count() >= cap:
            break
    return reached.filter("depth > 0")


def risk(direct: Column, transitive: Column, files: Column, tests: Column, together: Column, ratio: Column, churn: Column) -> Column:
    """Risk points of a change: breadth, missing tests, strong co-change and churn."""
    p = F.when(direct >= 10, 3).when(direct >= 3, 2).when(direct >= 1, 1).otherwise(0)
    p = p + F.when(files >= 8, 2).when(files >= 3, 1).otherwise(0)
    p = p + F.when((tests == 0) & (transitive > 0), 2).otherwise(0)
    p = p + F.when((ratio >= 0.4) & (together >= 3), 1).otherwise(0)
    return p + F.when(F.coalesce(churn, F.lit(0)) >= 50, 1).otherwise(0)


def risk_reasons(direct: Column, transitive: Column, files: Column, tests: Column, together: Column, ratio: Column, partner: Column, churn: Column) -> Column:
    """What each of the points of risk() was given for; partner is the path that changes together most."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = [
        F.when(direct >= 3, text(direct, " direct callers or importers")).when(direct >= 1, text(direct, " direct caller", F.when(direct > 1, "s").otherwise(""))),
        F.when(files >= 3, text("reaches code in ", files, " other files")),
        F.when((tests == 0) & (transitive > 0), F.lit("no test code reaches it in the static call graph")),
        F.when((ratio >= 0.4) & (together >= 3), text("usually changes together with ", partner, " (", F.floor(ratio * 100), "% of its commits)")),
        F.when(F.coalesce(churn, F.lit(0)) >= 50, text("its file changed in ", churn, " commits")),
    ]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def risk_level(points: Column) -> Column:
    return F.when(points >= 5, "high").when(points >= 2, "medium").otherwise("low")


def scope(contains: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes under `start` by at most `depth` contains edges, itself included."""
    levels = [start.select("node")]
    for _ in range(depth):
        levels.append(contains.join(levels[-1].withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")))
    return reduce(DataFrame.unionByName, levels).distinct()


_BEST = "ORDER BY confidence DESC, site, line, via DESC"


@query("g04_neighbors", f"""WITH {EDGES_SQL} SELECT dst AS part, p_name AS label, p_size % 10 = 0 AS is_test, sum(weight) AS weight, max(confidence) AS confidence, (array_agg(via {_BEST}))[1] AS via
FROM edges JOIN part ON p_partkey = dst WHERE src IN (1, 2, 3) GROUP BY 1, 2, 3 ORDER BY is_test, confidence DESC, weight DESC, part LIMIT 40""")
def g04(t):
    n = neighbors(edges(t), [1, 2, 3]).join(t.part, F.col("far") == F.col("p_partkey"))
    out = n.select(F.col("far").alias("part"), F.col("p_name").alias("label"), (F.col("p_size") % 10 == 0).alias("is_test"), "weight", "confidence", "via")
    return out.orderBy("is_test", F.desc("confidence"), F.desc("weight"), "part").limit(40)


@query("a09_edge_merge", f"""WITH {EDGES_SQL} SELECT src, kind, dst, sum(weight) AS weight, max(confidence) AS confidence, (array_agg(via {_BEST}))[1] AS via,
array_to_string(list_slice(list_sort(list_distinct(array_agg(line))), 1, 3), ',') AS lines FROM edges GROUP BY src, kind, dst""")
def a09(t):
    return merge_edges(edges(t), 3).withColumn("lines", F.array_join("lines", ","))


_IMPACT_SQL = f"""WITH {DEPENDS_SQL},
l1 AS (SELECT src AS node, 1 AS depth, max(confidence * 1.0::DOUBLE) AS confidence, min(dst) AS through FROM depends WHERE dst = 1 AND src <> 1 GROUP BY src),
s2 AS (SELECT src AS node, depends.dst AS through, depends.confidence * l1.confidence AS c FROM depends JOIN l1 ON depends.dst = l1.node WHERE src <> 1 AND src NOT IN (SELECT node FROM l1)),
l2 AS (SELECT node, 2 AS depth, max(c) AS confidence, (array_agg(through ORDER BY c DESC, through))[1] AS through FROM s2 GROUP BY node),
s3 AS (SELECT src AS node, depends.dst AS through, depends.confidence * l2.confidence AS c FROM depends JOIN l2 ON depends.dst = l2.node WHERE src <> 1 AND src NOT IN (SELECT node FROM l1) AND src NOT IN (SELECT node FROM l2)),
l3 AS (SELECT node, 3 AS depth, max(c) AS confidence, (array_agg(through ORDER BY c DESC, through))[1] AS through FROM s3 GROUP BY node),
reached AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


@query("g07_impact_closure", f"{_IMPACT_SQL} SELECT * FROM reached")
def g07(t):
    return impact(depends(t).select("src", "dst", "confidence"), [1], cap=10**9)


_SUMMARY_SQL = """SELECT count(*) FILTER (WHERE depth = 1 AND p_size % 10 <> 0) AS direct, count(*) FILTER (WHERE p_size % 10 <> 0) AS transitive,
count(DISTINCT CASE WHEN p_size % 10 <> 0 AND p_brand <> (SELECT p_brand FROM part WHERE p_partkey = 1) THEN p_brand END) AS files,
count(*) FILTER (WHERE p_size % 10 = 0) AS tests, count(DISTINCT CASE WHEN p_size % 10 = 0 THEN p_brand END) AS test_files FROM reached JOIN part ON p_partkey = node"""


def impact_summary(dependents: DataFrame, own_path: DataFrame) -> DataFrame:
    """One row of counts over dependents (path, is_test, depth): direct and all non-test dependents, their files other than the
    target's own (own_path: one row, own), test dependents and their files."""
    d = dependents.crossJoin(F.broadcast(own_path))  # one row
    code = ~F.col("is_test")
    return d.agg(F.count_if(code & (F.col("depth") == 1)).alias("direct"), F.count_if(code).alias("transitive"), F.countDistinct(F.when(code & (F.col("path") != F.col("own")), F.col("path"))).alias("files"), F.count_if("is_test").alias("tests"), F.countDistinct(F.when(F.col("is_test"), F.col("path"))).alias("test_files"))


def _summary(t):
    r = impact(depends(t).select("src", "dst", "confidence"), [1], cap=10**9).join(t.part, F.col("node") == F.col("p_partkey"))
    r = r.select(F.col("p_brand").alias("path"), (F.col("p_size") % 10 == 0).alias("is_test"), "depth")
    return impact_summary(r, t.part.filter("p_partkey = 1").select(F.col("p_brand").alias("own")))


@query("a14_impact_summary", f"{_IMPACT_SQL} {_SUMMARY_SQL}")
def a14(t):
    return _summary(t)


@query("g08_impact_report", f"""{_IMPACT_SQL}, s AS ({_SUMMARY_SQL}), f AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem),
m AS (SELECT sha FROM f WHERE path = 1), k AS (SELECT count(*) AS churn FROM m),
o AS (SELECT path, count(*) AS together FROM f SEMI JOIN m USING (sha) WHERE path <> 1 GROUP BY path ORDER BY together DESC, path LIMIT 1),
x AS (SELECT s.*, churn, coalesce(together, 0) AS together, coalesce(round(together / churn, 2), 0) AS ratio, o.path AS partner FROM s, k LEFT JOIN o ON true),
p AS (SELECT *, (CASE WHEN direct >= 10 THEN 3 WHEN direct >= 3 THEN 2 WHEN direct >= 1 THEN 1 ELSE 0 END) + (CASE WHEN files >= 8 THEN 2 WHEN files >= 3 THEN 1 ELSE 0 END) + (CASE WHEN tests = 0 AND transitive > 0 THEN 2 ELSE 0 END)
 + (CASE WHEN ratio >= 0.4 AND together >= 3 THEN 1 ELSE 0 END) + (CASE WHEN churn >= 50 THEN 1 ELSE 0 END) AS points FROM x)
SELECT direct, transitive, files, tests, churn, points, CASE WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level,
array_to_string(list_filter([CASE WHEN direct >= 3 THEN direct || ' direct callers or importers' WHEN direct >= 1 THEN direct || ' direct caller' || CASE WHEN direct > 1 THEN 's' ELSE '' END END,
CASE WHEN files >= 3 THEN 'reaches code in ' || files || ' other files' END, CASE WHEN tests = 0 AND transitive > 0 THEN 'no test code reaches it in the static call graph' END,
CASE WHEN ratio >= 0.4 AND together >= 3 THEN 'usually changes together with ' || partner || ' (' || CAST(floor(ratio * 100) AS BIGINT) || '% of its commits)' END,
CASE WHEN churn >= 50 THEN 'its file changed in ' || churn || ' commits' END], lambda r: r IS NOT NULL), '; ') AS reasons FROM p""")
def g08(t):
    f = t.lineitem.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).distinct()
    mine = f.filter("path = 1").select("sha")
    other = f.filter("path <> 1").join(mine, "sha", "left_semi").groupBy("path").agg(F.count("*").alias("together")).orderBy(F.desc("together"), "path").limit(1)
    one = _summary(t).crossJoin(mine.agg(F.count("*").alias("churn"))).join(other.select(F.col("path").alias("partner"), "together"), F.lit(True), "left")  # one row each
    x = one.withColumns({"together": F.coalesce("together", F.lit(0)), "ratio": F.coalesce(F.round(F.col("together") / F.col("churn"), 2), F.lit(0.0))})
    cols = [F.col(k) for k in ("direct", "transitive", "files", "tests", "together", "ratio")]
    points = risk(*cols, F.col("churn"))
    return x.select("direct", "transitive", "files", "tests", "churn", points.alias("points"), risk_level(points).alias("level"), F.array_join(risk_reasons(*cols, F.col("partner"), F.col("churn")), "; ").alias("reasons"))


@query("a15_dependents_by_file", f"{_IMPACT_SQL} SELECT p_brand AS path, count(*) AS symbols, min(depth) AS depth FROM reached JOIN part ON p_partkey = node GROUP BY 1 ORDER BY depth, path LIMIT 60")
def a15(t):
    r = impact(depends(t).select("src", "dst", "confidence"), [1], cap=10**9).join(t.part, F.col("node") == F.col("p_partkey"))
    return r.groupBy(F.col("p_brand").alias("path")).agg(F.count("*").alias("symbols"), F.min("depth").alias("depth")).orderBy("depth", "path").limit(60)


@query("g10_risk", f"""WITH {DEPENDS_SQL}, d AS (SELECT dst AS part, count(*) FILTER (WHERE p_size % 10 <> 0) AS direct, count(DISTINCT CASE WHEN p_size % 10 <> 0 THEN p_brand END) AS files, count(*) FILTER (WHERE p_size % 10 = 0) AS tests FROM depends JOIN part ON p_partkey = src GROUP BY dst),
c AS (SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1),
x AS (SELECT part, direct, files, tests, churn, (CASE WHEN direct >= 10 THEN 3 WHEN direct >= 3 THEN 2 WHEN direct >= 1 THEN 1 ELSE 0 END) + (CASE WHEN files >= 8 THEN 2 WHEN files >= 3 THEN 1 ELSE 0 END)
+ (CASE WHEN tests = 0 AND direct > 0 THEN 2 ELSE 0 END) + (CASE WHEN churn >= 50 THEN 1 ELSE 0 END) AS points FROM d JOIN c USING (part))
SELECT *, CASE WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level FROM x""")
def g10(t):
    p = t.part.select(F.col("p_partkey").alias("src"), "p_brand", "p_size")
    d = depends(t).join(p, "src").groupBy(F.col("dst").alias("part")).agg(F.count_if(F.col("p_size") % 10 != 0).alias("direct"), F.countDistinct(F.when(F.col("p_size") % 10 != 0, F.col("p_brand"))).alias("files"), F.count_if(F.col("p_size") % 10 == 0).alias("tests"))
    c = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_orderkey").alias("churn"))
    x = d.join(c, "part").withColumn("points", risk(F.col("direct"), F.col("direct"), F.col("files"), F.col("tests"), F.lit(0), F.lit(0.0), F.col("churn")))
    return x.withColumn("level", risk_level(F.col("points")))


@query("g03_scope_closure", """SELECT DISTINCT kind, key FROM (SELECT 'region' AS kind, r_regionkey AS key FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'supplier', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)""")
def g03(t):
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("key"))
    contains = t.nation.select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("dst")).unionByName(t.supplier.select(node("nation", "s_nationkey").alias("src"), node("supplier", "s_suppkey").alias("dst")))
    start = t.region.filter("r_regionkey = 1").select(node("region", "r_regionkey").alias("node"))
    return scope(contains, start).select("node.kind", "node.key")


@query("g16_overview", f"""WITH {DEPENDS_SQL}, g AS (SELECT a.p_brand AS a, b.p_brand AS b, sum(weight) AS weight FROM depends JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2),
f AS (SELECT p_brand AS grp, count(*) AS files, sum(p_size) AS lines, count(*) FILTER (WHERE p_size % 10 = 0) AS tests FROM part GROUP BY 1),
c AS (SELECT p_brand AS grp, count(*) AS commits FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
o AS (SELECT a AS grp, count(*) AS outs FROM g GROUP BY 1), i AS (SELECT b AS grp, count(*) AS ins FROM g GROUP BY 1)
SELECT grp, files, lines, tests, coalesce(commits, 0) AS commits, coalesce(ins, 0) AS ins, coalesce(outs, 0) AS outs FROM f LEFT JOIN c USING (grp) LEFT JOIN o USING (grp) LEFT JOIN i USING (grp)
ORDER BY coalesce(ins, 0) + coalesce(outs, 0) + coalesce(commits, 0) / 10.0 DESC, grp LIMIT 20""")
def g16(t):
    brand = t.part.select("p_partkey", "p_brand")
    e = depends(t).join(brand.toDF("src", "a"), "src").join(brand.toDF("dst", "b"), "dst").filter("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    f = t.part.groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("files"), F.sum("p_size").alias("lines"), F.count_if(F.col("p_size") % 10 == 0).alias("tests"))
    c = t.lineitem.join(brand, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("commits"))
    for x in (c, e.groupBy(F.col("a").alias("grp")).agg(F.count("*").alias("outs")), e.groupBy(F.col("b").alias("grp")).agg(F.count("*").alias("ins"))):
        f = f.join(x, "grp", "left")
    f = f.fillna(0, ["commits", "ins", "outs"])
    return f.orderBy((F.col("ins") + F.col("outs") + F.col("commits") / 10.0).desc(), "grp").limit(20).select("grp", "files", "lines", "tests", "commits", "ins", "outs")


@query("v05_dominant_kind", """WITH e AS (SELECT l_suppkey AS src, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT src, (array_agg(kind ORDER BY n DESC, kind))[1] AS kind, sum(n)::BIGINT AS n FROM e GROUP BY src""")
def v05(t):
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    first = F.min_by("kind", F.struct(-F.col("n"), F.col("kind")))
    return e.groupBy("src").agg(first.alias("kind"), F.sum("n").alias("n"))


@query("v01_top_edges_per_source", f"WITH {DEPENDS_SQL} SELECT src, dst, weight FROM depends QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 4")
def v01(t):
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return depends(t).withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("src", "dst", "weight")


@query("a13_package_users", """SELECT p_brand AS package, count(DISTINCT s_nationkey) AS users FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY users DESC, package LIMIT 20""")
def a13(t):
    e = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return e.groupBy(F.col("p_brand").alias("package")).agg(F.countDistinct("s_nationkey").alias("users")).orderBy(F.desc("users"), "package").limit(20)


@query("g17_node_search", f"""WITH {NODES_SQL} SELECT kind, key, label, CASE WHEN lower(label) = 'nation_1' THEN 0 WHEN lower(regexp_replace(label, '^.*[.:#/_]', '')) = '1' THEN 1 WHEN label ILIKE '1%' THEN 2 ELSE 3 END AS tier
FROM nodes WHERE label ILIKE '%1%' ORDER BY tier, length(label), label, kind, key LIMIT 30""")
def g17(t):
    low = F.lower("label")
    tier = F.when(low == "nation_1", 0).when(F.regexp_replace(low, "^.*[.:#/_]", "") == "1", 1).when(F.col("label").ilike("1%"), 2).otherwise(3)
    return nodes(t).filter(F.col("label").ilike("%1%")).withColumn("tier", tier).orderBy("tier", F.length("label"), "label", "kind", "key").limit(30)


@query("g18_node_degree", f"""WITH {EDGES_SQL}, both_ AS (SELECT src AS id, via, 'out' AS side FROM edges UNION ALL SELECT dst, via, 'in' FROM edges)
SELECT id, via AS kind, count(*) FILTER (WHERE side = 'in') AS ins, count(*) FILTER (WHERE side = 'out') AS outs FROM both_ GROUP BY 1, 2""")
def g18(t):
    e = edges(t)
    b = e.select(F.col("src").alias("id"), "via", F.lit("out").alias("side")).unionByName(e.select(F.col("dst").alias("id"), "via", F.lit("in").alias("side")))
    return b.groupBy("id", F.col("via").alias("kind")).agg(F.count_if(F.col("side") == "in").alias("ins"), F.count_if(F.col("side") == "out").alias("outs"))


@query("g19_expand_dated", """SELECT o_custkey AS node, o_orderpriority AS kind, o_orderkey AS far, o_orderdate AS dated, total FROM (SELECT *, count(*) OVER w AS total, row_number() OVER (w ORDER BY o_totalprice DESC, o_orderdate DESC NULLS LAST, o_orderkey) AS rn
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)) WHERE rn <= 3""")
def g19(t):
    w = Window.partitionBy("o_custkey", "o_orderpriority")
    d = t.orders.filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "2000-01-01"))
    d = d.withColumn("total", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("o_totalprice"), F.desc_nulls_last("o_orderdate"), "o_orderkey"))).filter("rn <= 3")
    return d.select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("far"), F.col("o_orderdate").alias("dated"), "total")


@query("w03_interleave", """WITH r AS (SELECT l_returnflag AS relation, l_partkey AS part, sum(l_quantity) AS q FROM lineitem WHERE l_suppkey = 1 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY q DESC, part) AS rn FROM r)
SELECT relation, part, q, rn FROM n ORDER BY rn, relation LIMIT 12""")
def w03(t):
    r = t.lineitem.filter("l_suppkey = 1").groupBy(F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("q"))
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("q"), "part")))
    return r.orderBy("rn", "relation").limit(12)


@query("v11_hide_node", f"WITH {DEPENDS_SQL} SELECT src, dst, weight FROM depends WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 = 0) AND dst NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 = 0)")
def v11(t):
    hidden = t.part.filter("p_size % 10 = 0").select("p_partkey")
    e = depends(t).select("src", "dst", "weight")
    return e.join(hidden, e.src == hidden.p_partkey, "left_anti").join(hidden, F.col("dst") == F.col("p_partkey"), "left_anti")


@query("v02_merge_expansion", f"""WITH {EDGES_SQL}, shown AS (SELECT DISTINCT src, kind, dst FROM edges WHERE confidence > 0.945 OR weight > 44), total AS (SELECT src, count(DISTINCT dst) AS total FROM edges GROUP BY src)
SELECT src, count(*) AS shown, any_value(total) - count(*) AS hidden FROM shown JOIN total USING (src) GROUP BY src""")
def v02(t):
    e = edges(t)
    shown = e.filter("confidence > 0.945").unionByName(e.filter("weight > 44")).dropDuplicates(["src", "kind", "dst"]).groupBy("src").agg(F.count("*").alias("shown"))
    total = e.groupBy("src").agg(F.countDistinct("dst").alias("total"))
    return shown.join(total, "src").select("src", "shown", (F.col("total") - F.col("shown")).alias("hidden"))


@query("g20_ancestors", """WITH RECURSIVE a AS (SELECT p_partkey AS part, p_partkey AS anc, 0 AS depth FROM part UNION ALL SELECT part, (anc / 2)::BIGINT AS anc, depth + 1 FROM (SELECT part, anc - anc % 2 AS anc, depth FROM a WHERE anc > 0 AND depth < 4))
SELECT part, anc, min(depth) AS depth FROM a WHERE depth > 0 GROUP BY part, anc""")
def g20(t):
    base = t.part.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    level = t.part.select(F.col("p_partkey").alias("part"), F.col("p_partkey").alias("anc"))
    out = []
    for d in range(1, 5):
        level = level.filter("anc > 0").join(base, F.col("anc") == F.col("child")).select("part", F.col("parent").alias("anc"))
        out.append(level.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, out).groupBy("part", "anc").agg(F.min("depth").alias("depth"))


@query("v10_neighborhood_columns", f"WITH {DEPENDS_SQL} SELECT side, relation, count(*) AS total FROM (SELECT 'left' AS side, CASE WHEN weight > 1 THEN 'strong' ELSE 'weak' END AS relation FROM depends WHERE dst = 1 UNION ALL SELECT 'right', CASE WHEN weight > 1 THEN 'strong' ELSE 'weak' END FROM depends WHERE src = 1) GROUP BY 1, 2")
def v10(t):
    e = depends(t).withColumn("relation", F.when(F.col("weight") > 1, "strong").otherwise("weak"))
    b = e.filter("dst = 1").select(F.lit("left").alias("side"), "relation").unionByName(e.filter("src = 1").select(F.lit("right").alias("side"), "relation"))
    return b.groupBy("side", "relation").agg(F.count("*").alias("total"))
