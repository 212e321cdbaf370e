"""Relational operators of the store: joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.plans.projection import COMMIT_FILES_SQL, COMMITS_SQL, commit_files, commits
from sedimenta.plans.registry import query

c = F.col


def cochange(files: DataFrame, cap: int, least: int = 2) -> DataFrame:
    """Pairs of paths that commits of at most `cap` files touch together: (path, other, together, total, ratio). Total counts the
    path's own such commits."""
    f = files.select("sha", "path").distinct()
    few = f.withColumn("n", F.row_number().over(Window.partitionBy("sha").orderBy("path"))).filter(c("n") <= cap + 1)
    small = few.groupBy("sha").agg(F.collect_list("path").alias("paths")).filter(F.size("paths") <= cap)
    # a path with itself counts its own commits
    pairs = small.select(F.explode("paths").alias("path"), "paths").select("path", F.explode("paths").alias("other")).groupBy("path", "other").agg(F.count("*").alias("together"))
    own = F.max(F.when(c("path") == c("other"), c("together"))).over(Window.partitionBy("path"))
    pairs = pairs.withColumn("total", own).filter((c("path") != c("other")) & (c("together") >= least))
    return pairs.withColumn("ratio", c("together") / c("total"))


@query("j03_cochange_selfjoin", f"""WITH {COMMIT_FILES_SQL}, f AS (SELECT DISTINCT sha, path FROM commit_files), s AS (SELECT * FROM f WHERE sha IN (SELECT sha FROM f GROUP BY sha HAVING count(*) <= 6)),
p AS (SELECT a.path, b.path AS other, count(DISTINCT a.sha) AS together FROM s a JOIN s b USING (sha) WHERE a.path <> b.path GROUP BY 1, 2 HAVING count(DISTINCT a.sha) >= 2), t AS (SELECT path, count(*) AS total FROM s GROUP BY 1)
SELECT path, other, together, total, together / total AS ratio FROM p JOIN t USING (path)""")
def j03(t):
    return cochange(commit_files(t), 6)


@query("j02_two_sided_join", """SELECT s_nationkey AS a, p_brand AS b, count(*) AS n, max(l_quantity) AS top FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def j02(t):
    j = t.lineitem.join(t.supplier, c("s_suppkey") == c("l_suppkey")).join(t.part, c("p_partkey") == c("l_partkey"))
    return j.groupBy(c("s_nationkey").alias("a"), c("p_brand").alias("b")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))


@query("j04_star_join", "SELECT r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def j04(t):
    return t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region.filter("r_name = 'ASIA'"), c("r_regionkey") == c("n_regionkey")).select("r_name", "n_name", "s_name")


@query("j05_left_outer_group", "SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j05(t):
    j = t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("done"), F.max("o_orderdate").alias("latest"))


@query("j06_or_join", """SELECT p_partkey, count(l_orderkey) FILTER (WHERE l_partkey = p_partkey) AS ins, count(l_orderkey) FILTER (WHERE l_suppkey = p_partkey) AS outs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey OR l_suppkey = p_partkey GROUP BY 1""")
def j06(t):
    """An OR of two equalities as a union of two counts, so that no nested loop is planned."""
    ins = t.lineitem.groupBy(c("l_partkey").alias("k")).agg(F.count("*").alias("ins")).withColumn("outs", F.lit(0))
    outs = t.lineitem.groupBy(c("l_suppkey").alias("k")).agg(F.lit(0).alias("ins"), F.count("*").alias("outs"))
    both = ins.unionByName(outs).groupBy("k").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))
    return t.part.select("p_partkey").join(both, c("p_partkey") == c("k"), "left").select("p_partkey", F.coalesce("ins", F.lit(0)).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs"))


@query("j07_cast_key_join", """SELECT event_id, k, coalesce(n_name, 'nation ' || k) AS label FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) LEFT JOIN nation ON n_nationkey = try_cast(k AS BIGINT)""")
def j07(t):
    e = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.join(t.nation, c("n_nationkey") == c("k").try_cast("long"), "left").select("event_id", "k", F.coalesce("n_name", F.concat(F.lit("nation "), c("k"))).alias("label"))


@query("j08_ordered_links", "SELECT o_orderkey, c_name, o_orderpriority = '1-URGENT' AS urgent FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY urgent DESC, o_orderkey LIMIT 50")
def j08(t):
    j = t.orders.join(t.customer, c("c_custkey") == c("o_custkey")).select("o_orderkey", "c_name", (c("o_orderpriority") == "1-URGENT").alias("urgent"))
    return j.orderBy(F.desc("urgent"), "o_orderkey").limit(50)


@query("j09_semi_join", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def j09(t):
    return t.part.join(t.lineitem.filter("l_quantity >= 49"), c("l_partkey") == c("p_partkey"), "left_semi").select("p_partkey", "p_name")


@query("j10_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j10(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


_RANGES_SQL = """defs AS (SELECT o_orderkey AS id, o_custkey AS path, (o_orderkey % 50)::BIGINT AS a, (o_orderkey % 50 + o_orderkey % 17)::BIGINT AS b FROM orders),
sites AS (SELECT event_id, user_id AS path, event_id % 60 AS line FROM events)"""


def ranges(t):
    defs = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("path"), (c("o_orderkey") % 50).alias("a"), (c("o_orderkey") % 50 + c("o_orderkey") % 17).alias("b"))
    return defs, t.events.select("event_id", c("user_id").alias("path"), (c("event_id") % 60).alias("line"))


@query("j12_innermost_interval", f"""WITH {_RANGES_SQL} SELECT event_id, (array_agg(id ORDER BY b - a, id))[1] AS id, count(*) AS depth FROM sites JOIN defs ON defs.path = sites.path AND line BETWEEN a AND b GROUP BY event_id""")
def j12(t):
    """The path stays an equality, so the range is only a residual filter of a hash or merge join."""
    defs, sites = ranges(t)
    j = sites.join(defs, "path").filter("line between a and b")
    return j.groupBy("event_id").agg(F.min_by("id", F.struct(c("b") - c("a"), c("id"))).alias("id"), F.count("*").alias("depth"))


@query("f03_interval_overlap", f"WITH {_RANGES_SQL} SELECT path, id, a, b FROM defs WHERE a <= 30 AND b >= 20 QUALIFY row_number() OVER (PARTITION BY path ORDER BY b - a, id) <= 3")
def f03(t):
    w = Window.partitionBy("path").orderBy(c("b") - c("a"), "id")
    return ranges(t)[0].filter("a <= 30 and b >= 20").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("path", "id", "a", "b")


@query("g02_locate", f"""WITH {_RANGES_SQL}, q AS (SELECT DISTINCT path, 10 AS x, 14 AS y FROM defs), m AS (SELECT q.path, id, CASE WHEN a <= x AND b >= y THEN 1 WHEN a >= x AND b <= y THEN 2 ELSE 3 END AS tier, b - a AS span FROM q JOIN defs USING (path))
SELECT path, id, tier FROM m WHERE tier < 3 QUALIFY row_number() OVER (PARTITION BY path ORDER BY tier, CASE WHEN tier = 1 THEN span ELSE -span END, id) = 1""")
def g02(t):
    d = ranges(t)[0].withColumn("tier", F.when((c("a") <= 10) & (c("b") >= 14), 1).when((c("a") >= 10) & (c("b") <= 14), 2).otherwise(3)).withColumn("span", c("b") - c("a"))
    key = F.struct("tier", F.when(c("tier") == 1, c("span")).otherwise(-c("span")), "id")
    return d.filter("tier < 3").groupBy("path").agg(F.min(key).alias("k")).select("path", "k.id", "k.tier")


@query("j13_symbol_chunk", f"""WITH {_RANGES_SQL}, s AS (SELECT event_id, sites.path, line FROM sites) SELECT event_id, id FROM s LEFT JOIN defs ON defs.path = s.path AND line BETWEEN a AND b
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN a = line THEN 0 ELSE 1 END, b - a, id) = 1""")
def j13(t):
    defs, sites = ranges(t)
    j = sites.alias("s").join(defs.alias("d"), (c("s.path") == c("d.path")) & c("line").between(c("a"), c("b")), "left")
    return j.groupBy("event_id").agg(F.min_by("id", F.struct(F.when(c("a") == c("line"), 0).otherwise(1), c("b") - c("a"), c("id"))).alias("id"))


@query("j15_expiry_join", "SELECT user_id, count(*) AS n FROM events JOIN customer ON c_custkey = user_id WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-01' GROUP BY 1")
def j15(t):
    live = t.events.filter(F.expr("ts + interval 30 days > timestamp '2024-02-01'"))
    return live.join(t.customer, c("c_custkey") == c("user_id"), "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("j17_multi_hop_chain", "SELECT n_name, count(DISTINCT o_orderkey) AS commits, count(DISTINCT l_partkey) AS files FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j17(t):
    j = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("commits"), F.countDistinct("l_partkey").alias("files"))


@query("a02_count_filter", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) AS n FROM lineitem GROUP BY 1")
def a02(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(c("l_returnflag") == "R").alias("returned"), F.count_if(c("l_linestatus") == "O").alias("open_lines"), F.count("*").alias("n"))


@query("a05_ordered_first", "SELECT conv_id, (array_agg(text ORDER BY turn DESC))[1] AS last_text, max(turn) AS turns FROM conversations GROUP BY 1")
def a05(t):
    return t.conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("turns"))


@query("a06_having", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) >= 2")
def a06(t):
    return t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("kinds")).filter("kinds >= 2")


@query("a08_correlated_counts", "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS sites, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS callers FROM part")
def a08(t):
    n = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("sites"), F.countDistinct("l_suppkey").alias("callers"))
    return t.part.join(n, c("l_partkey") == c("p_partkey"), "left").select("p_partkey", F.coalesce("sites", F.lit(0)).alias("sites"), F.coalesce("callers", F.lit(0)).alias("callers"))


@query("a10_top_languages", "SELECT coalesce(lang, 'other') AS lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 12")
def a10(t):
    d = t.documents.groupBy(F.coalesce("lang", F.lit("other")).alias("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return d.orderBy(F.desc("n"), "lang").limit(12).select("lang", "n", c("chars").cast("decimal(38,0)").alias("chars"))


@query("a16_churn", f"WITH {COMMITS_SQL}, {COMMIT_FILES_SQL} SELECT path, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors, max(authored_at) AS last_changed FROM commit_files JOIN commits USING (sha) GROUP BY path")
def a16(t):
    j = commit_files(t).join(commits(t), "sha")
    return j.groupBy("path").agg(F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.max("authored_at").alias("last_changed"))


@query("a19_commit_totals", f"WITH {COMMIT_FILES_SQL} SELECT sha, count(*) AS files, sum(coalesce(CASE WHEN insertions > 40 THEN NULL ELSE insertions END, 0)) AS insertions FROM commit_files GROUP BY sha")
def a19(t):
    return commit_files(t).groupBy("sha").agg(F.count("*").alias("files"), F.sum(F.coalesce(F.when(c("insertions") <= 40, c("insertions")), F.lit(0.0))).alias("insertions"))


@query("a20_thread_concat", r"""WITH x AS (SELECT conv_id, turn, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 60) AS s FROM conversations), y AS (SELECT *, sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM x)
SELECT conv_id, string_agg(s, ' / ' ORDER BY turn) || CASE WHEN any_value(n) > count(*) THEN ' … (' || (any_value(n) - count(*))::VARCHAR || ' more comments)' ELSE '' END AS thread FROM y WHERE upto <= 200 GROUP BY conv_id""")
def a20(t):
    x = t.conversations.select("conv_id", "turn", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 60).alias("s"))
    w = Window.partitionBy("conv_id")
    y = x.withColumn("upto", F.sum(F.length("s")).over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w)).filter("upto <= 200")
    g = y.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda v: v["s"]), " / ").alias("thread"), F.max("n").alias("n"), F.count("*").alias("k"))
    more = F.when(c("n") > c("k"), F.concat(F.lit(" … ("), (c("n") - c("k")).cast("string"), F.lit(" more comments)"))).otherwise("")
    return g.select("conv_id", F.concat("thread", more).alias("thread"))


@query("a21_distinct_authors", "SELECT l_partkey AS path, array_to_string(list_sort(list_distinct(array_agg(o_orderpriority))), ',') AS authors FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def a21(t):
    j = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey"))
    return j.groupBy(c("l_partkey").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("authors"))


@query("w02_per_group_limit", "SELECT l_returnflag, l_suppkey, l_orderkey, l_linenumber, total FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_suppkey) AS total, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 2")
def w02(t):
    w = Window.partitionBy("l_returnflag", "l_suppkey")
    d = t.lineitem.withColumn("rn", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"))).filter("rn <= 2")
    total = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("total"))
    return d.join(total, ["l_returnflag", "l_suppkey"]).select("l_returnflag", "l_suppkey", "l_orderkey", "l_linenumber", "total")


@query("w04_distinct_on", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, value DESC, event_id")
def w04(t):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_type", "event_id", "value")


@query("w05_history_roles", f"""WITH {COMMITS_SQL}, h AS (SELECT author, sha, row_number() OVER (PARTITION BY author ORDER BY authored_at DESC, sha DESC) AS newest, row_number() OVER (PARTITION BY author ORDER BY authored_at, sha) AS oldest FROM commits)
SELECT author, sha, CASE WHEN oldest = 1 THEN 'introduced' ELSE 'modified' END AS role FROM h WHERE newest <= 3 OR oldest = 1""")
def w05(t):
    w = Window.partitionBy("author")
    h = commits(t).withColumn("newest", F.row_number().over(w.orderBy(F.desc("authored_at"), F.desc("sha")))).withColumn("oldest", F.row_number().over(w.orderBy("authored_at", "sha")))
    return h.filter("newest <= 3 or oldest = 1").select("author", "sha", F.when(c("oldest") == 1, "introduced").otherwise("modified").alias("role"))


@query("w06_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w06(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.conversations.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("conv_id", "turn", "role")


@query("w07_next_position", "SELECT c_custkey, coalesce(max(p), 0) + 1 AS next_position FROM customer LEFT JOIN (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def w07(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("p"))
    return t.customer.join(n, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", (F.coalesce("p", F.lit(0)) + 1).alias("next_position"))


@query("w08_keep_first_and_newest", f"""WITH {COMMITS_SQL}, h AS (SELECT author, sha, count(*) OVER (PARTITION BY author) AS n, row_number() OVER (PARTITION BY author ORDER BY authored_at DESC, sha DESC) AS newest FROM commits) SELECT author, sha FROM h WHERE n <= 8 OR newest <= 7 OR newest = n""")
def w08(t):
    w = Window.partitionBy("author")
    h = commits(t).withColumn("n", F.count("*").over(w)).withColumn("newest", F.row_number().over(w.orderBy(F.desc("authored_at"), F.desc("sha"))))
    return h.filter("n <= 8 or newest <= 7 or newest = n").select("author", "sha")


@query("w10_gaps", f"""WITH {_RANGES_SQL}, m AS (SELECT path, a, b, max(b) OVER (PARTITION BY path ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM defs) SELECT path, coalesce(seen, 0) + 1 AS gap_start, a - 1 AS gap_end FROM m WHERE a - coalesce(seen, 0) > 3""")
def w10(t):
    w = Window.partitionBy("path").orderBy("a", "b", "id").rowsBetween(Window.unboundedPreceding, -1)
    m = ranges(t)[0].withColumn("seen", F.coalesce(F.max("b").over(w), F.lit(0)))
    return m.filter("a - seen > 3").select("path", (c("seen") + 1).alias("gap_start"), (c("a") - 1).alias("gap_end"))


@query("w11_character_budget", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents) WHERE upto <= 20000")
def w11(t):
    w = Window.partitionBy("source").orderBy("doc_id")
    return t.documents.select("source", "doc_id", F.sum("n_chars").over(w).alias("upto")).filter("upto <= 20000").select("source", "doc_id")


@query("t07_nulls_last", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS dated FROM orders ORDER BY o_orderpriority, dated DESC NULLS LAST, o_orderkey LIMIT 100")
def t07(t):
    d = t.orders.select("o_orderkey", "o_orderpriority", F.when(c("o_orderstatus") != "P", c("o_orderdate")).alias("dated"))
    return d.orderBy("o_orderpriority", F.desc_nulls_last("dated"), "o_orderkey").limit(100).select("o_orderkey", "dated")


@query("t14_shortest_wins", "SELECT p_brand, (array_agg(p_name ORDER BY length(p_name), p_name))[1] AS p_name FROM part GROUP BY 1")
def t14(t):
    return t.part.groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("p_name"))


@query("u02_set_union", "SELECT l_partkey AS k FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def u02(t):
    return t.lineitem.select(c("l_partkey").alias("k")).union(t.lineitem.select("l_suppkey")).distinct()


@query("u03_set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def u03(t):
    return t.part.select(c("p_partkey").alias("k")).join(t.lineitem.filter("l_quantity > 49"), c("k") == c("l_partkey"), "left_anti")


@query("u04_link_set", "SELECT DISTINCT 'order' AS src_type, l_orderkey AS src_key, 'part' AS dst_type, l_partkey AS dst_key, CASE WHEN l_returnflag = 'R' THEN 'fixes' ELSE 'mentions' END AS kind FROM lineitem")
def u04(t):
    kind = F.when(c("l_returnflag") == "R", "fixes").otherwise("mentions")
    return t.lineitem.select(F.lit("order").alias("src_type"), c("l_orderkey").alias("src_key"), F.lit("part").alias("dst_type"), c("l_partkey").alias("dst_key"), kind.alias("kind")).dropDuplicates()


@query("u05_fixes_minus_mentions", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def u05(t):
    pairs = lambda f: t.lineitem.filter(c("l_returnflag") == f).select("l_orderkey", "l_partkey")
    return pairs("R").distinct().join(pairs("N"), ["l_orderkey", "l_partkey"], "left_anti")


@query("f06_any_all", "SELECT event_id FROM events WHERE user_id IN (1, 2, 3) AND event_type NOT IN ('view', 'click')")
def f06(t):
    return t.events.filter(c("user_id").isin(1, 2, 3) & ~c("event_type").isin("view", "click")).select("event_id")


@query("f10_json_predicate", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('1', '5', '42')")
def f10(t):
    k = F.get_json_object("props", "$.k")
    return t.events.filter(k.isin("1", "5", "42")).select("event_id", k.cast("long").alias("k"))


@query("f09_like_prefix", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%' ORDER BY CAST(o_orderkey AS VARCHAR), o_orderkey LIMIT 1")
def f09(t):
    s = c("o_orderkey").cast("string")
    return t.orders.filter(s.startswith("12")).orderBy(s).limit(1).select("o_orderkey")


@query("f17_visibility", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def f17(t):
    return t.orders.join(t.events.filter("event_type = 'signup'"), c("user_id") == c("o_custkey"), "left_semi").select("o_orderkey")


@query("v12_shares", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def v12(t):
    return t.documents.groupBy("source").agg(F.count_if(c("lang") == "en").alias("en"), F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("v03_directory_tree", "WITH p AS (SELECT unnest([p_brand, p_brand || '/' || p_type]) AS dir, p_size FROM part) SELECT dir, count(*) AS files, sum(p_size) AS lines FROM p GROUP BY dir")
def v03(t):
    p = t.part.select(F.explode(F.array("p_brand", F.concat_ws("/", "p_brand", "p_type"))).alias("dir"), "p_size")
    return p.groupBy("dir").agg(F.count("*").alias("files"), F.sum("p_size").cast("decimal(38,0)").alias("lines"))
