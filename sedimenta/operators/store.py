"""The store's remaining statements: predicates, lookups, counts, ordered lists, replacement and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import files as P
from sedimenta.functions import text as X
from sedimenta.operators.incremental import upsert
from sedimenta.operators.relational import _RANGES_SQL, cochange, ranges
from sedimenta.plans.projection import COMMIT_FILES_SQL, COMMITS_SQL, DEPENDS_SQL, EDGES_SQL, NODES_SQL, commit_files, commits, depends, edges, nodes
from sedimenta.plans.registry import query

c = F.col
# Wordings that ask for the impact of a change, and words that lean on an earlier question.
IMPACT_QUESTION = (
    r"\b(break|breaks|breaking|impact|affect\w*|depend\w*|dependents|callers?|who (uses|calls)|where\b.*\bused|usages?"
    r"|refactor\w*|safe to|risk\w*|blast radius|(if|when) (i|we|you|someone) (change|modify|remove|delete|rename)\w*)\b"
)
ANAPHORA = r"\b(it|its|this|that|these|those|they|them|their|there|he|she|the same|above|why|how come|what about|and)\b"


def optional(df: DataFrame, **params) -> DataFrame:
    """Equality filters; a parameter of None filters nothing, so it never reaches the plan."""
    for name, value in params.items():
        if value is not None:
            df = df.filter(c(name) == value)
    return df


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def ranked(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key with their rank; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)


def follow_up(turns: DataFrame, words: int = 12) -> DataFrame:
    """(conv_id, turn, question): a user's question of at most `words` words, or one with a word that leans on what came
    before, gets the user's previous question put before it."""
    q = turns.filter("role = 'user'").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    leans = (F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) <= words) | c("text").rlike("(?i)" + ANAPHORA)
    return q.select("conv_id", "turn", F.when(leans & c("before").isNotNull(), F.concat_ws("\n", "before", "text")).otherwise(c("text")).alias("question"))


def adjacent(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, x, y): the terms of each text with the term after them."""
    terms = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    d = docs.select(id_col, terms.alias("l")).filter(F.size("l") > 1)
    pairs = F.zip_with(F.slice("l", F.lit(1), F.size("l") - 1), F.slice("l", F.lit(2), F.size("l") - 1), lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    return d.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.x", "p.y")


@query("a01_count_by_group", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a01(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("a03_count_distinct", "SELECT l_partkey, count(DISTINCT l_suppkey) AS authors, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1")
def a03(t):
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("authors"), F.countDistinct("l_orderkey").alias("commits"))


@query("a04_max_sum", f"WITH {EDGES_SQL} SELECT src, sum(weight) AS weight, max(confidence) AS confidence FROM edges GROUP BY 1")
def a04(t):
    return edges(t).groupBy("src").agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"))


@query("a07_global_totals", "SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM orders) AS pulls, (SELECT count(*) FROM events) AS issues")
def a07(t):
    one = lambda df, name: df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    rows = one(t.documents, "chunks").unionByName(one(t.orders, "pulls")).unionByName(one(t.events, "issues"))
    return rows.agg(*[F.coalesce(F.max(F.when(c("name") == x, c("n"))), F.lit(0)).alias(x) for x in ("chunks", "pulls", "issues")])


@query("a11_graph_counts", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'node' AS part, kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', via, count(*) FROM edges GROUP BY via")
def a11(t):
    return nodes(t).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n").unionByName(edges(t).groupBy(c("via").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


@query("a12_directory_rollup", """WITH k AS (SELECT s_nationkey AS a, p_brand AS b, l_returnflag AS kind, sum(l_quantity) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)
SELECT a, b, sum(w) AS weight, string_agg(kind || ':' || w::BIGINT, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1, 2""")
def a12(t):
    """A weight for each kind between two groups; kinds are few, so the collected map is small."""
    j = t.lineitem.join(t.supplier, c("s_suppkey") == c("l_suppkey")).join(t.part, c("p_partkey") == c("l_partkey"))
    k = j.groupBy(c("s_nationkey").alias("a"), c("p_brand").alias("b"), c("l_returnflag").alias("kind")).agg(F.sum("l_quantity").alias("w"))
    each = F.concat_ws(":", "kind", c("w").cast("long").cast("string"))
    return k.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.array_join(F.array_sort(F.collect_list(each)), ",").alias("kinds"))


@query("a17_cochange_ratio", f"""WITH {COMMIT_FILES_SQL}, f AS (SELECT DISTINCT sha, path FROM commit_files), s AS (SELECT * FROM f WHERE sha IN (SELECT sha FROM f GROUP BY sha HAVING count(*) <= 6)),
p AS (SELECT a.path, b.path AS other, count(*) AS n FROM s a JOIN s b USING (sha) WHERE a.path <> b.path GROUP BY 1, 2 HAVING count(*) >= 2), x AS (SELECT path, max(n) AS together FROM p GROUP BY 1), n AS (SELECT path, count(*) AS total FROM s GROUP BY 1)
SELECT p_partkey AS path, coalesce(together, 0) AS together, CASE WHEN together IS NULL THEN 0 ELSE total END AS total FROM part LEFT JOIN x ON x.path = p_partkey LEFT JOIN n ON n.path = p_partkey""")
def a17(t):
    best = cochange(commit_files(t), 6).groupBy("path").agg(F.max("together").alias("together"), F.max("total").alias("total"))
    return t.part.select(c("p_partkey").alias("path")).join(best, "path", "left").fillna(0, ["together", "total"])


@query("f01_path_filter", """WITH p AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'src/' || p_name || '.py' WHEN 1 THEN 'vendor/x/' || p_name WHEN 2 THEN 'a/.github/' || p_name WHEN 3 THEN 'web/yarn.lock' WHEN 4 THEN 'img/' || p_name || '.PNG'
WHEN 5 THEN 'js/' || p_name || '.min.js' WHEN 6 THEN 'vendored/' || p_name WHEN 7 THEN '.gitignore' ELSE 'icons/x.SVG' END AS path FROM part) SELECT p_partkey, path, p_partkey % 9 IN (0, 6, 7) AS kept FROM p""")
def f01(t):
    m, n = c("p_partkey") % 9, c("p_name")
    cases = [F.concat(F.lit("src/"), n, F.lit(".py")), F.concat(F.lit("vendor/x/"), n), F.concat(F.lit("a/.github/"), n), F.lit("web/yarn.lock"), F.concat(F.lit("img/"), n, F.lit(".PNG")), F.concat(F.lit("js/"), n, F.lit(".min.js")), F.concat(F.lit("vendored/"), n), F.lit(".gitignore")]
    path = F.when(m == 0, cases[0])
    for i, x in enumerate(cases[1:], 1):
        path = path.when(m == i, x)
    d = t.part.select("p_partkey", path.otherwise("icons/x.SVG").alias("path"))
    return d.select("p_partkey", "path", P.indexable_path(c("path")).alias("kept"))


@query("f02_decode_filter", r"SELECT doc_id, CASE WHEN length(text) = 0 OR length(text) / len(string_split_regex(regexp_replace(text, '(\r\n|[\n\r])$', ''), '\r\n|[\n\r]')) <= 400 THEN length(text) END AS n FROM documents")
def f02(t):
    return t.documents.select("doc_id", F.length(P.decoded(c("text").cast("binary"))).cast("long").alias("n"))


@query("f04_containment", f"WITH {_RANGES_SQL} SELECT path, count(*) FILTER (WHERE a <= 10 AND b >= 14) AS around, count(*) FILTER (WHERE a >= 10 AND b <= 14) AS inside FROM defs GROUP BY path")
def f04(t):
    return ranges(t)[0].groupBy("path").agg(F.count_if(F.expr("a <= 10 and b >= 14")).alias("around"), F.count_if(F.expr("a >= 10 and b <= 14")).alias("inside"))


@query("f07_optional_parameter", "SELECT o_orderkey FROM orders WHERE (NULL IS NULL OR o_orderstatus = NULL) AND ('5-LOW' IS NULL OR o_orderpriority = '5-LOW')")
def f07(t):
    return optional(t.orders, o_orderstatus=None, o_orderpriority="5-LOW").select("o_orderkey")


@query("f08_ilike_unescaped", "SELECT c_custkey, c_name ILIKE 'customer_000%' AS starts, c_name ILIKE '%_5' AS holds FROM customer")
def f08(t):
    return t.customer.select("c_custkey", c("c_name").ilike("customer_000%").alias("starts"), c("c_name").ilike("%_5").alias("holds"))


@query("f11_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def f11(t):
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


@query("f12_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.085)")
def f12(t):
    return t.part.join(t.lineitem.filter("l_discount > 0.085"), c("l_partkey") == c("p_partkey"), "left_anti").select("p_partkey")


@query("f13_in_subquery", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f13(t):
    return t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("f14_null_tests", "SELECT d.doc_id, quality IS NULL AS unlabelled, text IS NOT NULL AS has_text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def f14(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", c("quality").isNull().alias("unlabelled"), c("text").isNotNull().alias("has_text"))


@query("f15_case_tiers", "SELECT p_partkey, CASE WHEN lower(p_name) = 'cold widget' THEN 0 WHEN p_name ILIKE 'cold%' THEN 1 WHEN p_name ILIKE '%widget%' THEN 2 ELSE 3 END AS tier FROM part")
def f15(t):
    n = F.lower("p_name")
    return t.part.select("p_partkey", F.when(n == "cold widget", 0).when(n.startswith("cold"), 1).when(n.contains("widget"), 2).otherwise(3).alias("tier"))


@query("f16_projection_list", "SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS state FROM orders")
def f16(t):
    return t.orders.select(*[c(a).alias(b) for a, b in (("o_orderkey", "id"), ("o_orderpriority", "title"), ("o_orderstatus", "state"))])


_ASK = "CASE turn % 4 WHEN 0 THEN 'What breaks if I rename ' WHEN 1 THEN 'Where on earth is it used: ' WHEN 2 THEN 'Explain ' ELSE 'Dependents of ' END || role"


@query("f18_impact_question", f"SELECT conv_id, turn, regexp_matches(s, '(?i){IMPACT_QUESTION}') AS hit FROM (SELECT *, {_ASK} AS s FROM conversations)")
def f18(t):
    return t.conversations.select("conv_id", "turn", F.expr(_ASK).rlike("(?i)" + IMPACT_QUESTION).alias("hit"))


@query("f19_follow_up", f"""WITH q AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN before IS NOT NULL AND (len(regexp_extract_all(text, '\\S+')) <= 12 OR regexp_matches(text, '(?i){ANAPHORA}')) THEN before || chr(10) || text ELSE text END AS question FROM q""")
def f19(t):
    return follow_up(t.conversations)


@query("f20_no_self_edges", "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def f20(t):
    return t.lineitem.filter("l_suppkey <> l_partkey").groupBy(c("l_suppkey").alias("src"), c("l_partkey").alias("dst")).agg(F.count("*").alias("n"))


@query("j01_edge_far_node", f"WITH {EDGES_SQL} SELECT src, dst, p_name AS label, line, site, weight FROM edges JOIN part ON p_partkey = dst")
def j01(t):
    return edges(t).join(t.part, c("p_partkey") == c("dst")).select("src", "dst", c("p_name").alias("label"), "line", "site", "weight")


@query("j11_one_row_function", "SELECT doc_id, len(regexp_extract_all(lower(text), q)) AS hits FROM documents, (SELECT '[a-z]+ing' AS q) WHERE regexp_matches(lower(text), q)")
def j11(t):
    """The one-row side is a literal, so no join is planned."""
    hits = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ing"), F.lit(0))).cast("long")
    return t.documents.select("doc_id", hits.alias("hits")).filter("hits > 0")


@query("j16_lookup_joins", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, s_name, o_orderpriority FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey")
def j16(t):
    j = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey"), "left").join(t.supplier, c("s_suppkey") == c("l_suppkey"), "left").join(t.orders, c("o_orderkey") == c("l_orderkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", "s_name", "o_orderpriority")


@query("j18_keyed_fetch", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = ANY (SELECT doc_id FROM labels WHERE toxic = 1)")
def j18(t):
    return t.documents.join(t.labels.filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("t03_symbol_hits", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) IN ('cold widget', 'widget') OR regexp_replace(lower(p_name), '^.* ', '') IN ('cold widget', 'widget') ORDER BY CASE WHEN lower(p_name) IN ('cold widget', 'widget') THEN 0 ELSE 1 END, p_size DESC, p_partkey LIMIT 10")
def t03(t):
    names = ("cold widget", "widget")
    full = F.lower("p_name").isin(*names)
    return t.part.filter(full | F.substring_index(F.lower("p_name"), " ", -1).isin(*names)).orderBy(F.when(full, 0).otherwise(1), F.desc("p_size"), "p_partkey").limit(10).select("p_partkey", "p_name")


@query("t04_best_covering", f"WITH {_RANGES_SQL} SELECT DISTINCT ON (path) path, id FROM defs WHERE a <= 25 AND b >= 25 ORDER BY path, b - a, id")
def t04(t):
    return ranges(t)[0].filter("a <= 25 and b >= 25").groupBy("path").agg(F.min_by("id", F.struct(c("b") - c("a"), c("id"))).alias("id"))


@query("t09_dependents_order", f"WITH {DEPENDS_SQL} SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, p_brand, p_name, src) AS rank FROM depends JOIN part ON p_partkey = src QUALIFY rank <= 150")
def t09(t):
    return ranked(depends(t).join(t.part, c("p_partkey") == c("src")), ["dst"], 150, F.desc("confidence"), "p_brand", "p_name", "src").select("dst", "src", c("rank").cast("long").alias("rank"))


@query("t10_externals_order", "SELECT n_nationkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey < 5, n_nationkey % 2 = 0 DESC, n_name) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def t10(t):
    w = Window.partitionBy("r_name").orderBy(c("n_nationkey") < 5, (c("n_nationkey") % 2 == 0).desc(), "n_name")
    return t.nation.join(t.region, c("r_regionkey") == c("n_regionkey")).select("n_nationkey", "r_name", F.row_number().over(w).cast("long").alias("place"))


@query("t11_newest_first", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest FROM events QUALIFY newest <= 5")
def t11(t):
    return ranked(t.events, ["user_id"], 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", c("rank").cast("long").alias("newest"))


@query("t13_fetch_tiers", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END AS tier, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END, o_orderkey DESC) AS place FROM orders")
def t13(t):
    d = t.orders.withColumn("tier", F.when(c("o_orderstatus") == "O", 1).when(c("o_orderstatus") == "F", 2).otherwise(3))
    return d.select("o_custkey", "o_orderkey", "tier", F.row_number().over(Window.partitionBy("o_custkey").orderBy("tier", F.desc("o_orderkey"))).cast("long").alias("place"))


@query("u01_score_union", "SELECT k, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT l_partkey AS k, l_linenumber AS r FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') GROUP BY k")
def u01(t):
    one = lambda f, k: t.lineitem.filter(c("l_returnflag") == f).select(c(k).alias("k"), c("l_linenumber").alias("r"))
    return one("R", "l_partkey").unionByName(one("A", "l_suppkey")).groupBy("k").agg(F.sum(1.0 / (60 + c("r"))).alias("score"))


@query("u06_tier_concatenation", "SELECT 1 AS tier, o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 2, c_custkey FROM customer UNION ALL SELECT 3, s_suppkey FROM supplier")
def u06(t):
    tiers = (t.orders.filter("o_orderstatus = 'O'").select("o_orderkey"), t.customer.select("c_custkey"), t.supplier.select("s_suppkey"))
    out = [df.select(F.lit(i).alias("tier"), c(df.columns[0]).alias("k")) for i, df in enumerate(tiers, 1)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("w01_list_rank", "SELECT l_returnflag AS label, l_partkey AS id, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2 QUALIFY rank <= 50")
def w01(t):
    g = t.lineitem.groupBy(c("l_returnflag").alias("label"), c("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    return ranked(g, ["label"], 50, F.desc("q"), "id").select("label", "id", c("rank").cast("long").alias("rank"))


@query("w09_keep_first", "SELECT DISTINCT ON (l_partkey) l_partkey, l_returnflag, l_orderkey FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey, l_returnflag")
def w09(t):
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return t.lineitem.groupBy("l_partkey").agg(F.min(order).alias("k")).select("l_partkey", "k.l_returnflag", "k.l_orderkey")


@query("k02_replace_all", "SELECT l_suppkey AS src, l_partkey AS dst, 'old' AS run FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT DISTINCT l_suppkey, l_partkey, 'new' FROM lineitem WHERE l_returnflag = 'R'")
def k02(t):
    """One partition's rows give way to the new run's; on disk this is replace_partition."""
    old = t.lineitem.filter("l_returnflag <> 'R'").select(c("l_suppkey").alias("src"), c("l_partkey").alias("dst"), F.lit("old").alias("run"))
    return old.unionByName(t.lineitem.filter("l_returnflag = 'R'").select(c("l_suppkey").alias("src"), c("l_partkey").alias("dst")).distinct().withColumn("run", F.lit("new")))


def _replaced(t, update: list[str]) -> DataFrame:
    cols = ("event_id", "event_type", "value")
    new = t.events.filter("event_type = 'error'").withColumn("event_type", F.lit("handled")).withColumn("value", -c("value")).select(*cols)
    return upsert(t.events.filter("value < 150").select(*cols), new, ["event_id"], update)


@query("k04_upsert_all_columns", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'handled' ELSE event_type END AS event_type, CASE WHEN event_type = 'error' THEN -value ELSE value END AS value FROM events WHERE value < 150 OR event_type = 'error'")
def k04(t):
    return _replaced(t, ["event_type", "value"])


@query("k05_upsert_some_columns", "SELECT event_id, CASE WHEN event_type = 'error' AND value >= 150 THEN 'handled' ELSE event_type END AS event_type, CASE WHEN event_type = 'error' THEN -value ELSE value END AS value FROM events WHERE value < 150 OR event_type = 'error'")
def k05(t):
    return _replaced(t, ["value"])


@query("k09_conditional_purge", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 3) OR lang = 'en'")
def k09(t):
    """Rows of the keys whose setting changed go, those already made under the new one stay."""
    changed = t.documents.groupBy("source").agg(F.countDistinct("lang").alias("n")).filter("n > 3")
    stale = t.documents.filter("lang is distinct from 'en'").join(changed, "source", "left_semi").select("doc_id")
    return t.documents.join(stale, "doc_id", "left_anti").select("doc_id")


@query("x02_expand_identifiers", r"""WITH s AS (SELECT p_partkey, 'get_' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' plain ' || 'readHTTP' || p_size AS s FROM part) SELECT p_partkey, s || chr(10) || array_to_string(list_transform(regexp_extract_all(regexp_extract(s, '^\S+'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), ' ') || ' read http ' || regexp_extract(s, '[0-9]+$') AS text FROM s""")
def x02(t):
    s = F.concat(F.lit("get_"), F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring(c("p_type"), 2, 100)), F.lit(" plain readHTTP"), c("p_size").cast("string"))
    return t.part.select("p_partkey", X.expand_identifiers(s).alias("text"))


@query("x03_query_identifiers", "SELECT p_partkey, 'pkg.' || lower(p_type) || '.run' || ',' || replace(lower(p_name), ' ', ',') AS names FROM part")
def x03(t):
    s = F.concat(F.lit("Where is Pkg::"), "p_type", F.lit("::run in the "), "p_name", F.lit(" or it?"))
    return t.part.select("p_partkey", F.array_join(X.query_identifiers(s), ",").alias("names"))


@query("x08_string_basics", "SELECT c_custkey, lower(c_name) AS low, length(c_name) AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') || '/' || c_nationkey AS tag FROM customer")
def x08(t):
    return t.customer.select("c_custkey", F.lower("c_name").alias("low"), F.length("c_name").cast("long").alias("n"), F.concat_ws("/", F.coalesce(F.nullif(c("c_mktsegment"), F.lit("BUILDING")), F.lit("none")), c("c_nationkey").cast("string")).alias("tag"))


@query("x09_json_fields", """SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.none') AS has_none, '{"k":"' || json_extract_string(props, '$.k') || '","kind":"' || event_type || '"}' AS built FROM events""")
def x09(t):
    k = F.get_json_object("props", "$.k")
    keys = F.json_object_keys("props")
    return t.events.select("event_id", k.alias("k"), F.array_contains(keys, "k").alias("has_k"), F.array_contains(keys, "none").alias("has_none"), F.to_json(F.struct(k.alias("k"), c("event_type").alias("kind"))).alias("built"))


@query("x10_int_cast", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, try_cast(event_type AS INTEGER) AS bad FROM events")
def x10(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), c("event_type").try_cast("int").alias("bad"))


@query("x12_path_functions", "SELECT p_partkey, 'a/' || p_brand AS dir, p_type || '.tar.gz' AS base, 'gz' AS ext, p_brand || '/' || p_type AS norm FROM part")
def x12(t):
    path = F.concat(F.lit("a/"), "p_brand", F.lit("/"), "p_type", F.lit(".tar.GZ"))
    messy = F.concat(F.lit("./x//../"), "p_brand", F.lit("/y/.././"), "p_type", F.lit("/"))
    return t.part.select("p_partkey", P.dirname(path).alias("dir"), F.regexp_replace(P.basename(path), "GZ$", "gz").alias("base"), P.extension(path).alias("ext"), P.normal_path(messy).alias("norm"))


@query("x21_slice_lines", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 4 THEN chr(10) || '…' ELSE '' END AS code FROM documents")
def x21(t):
    lines = F.split("text", "\n")
    more = F.when(F.size(lines) > 4, "\n…").otherwise("")
    return t.documents.select("doc_id", F.concat(F.array_join(F.slice(lines, 2, 3), "\n"), more).alias("code"))


@query("x24_history_texts", """WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, array_to_string(list_slice(list_sort(array_agg(l_partkey)), 1, 3), ', ') AS files FROM f GROUP BY 1)
SELECT o_orderkey, 'Commit ' || o_orderkey || ' by ' || o_custkey || chr(10) || o_orderpriority || CASE WHEN n IS NULL THEN '' ELSE chr(10) || 'Files: ' || files || CASE WHEN n > 3 THEN ' and ' || (n - 3) || ' more' ELSE '' END END AS content FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def x24(t):
    f = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    g = f.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("l_partkey")), 1, 3), lambda x: x.cast("string")), ", ").alias("files"))
    s = lambda x: c(x).cast("string")
    more = F.when(c("n") > 3, F.concat(F.lit(" and "), (c("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    head = F.concat(F.lit("Commit "), s("o_orderkey"), F.lit(" by "), s("o_custkey"))
    return t.orders.join(g, c("l_orderkey") == c("o_orderkey"), "left").select("o_orderkey", F.concat_ws("\n", head, "o_orderpriority", F.concat(F.lit("Files: "), "files", more)).alias("content"))


@query("x31_evidence_attributes", """SELECT o_orderkey, '<source id="S' || o_orderkey || '" type="' || replace(o_orderpriority || '"x"', '"', '&quot;') || '" date="' || strftime(o_orderdate, '%Y-%m-%d') || '"/>' AS tag FROM orders""")
def x31(t):
    kind = F.replace(F.concat("o_orderpriority", F.lit('"x"')), F.lit('"'), F.lit("&quot;"))
    return t.orders.select("o_orderkey", F.concat(F.lit('<source id="S'), c("o_orderkey").cast("string"), F.lit('" type="'), kind, F.lit('" date="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"/>')).alias("tag"))


@query("c07_language", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN NULL ELSE 'rust' END AS language FROM part")
def c07(t):
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".TS"), F.lit(".txt"), F.lit(".rs")), (c("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", P.language(F.concat(F.lit("src/x."), c("p_partkey").cast("string"), ext)).alias("language"))


@query("y02_file_provenance", f"""WITH {COMMITS_SQL}, {COMMIT_FILES_SQL}, h AS (SELECT DISTINCT path, sha, authored_at FROM commit_files JOIN commits USING (sha)), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY authored_at DESC, sha DESC) AS newest, row_number() OVER (PARTITION BY path ORDER BY authored_at, sha) AS oldest FROM h)
SELECT path, sha, CASE WHEN oldest = 1 THEN 'introduced' ELSE 'modified' END AS role FROM r WHERE newest <= 3 OR oldest = 1""")
def y02(t):
    """The three newest and the first commit of each file, from one bounded aggregate for each end instead of two sorts."""
    h = commit_files(t).select("path", "sha").distinct().join(commits(t).select("sha", "authored_at"), "sha")
    newest = ranked(h, ["path"], 3, F.desc("authored_at"), F.desc("sha")).select("path", "sha")
    first = h.groupBy("path").agg(F.min_by("sha", F.struct("authored_at", "sha")).alias("sha"))
    return first.select("path", "sha", F.lit("introduced").alias("role")).unionByName(newest.join(first, ["path", "sha"], "left_anti").withColumn("role", F.lit("modified")))


@query("y04_linked_records", "SELECT o_orderkey AS sha, c_custkey AS pr, event_id AS issue FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN events ON user_id = c_custkey AND event_type = 'error'")
def y04(t):
    pr = t.orders.join(t.customer, c("c_custkey") == c("o_custkey"))
    issues = t.events.filter("event_type = 'error'").select("user_id", "event_id")
    return pr.join(issues, c("user_id") == c("c_custkey"), "left").select(c("o_orderkey").alias("sha"), c("c_custkey").alias("pr"), c("event_id").alias("issue"))


@query("y06_commit_detail", "SELECT o_orderkey AS sha, o_orderpriority AS subject, l_partkey AS path, l_quantity AS insertions FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%'")
def y06(t):
    hit = t.orders.filter(c("o_orderkey").cast("string").startswith("12"))
    return hit.join(t.lineitem, c("l_orderkey") == c("o_orderkey")).select(c("o_orderkey").alias("sha"), c("o_orderpriority").alias("subject"), c("l_partkey").alias("path"), c("l_quantity").alias("insertions"))


@query("y09_stale_comments", "SELECT c_custkey, CASE WHEN latest IS NULL THEN 'never' WHEN latest > TIMESTAMP '1999-01-01' THEN 'stale' ELSE 'fresh' END AS state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def y09(t):
    latest = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    state = F.when(c("latest").isNull(), "never").when(c("latest") > F.lit("1999-01-01").cast("timestamp"), "stale").otherwise("fresh")
    return t.customer.join(latest, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", state.alias("state"))


@query("v06_dependents_split", f"WITH {DEPENDS_SQL} SELECT dst, count(*) FILTER (WHERE p_size % 10 <> 0) AS production, count(*) FILTER (WHERE p_size % 10 = 0) AS tests FROM depends JOIN part ON p_partkey = src GROUP BY dst")
def v06(t):
    return depends(t).join(t.part, c("p_partkey") == c("src")).groupBy("dst").agg(F.count_if(F.expr("p_size % 10 <> 0")).alias("production"), F.count_if(F.expr("p_size % 10 = 0")).alias("tests"))


@query("g09_cochange_top", f"""WITH {COMMIT_FILES_SQL}, f AS (SELECT DISTINCT sha, path FROM commit_files), s AS (SELECT * FROM f WHERE sha IN (SELECT sha FROM f GROUP BY sha HAVING count(*) <= 30)),
p AS (SELECT a.path, b.path AS other, count(*) AS together FROM s a JOIN s b USING (sha) WHERE a.path <> b.path GROUP BY 1, 2 HAVING count(*) >= 2) SELECT path, other, together FROM p QUALIFY row_number() OVER (PARTITION BY path ORDER BY together DESC, other) <= 8""")
def g09(t):
    return ranked(cochange(commit_files(t), 30), ["path"], 8, F.desc("together"), "other").select("path", "other", "together")


@query("g06_file_neighborhood", f"WITH {DEPENDS_SQL}, e AS (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM depends JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand) SELECT brand, (SELECT count(*) FROM e WHERE dst = brand) AS importers, (SELECT count(*) FROM e WHERE src = brand) AS imports FROM (SELECT DISTINCT p_brand AS brand FROM part)")
def g06(t):
    b = t.part.select("p_partkey", "p_brand")
    e = depends(t).join(b.toDF("src", "a"), "src").join(b.toDF("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct()
    out = t.part.select(c("p_brand").alias("brand")).distinct()
    for side, name in (("b", "importers"), ("a", "imports")):
        out = out.join(e.groupBy(c(side).alias("brand")).agg(F.count("*").alias(name)), "brand", "left")
    return out.fillna(0, ["importers", "imports"])


@query("r11_phrase_search", r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM documents), b AS (SELECT id, l[i] AS x, l[i + 1] AS y FROM (SELECT id, l, unnest(range(1, len(l))) AS i FROM w)),
v AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM benchmark), q AS (SELECT DISTINCT qid, l[i] AS x, l[i + 1] AS y FROM (SELECT qid, l, unnest(range(1, len(l))) AS i FROM v))
SELECT qid, id, count(*) AS n FROM q JOIN b USING (x, y) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, id) <= 15""")
def r11(t):
    """Documents in which two terms that a question has side by side stand so too, most occurrences first."""
    b, q = adjacent(t.documents, "doc_id").withColumnRenamed("doc_id", "id"), adjacent(t.benchmark, "item_id").withColumnRenamed("item_id", "qid").distinct()
    return ranked(b.join(q, ["x", "y"]).groupBy("qid", "id").agg(F.count("*").alias("n")), ["qid"], 15, F.desc("n"), "id").select("qid", "id", "n")
