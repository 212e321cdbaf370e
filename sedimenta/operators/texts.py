"""Queries of the text functions, chunking and references over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import text as X
from sedimenta.plans.registry import query

c = F.col
# The words that questions don't search for, once more for the SQL.
_STOP = """a an and are as at be but by can could did do does for from had has have how i if in
into is it its me my of on or our should so that the their them then there these this
those to was we were what when where which who whom why will with would you your
code function file files repo repository used use uses using does doing exist exists
introduced introduce change changed changes please explain tell show way work works
implemented implement written write happen happens affect affected"""


STOP_SQL = ", ".join(f"'{w}'" for w in _STOP.split())


@query("x04_query_terms", r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS n FROM benchmark), e AS (SELECT item_id, unnest(n) AS n, generate_subscripts(n, 1) AS i FROM w),
p AS (SELECT item_id, i, 0 AS j, lower(n) AS x FROM e UNION ALL SELECT item_id, i, generate_subscripts(q, 1) AS j, lower(unnest(q)) AS x FROM (SELECT item_id, i, regexp_extract_all(n, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') AS q FROM e)),
g AS (SELECT item_id, x, min(i * 1000 + j) AS o FROM p WHERE length(x) >= 2 AND regexp_matches(x, '[a-z0-9]') AND x NOT IN (""" + STOP_SQL + r""") GROUP BY 1, 2)
SELECT item_id, array_to_string(list_slice(array_agg(x ORDER BY o), 1, 24), ' ') AS terms FROM g GROUP BY 1""")
def x04(t):
    return t.benchmark.select("item_id", F.array_join(X.query_terms(c("text")), " ").alias("terms"))


def _stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {len(s) + 4} THEN left({w}, length({w}) - {len(s)})" for s in ("ations", "ation", "ings", "ing", "ers", "ies", "er", "es", "ed", "s")) + f" ELSE {w} END"


@query("x05_word_stem", f"WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS w FROM part UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) SELECT w, {_stem_sql('w')} AS stem FROM w")
def x05(t):
    words = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).union(t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))).distinct()
    return words.select("w", X.word_stem(c("w")).alias("stem"))


@query("x01_split_identifier", r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all('get' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || '_' || replace(p_name, ' ', '_') || p_size, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), ' ') AS parts FROM part""")
def x01(t):
    name = F.concat(F.lit("get"), F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring(c("p_type"), 2, 100)), F.lit("_"), F.translate("p_name", " ", "_"), c("p_size").cast("string"))
    return t.part.select("p_partkey", F.array_join(X.split_identifier(name), " ").alias("parts"))


@query("x07_last_segment", r"SELECT c_custkey, regexp_replace('pkg.' || c_mktsegment || '::' || c_name, '^.*[.:]', '') AS short FROM customer")
def x07(t):
    return t.customer.select("c_custkey", X.last_segment(F.concat(F.lit("pkg."), "c_mktsegment", F.lit("::"), "c_name")).alias("short"))


@query("x14_title", r"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations) SELECT conv_id, turn, CASE WHEN length(s) > 90 THEN rtrim(substr(s, 1, 87)) || '…' ELSE s END AS title FROM f""")
def x14(t):
    return t.conversations.select("conv_id", "turn", X.title(c("text")).alias("title"))


@query("x15_strip_citations", r"SELECT conv_id, turn, regexp_replace('a [S' || turn || '] b [S12] [X1]', '\[S\d+\]', '', 'g') AS text FROM conversations")
def x15(t):
    return t.conversations.select("conv_id", "turn", X.strip_citations(F.concat(F.lit("a [S"), c("turn").cast("string"), F.lit("] b [S12] [X1]"))).alias("text"))


_SUBJECT = "CASE o_orderkey % 3 WHEN 0 THEN 'Merge pull request #' || o_orderkey || ' from x' WHEN 1 THEN 'Change it (#' || o_orderkey || ')' ELSE 'Fix #' || o_orderkey || ' in worker' END"


def _subject():
    k = c("o_orderkey").cast("string")
    return F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("Merge pull request #"), k, F.lit(" from x"))).when(c("o_orderkey") % 3 == 1, F.concat(F.lit("Change it (#"), k, F.lit(")"))).otherwise(F.concat(F.lit("Fix #"), k, F.lit(" in worker")))


@query("x16_pr_number", rf"""SELECT o_orderkey, CAST(coalesce(nullif(regexp_extract(s, '^Merge pull request #(\d+)', 1), ''), nullif(regexp_extract(s, '\(#(\d+)\)\s*$', 1), '')) AS INTEGER) AS pr FROM (SELECT o_orderkey, {_SUBJECT} AS s FROM orders)""")
def x16(t):
    return t.orders.select("o_orderkey", X.pr_number(_subject()).alias("pr"))


@query("x17_references", r"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Fixes #' || l_partkey || ', see #' || l_suppkey || ' and org/repo#7 &#8; closes: #' || l_linenumber || ' x#9' AS s FROM lineitem),
r AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(s, '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+(?:[\w.-]+/[\w.-]+)?#(\d+)', 1), lambda x: CAST(x AS INTEGER)))) AS f,
list_distinct(list_transform(regexp_extract_all(s, '(?:^|[^\w/&])#(\d+)', 1), lambda x: CAST(x AS INTEGER))) AS m FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(f, ',') AS fixes, array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains(f, x))), ',') AS mentions FROM r""")
def x17(t):
    s = F.concat(F.lit("Fixes #"), c("l_partkey").cast("string"), F.lit(", see #"), c("l_suppkey").cast("string"), F.lit(" and org/repo#7 &#8; closes: #"), c("l_linenumber").cast("string"), F.lit(" x#9"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(X.fixes(s), ",").alias("fixes"), F.array_join(X.mentions(s), ",").alias("mentions"))


@query("x18_clean_body", r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '^\s+|\s+$', '', 'g')) AS n FROM pages")
def x18(t):
    return t.pages.select("page_id", F.length(X.clean_body(c("html"))).alias("n"))


@query("x22_hashes", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def x22(t):
    return t.documents.select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("x23_embedding_text", "SELECT p_partkey, 'File: ' || p_brand || '/' || p_name || chr(10) || 'Language: ' || p_type || chr(10) || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ': ' || p_name || chr(10) || p_size AS text FROM part")
def x23(t):
    return t.part.select("p_partkey", X.embedding_text(F.concat_ws("/", "p_brand", "p_name"), c("p_type"), c("p_type"), c("p_name"), c("p_size").cast("string")).alias("text"))


@query("x25_import_key", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN lower(regexp_replace(n, '[-_.]+', '_', 'g')) WHEN p_size % 3 = 1 THEN replace(n, '-', '_') ELSE n END AS key FROM (SELECT *, p_brand || '.-' || replace(p_name, ' ', '-') AS n FROM part)")
def x25(t):
    eco = F.when(c("p_size") % 3 == 0, "pypi").when(c("p_size") % 3 == 1, "cargo").otherwise("npm")
    return t.part.select("p_partkey", X.import_key(eco, F.concat("p_brand", F.lit(".-"), F.translate("p_name", " ", "-"))).alias("key"))


_PATH = "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '/' || p_name ELSE p_brand || '/' || p_type || '/x/' || p_name END"


@query("x13_directory_group", rf"SELECT p_partkey, CASE WHEN d = '' THEN '.' ELSE array_to_string(list_slice(string_split(d, '/'), 1, 2), '/') END AS grp FROM (SELECT p_partkey, regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) AS d FROM part)")
def x13(t):
    m = c("p_size") % 4
    path = F.when(m == 0, c("p_name")).when(m == 1, F.concat_ws("/", "p_brand", "p_name")).otherwise(F.concat_ws("/", "p_brand", "p_type", F.lit("x"), "p_name"))
    return t.part.select("p_partkey", X.directory_group(path, 2).alias("grp"))


@query("f05_test_path", r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 6 THEN 'testing/a.py' WHEN 7 THEN 'a/b.test.css' WHEN 8 THEN 'a/b.spec.mts' WHEN 0 THEN 'pkg/tests/' || p_partkey || '.py' WHEN 1 THEN 'a/test_' || p_partkey WHEN 2 THEN 'b/x_test.go' WHEN 3 THEN 'b/latest/x.go' WHEN 4 THEN 'c/FooTest.java' ELSE 'c/attest_x.py' END AS path FROM part)
SELECT p_partkey, regexp_matches(path, '(^|/)(tests?|__tests__|spec|specs|testing)(/|$)|(^|/)test_[^/]*$|_test\.\w+$|\.(test|spec)\.[cm]?[jt]sx?$|Tests?\.\w+$') AS is_test FROM p""")
def f05(t):
    k = c("p_partkey")
    s = k.cast("string")
    path = F.when(k % 9 == 6, "testing/a.py").when(k % 9 == 7, "a/b.test.css").when(k % 9 == 8, "a/b.spec.mts").when(k % 9 == 0, F.concat(F.lit("pkg/tests/"), s, F.lit(".py"))).when(k % 9 == 1, F.concat(F.lit("a/test_"), s)).when(k % 9 == 2, "b/x_test.go").when(k % 9 == 3, "b/latest/x.go").when(k % 9 == 4, "c/FooTest.java").otherwise("c/attest_x.py")
    return t.part.select("p_partkey", X.is_test_path(path).alias("is_test"))


@query("x33_line_count", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents")
def x33(t):
    return t.documents.select("doc_id", X.line_count(c("text")).alias("n"))


@query("x29_iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def x29(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


_DIFF = "'diff a' || chr(10) || '--- a' || chr(10) || '+++ b' || chr(10) || '@@ -1 +' || l_orderkey || ',' || l_linenumber || ' @@' || chr(10) || repeat('+x' || chr(10), l_linenumber) || '-y' || chr(10) || '@@ -9,2 +' || (l_orderkey + 50) || ' @@'"


def _diff():
    s = lambda k: c(k).cast("string")
    return F.concat(F.lit("diff a\n--- a\n+++ b\n@@ -1 +"), s("l_orderkey"), F.lit(","), s("l_linenumber"), F.lit(" @@\n"), F.repeat(F.lit("+x\n"), c("l_linenumber")), F.lit("-y\n@@ -9,2 +"), (c("l_orderkey") + 50).cast("string"), F.lit(" @@"))


@query("a18_diff_stats", f"SELECT l_orderkey, l_partkey, l_suppkey, len(list_filter(d, lambda x: x LIKE '+%' AND NOT x LIKE '+++%')) AS added, len(list_filter(d, lambda x: x LIKE '-%' AND NOT x LIKE '---%')) AS removed FROM (SELECT *, string_split({_DIFF}, chr(10)) AS d FROM lineitem)")
def a18(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", X.diff_counts(_diff()).alias("d")).select("l_orderkey", "l_partkey", "l_suppkey", c("d.added").cast("long").alias("added"), c("d.removed").cast("long").alias("removed"))


@query("x20_hunk_span", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_orderkey AS INTEGER) AS start, CAST(greatest(l_orderkey + l_linenumber - 1, l_orderkey + 50) AS INTEGER) AS stop FROM lineitem")
def x20(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", X.hunk_span(_diff()).alias("h")).select("l_orderkey", "l_partkey", "l_suppkey", c("h.start"), c("h.end").alias("stop"))


@query("x19_trim_diff", f"""WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, list_filter(string_split({_DIFF}, chr(10)), lambda x: NOT (starts_with(x, 'diff --git') OR starts_with(x, '--- ') OR starts_with(x, '+++ '))) AS d FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, array_to_string(list_slice(d, 1, 4), chr(10)) || CASE WHEN len(d) > 4 THEN chr(10) || '… (' || (len(d) - 4) || ' more diff lines)' ELSE '' END AS text FROM k""")
def x19(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", X.trim_diff(_diff(), 4).alias("text"))


@query("v09_cited_sources", r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('x [S' || turn % 4 || '] y [S2]', '\[S(\d+)\]', 1), lambda x: CAST(x AS INTEGER)))), ',') AS cited FROM conversations")
def v09(t):
    s = F.concat(F.lit("x [S"), (c("turn") % 4).cast("string"), F.lit("] y [S2]"))
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(X.cited(s)), ",").alias("cited"))


def windows(lines, size: int = 60, overlap: int = 10):
    """(start, end, content) of sliding line windows, blank ones left out, ending with the last line."""
    n = F.size(lines)
    firsts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size - overlap)), lambda s: (s == 1) | (s + overlap <= n))
    cut = F.transform(firsts, lambda s: F.struct(s.cast("long").alias("start"), F.least(s + size - 1, n).cast("long").alias("end"), F.array_join(F.slice(lines, s, size), "\n").alias("content")))
    return F.filter(cut, lambda w: F.trim(F.regexp_replace(w["content"], r"\s", "")) != "")


@query("c04_line_windows", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, l, unnest(range(1, len(l) + 1, 6)) AS s FROM l)
SELECT doc_id, s AS start, least(s + 7, len(l)) AS stop, sha256(array_to_string(list_slice(l, s, s + 7), chr(10))) AS digest FROM s WHERE (s = 1 OR s + 2 <= len(l)) AND regexp_replace(array_to_string(list_slice(l, s, s + 7), chr(10)), '\s', '', 'g') <> ''""")
def c04(t):
    w = t.documents.select("doc_id", F.explode(windows(F.split("text", "\n"), 8, 2)).alias("w"))
    return w.select("doc_id", c("w.start"), c("w.end").alias("stop"), F.sha2("w.content", 256).alias("digest"))


@query("c03_markdown_sections", r"""WITH s AS (SELECT doc_id, string_split(x, chr(10)) AS l FROM (SELECT doc_id, '# Top ' || doc_id || chr(10) || 'intro' || chr(10) || '```' || chr(10) || '# not a title' || chr(10) || '```' || chr(10) || '## Sub' || chr(10) || 'n ' || n_chars AS x FROM documents)),
p AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s), f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fence FROM p),
h AS (SELECT *, sum(CASE WHEN line LIKE '#%' AND fence % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM f)
SELECT doc_id, sec, min(i) AS start, max(i) AS stop, trim(regexp_replace((array_agg(line ORDER BY i))[1], '^#+', '')) AS title FROM h GROUP BY doc_id, sec""")
def c03(t):
    s = F.concat(F.lit("# Top "), c("doc_id").cast("string"), F.lit("\nintro\n```\n# not a title\n```\n## Sub\nn "), c("n_chars").cast("string"))
    return markdown_sections(t.documents.select("doc_id", s.alias("text")), "doc_id", "text")


def markdown_sections(docs, id_col: str, text_col: str):
    """(id, sec, start, stop, title): sections at title lines outside code fences, folded along each text's own lines."""
    lines = F.split(text_col, "\n")
    zero = F.struct(F.lit(False).alias("code"), F.lit(0).alias("sec"), F.array().cast("array<struct<sec: int, i: int, line: string>>").alias("out"))

    def step(acc, x):
        fence = x["line"].rlike(r"^(```|~~~)")
        head = x["line"].startswith("#") & ~acc["code"] & ~fence
        sec = acc["sec"] + head.cast("int")
        row = F.struct(sec.alias("sec"), x["i"].alias("i"), x["line"].alias("line"))
        return F.struct((acc["code"] != fence).alias("code"), sec.alias("sec"), F.concat(acc["out"], F.array(row)).alias("out"))

    indexed = F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), x.alias("line")))
    rows = docs.select(id_col, F.explode(F.aggregate(indexed, zero, step, lambda a: a["out"])).alias("r"))
    g = rows.groupBy(id_col, "r.sec").agg(F.min("r.i").cast("long").alias("start"), F.max("r.i").cast("long").alias("stop"), F.min_by("r.line", "r.i").alias("line"))
    return g.select(id_col, c("sec").cast("decimal(38,0)").alias("sec"), "start", "stop", F.trim(F.regexp_replace("line", r"^#+", "")).alias("title"))


def terms_sql(key: str, table: str, text: str) -> str:
    """CTEs up to q (qid, root, is_prefix, o): terms of questions, their stems as prefixes."""
    return r"""w_ AS (SELECT KEY, regexp_extract_all(TEXT, '[A-Za-z_][A-Za-z0-9_]*') AS n FROM TABLE_), e_ AS (SELECT KEY, unnest(n) AS n, generate_subscripts(n, 1) AS i FROM w_),
p_ AS (SELECT KEY, i, 0 AS j, lower(n) AS x FROM e_ UNION ALL SELECT KEY, i, generate_subscripts(q, 1) AS j, lower(unnest(q)) AS x FROM (SELECT KEY, i, regexp_extract_all(n, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') AS q FROM e_)),
g_ AS (SELECT KEY, x, min(i * 1000 + j) AS o FROM p_ WHERE length(x) >= 2 AND regexp_matches(x, '[a-z0-9]') AND x NOT IN (STOP) GROUP BY 1, 2),
t_ AS (SELECT KEY, x, o FROM (SELECT *, row_number() OVER (PARTITION BY KEY ORDER BY o) AS k FROM g_) WHERE k <= 24),
q AS (SELECT KEY AS qid, CASE WHEN length(STEM) >= 4 THEN STEM ELSE x END AS root, length(STEM) >= 4 AS is_prefix, min(o) AS o FROM t_ GROUP BY 1, 2, 3)""".replace("KEY", key).replace("TEXT", text).replace("TABLE_", table).replace("STOP", STOP_SQL).replace("STEM", f"({_stem_sql('x')})")


@query("x06_lexical_query", f"WITH {terms_sql('item_id', 'benchmark', 'text')} SELECT qid AS item_id, string_agg(root || CASE WHEN is_prefix THEN ':*' ELSE '' END, ' | ' ORDER BY o) AS query FROM q GROUP BY 1")
def x06(t):
    return t.benchmark.select("item_id", X.lexical_query(c("text")).alias("query")).filter("query <> ''")


@query("v04_added_lines", f"SELECT l_orderkey, l_partkey, l_suppkey, array_to_string(list_transform(range(CAST(l_orderkey AS BIGINT), CAST(l_orderkey + l_linenumber AS BIGINT)), lambda x: CAST(x AS VARCHAR)), ',') AS lines FROM lineitem WHERE length({_DIFF}) > 0")
def v04(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.array_join(X.added_lines(_diff()), ",").alias("lines"))


@query("s18_unnest_list", "SELECT u AS term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS u FROM part) GROUP BY 1")
def s18(t):
    """An array parameter as rows, counted."""
    return t.part.select(F.explode(F.split("p_name", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
