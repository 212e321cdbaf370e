"""History of files and code ranges: timelines, versions, the lane from issue to file, related code and evidence text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import diff_counts, hunk_span
from sedimenta.plans.projection import COMMIT_FILES_SQL, COMMITS_SQL, DEPENDS_SQL, commit_files, commits, depends
from sedimenta.plans.registry import query

#: A file's history, a range's versions and their lines go so far.
FILE_HISTORY, VERSIONS, VERSION_LINES = 300, 40, 400


def linked(commit_pulls: DataFrame, pull_issues: DataFrame) -> DataFrame:
    """(sha, pulls, issues) of commit_pulls (sha, pull) and pull_issues (pull, kind, issue): a commit's pull requests once each,
    and their issues in that order, those it fixes first."""
    of_pull = pull_issues.groupBy("pull").agg(F.array_sort(F.collect_set(F.struct((F.col("kind") != "fixes").alias("later"), "issue", "kind"))).alias("issues"))
    both = commit_pulls.select("sha", "pull").distinct().join(of_pull, "pull", "left")
    by_sha = both.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("pull", F.coalesce("issues", F.array()).alias("issues")))).alias("l"))
    issues = F.transform(F.flatten(F.transform("l", lambda x: x["issues"])), lambda i: F.struct(i["kind"].alias("kind"), i["issue"].alias("issue")))
    return by_sha.select("sha", F.transform("l", lambda x: x["pull"]).alias("pulls"), issues.alias("issues"))


def timeline(touches: DataFrame, commit_pulls: DataFrame, pull_issues: DataFrame, most: int = FILE_HISTORY) -> DataFrame:
    """touches (path, sha, authored_at, ...), one row a path and commit, as the newest `most` commits of each path: place (1 is
    the newest), role ("introduced" for the oldest, unless the history may be cut), pulls and issues (null without links)."""
    new = Window.partitionBy("path").orderBy(F.desc("authored_at"), "sha")
    kept = touches.withColumn("place", F.row_number().over(new)).filter(F.col("place") <= most)
    n = F.count("*").over(Window.partitionBy("path"))
    role = F.when((F.col("place") == F.col("n")) & (F.col("n") < most), "introduced")
    return kept.withColumn("n", n).withColumn("role", role).drop("n").join(linked(commit_pulls, pull_issues), "sha", "left")


def evolution(changes: DataFrame, most: int = VERSIONS, lines: int = VERSION_LINES) -> DataFrame:
    """Versions of code ranges, oldest first: changes (key, at, diff, text, ...), `at` later for newer ones, text the file at that
    commit or null. Changes whose diff has no hunk are left out. Of more than `most`, the origin and the newest stay. Adds
    version, total, truncated, role ("introduced" for the origin), start_line and end_line, code, added, removed."""
    real = changes.filter(F.col("diff").rlike(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"))
    ends = real.groupBy("key").agg(F.count("*").alias("total"))
    ranked = real.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))).join(ends, "key")
    kept = ranked.filter((F.col("rank") < most) | (F.col("rank") == F.col("total")))
    span, counts = hunk_span(F.col("diff")), diff_counts(F.col("diff"))
    out = kept.withColumn("start_line", span["start"]).withColumn("end_line", span["end"]).withColumn("added", counts["added"]).withColumn("removed", counts["removed"])
    origin = F.col("rank") == F.col("total")
    out = out.withColumn("version", F.when(origin, 1).otherwise(F.least(F.col("total"), F.lit(most)) - F.col("rank") + 1).cast("long"))
    out = out.withColumn("truncated", F.col("total") > most).withColumn("role", F.when(origin, "introduced"))
    cut = F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    code = F.when(F.size(cut) > lines, F.concat(F.array_join(F.slice(cut, 1, lines), "\n"), F.lit("\n…"))).otherwise(F.array_join(cut, "\n"))
    return out.withColumn("code", F.when((F.col("text") != "") & (F.col("start_line") > 0), code)).drop("rank")


def history_lane(touches: DataFrame, commit_pulls: DataFrame, pull_issues: DataFrame, newest: int = 3, issues: int = 6) -> DataFrame:
    """Edges (path, kind, src, dst, via) from issue to file for each path of touches (path, sha, authored_at): the `newest` commits
    modify it and the oldest introduced it; their pull requests (kind merged_in); and at most `issues` links from those to
    issues, fixes first."""
    by = Window.partitionBy("path")
    ends = touches.groupBy("path").agg(F.count("*").alias("total"))
    ranked = touches.withColumn("place", F.row_number().over(by.orderBy(F.desc("authored_at"), "sha"))).join(ends, "path")
    via = F.when(F.col("place") == F.col("total"), "introduced").otherwise("modified")
    picks = ranked.filter((F.col("place") <= newest) | (F.col("place") == F.col("total"))).select("path", "sha", via.alias("via"))
    none = F.lit(None).cast("string").alias("via")
    text = lambda name: F.col(name).cast("string")
    pulls = picks.join(commit_pulls.select("sha", "pull").distinct(), "sha").select("path", "sha", "pull")
    links = pulls.select("path", "pull").distinct().join(pull_issues.select("pull", "kind", "issue").distinct(), "pull")
    place = F.row_number().over(by.orderBy(F.col("kind") != "fixes", "pull", "issue", "kind"))
    links = links.withColumn("place", place).filter(F.col("place") <= issues)
    out = picks.select("path", F.lit("modifies").alias("kind"), text("sha").alias("src"), text("path").alias("dst"), "via")
    out = out.unionByName(pulls.select("path", F.lit("merged_in").alias("kind"), text("sha").alias("src"), text("pull").alias("dst"), none))
    return out.unionByName(links.select("path", "kind", text("pull").alias("src"), text("issue").alias("dst"), none))


def related(e: DataFrame, is_test: DataFrame, limit: int = 6) -> DataFrame:
    """Code one hop from every node: e (src, kind, dst, weight, confidence) and is_test (node, is_test) as (node, place, relation,
    far). Callers, callees, bases and subclasses (three at most of the latter two), production code first, then confidence and
    weight, are dealt in turn until `limit` stand."""
    sides = []
    for kind, near, far, name, turn, n in (("calls", "dst", "src", "caller", 0, limit), ("calls", "src", "dst", "callee", 1, limit), ("inherits", "src", "dst", "base", 2, 3), ("inherits", "dst", "src", "subclass", 3, 3)):
        own = e.filter((F.col("kind") == kind) & (F.col("src") != F.col("dst")))
        sides.append(own.select(F.col(near).alias("node"), F.col(far).alias("far"), F.lit(name).alias("relation"), F.lit(turn).alias("turn"), F.lit(n).alias("n"), "weight", "confidence"))
    all_sides = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    best = all_sides.groupBy("node", "far", "relation", "turn", "n").agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"))
    best = best.join(is_test.select(F.col("node").alias("far"), "is_test"), "far")
    order = ("is_test", F.desc("confidence"), F.desc("weight"), "far")
    own = best.withColumn("rank", F.row_number().over(Window.partitionBy("node", "relation").orderBy(*order))).filter((F.col("rank") <= F.col("n")) & (F.col("rank") <= limit))
    place = F.row_number().over(Window.partitionBy("node").orderBy("rank", "turn"))
    return own.withColumn("place", place).filter(F.col("place") <= limit).select("node", "place", "relation", "far")


def attribute(value: Column) -> Column:
    """A value that may stand between double quotes."""
    return F.replace(value.cast("string"), F.lit('"'), F.lit("'"))


def evidence(sources: DataFrame, by: str, repo: Column, available: Column, focus: Column | None = None) -> DataFrame:
    """(by, evidence): the sources of each question as one text. sources has place (from 1), type, path, start_line, end_line,
    symbol_kind, symbol, relation and content; attributes without a value are left out. A question has the few sources
    that the budget let through, so its text is one row."""
    said = lambda name, value, when: F.when(when, F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")
    c = F.col
    lines = F.concat(c("start_line").cast("string"), F.lit("-"), F.coalesce(c("end_line"), c("start_line")).cast("string"))
    head = F.concat(
        F.lit('<source id="S'), c("place").cast("string"), F.lit('" type="'), c("type"), F.lit('"'),
        said("path", c("path"), c("path") != ""),
        said("lines", lines, c("start_line").isNotNull()),
        said("symbol", F.concat_ws(" ", "symbol_kind", "symbol"), c("type").isin("code", "doc") & (c("symbol") != "")),
        said("analysis", F.concat(F.lit("impact of "), attribute(c("symbol"))), (c("type") == "graph") & c("symbol").isNotNull()),
        said("relation", attribute(c("relation")), c("relation") != ""),
    )
    one = F.concat(head, F.lit(">\n"), F.coalesce("content", F.lit("")), F.lit("\n</source>"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("one")))), lambda x: x["one"])
    top = F.concat(F.lit('<repository name="'), repo, F.lit('" indexed_sources="'), available, F.lit('" />'))
    end = F.array(F.lit("</evidence>")) if focus is None else F.array(F.lit("</evidence>"), F.concat(F.lit("<selection>The developer has selected "), focus, F.lit("; the question is about it.</selection>")))
    return sources.groupBy(by).agg(F.array_join(F.concat(F.array(top, F.lit("<evidence>")), listed, end), "\n").alias("evidence"))


_LINKS_SQL = """commit_pulls AS (SELECT o_orderkey AS sha, o_custkey AS pull FROM orders UNION SELECT o_orderkey, o_custkey % 50 + 1 FROM orders WHERE o_orderstatus = 'F'),
pull_issues AS (SELECT c_custkey AS pull, CASE WHEN c_acctbal >= 0 THEN 'fixes' ELSE 'mentions' END AS kind, c_nationkey AS issue FROM customer
UNION ALL SELECT c_custkey, 'mentions', (c_nationkey + 7) % 25 FROM customer WHERE c_custkey % 3 = 0)"""
_TOUCHES_SQL = f"{COMMITS_SQL}, {COMMIT_FILES_SQL}, touches AS (SELECT path, sha, author, authored_at FROM (SELECT DISTINCT path, sha FROM commit_files) JOIN commits USING (sha))"


def _links(t):
    """Customers stand for pull requests, nations for issues."""
    o, c = t.orders, t.customer
    pulls = o.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("pull")).union(o.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey") % 50 + 1)).distinct()
    kind = F.when(F.col("c_acctbal") >= 0, "fixes").otherwise("mentions")
    issues = c.select(F.col("c_custkey").alias("pull"), kind.alias("kind"), F.col("c_nationkey").alias("issue"))
    return pulls, issues.union(c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("mentions"), (F.col("c_nationkey") + 7) % 25))


def _touches(t):
    return commit_files(t).select("path", "sha").distinct().join(commits(t).select("sha", "author", "authored_at"), "sha")


@query("y05_timeline", f"""WITH {_TOUCHES_SQL}, {_LINKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY authored_at DESC, sha) AS place, count(*) OVER (PARTITION BY path) AS n FROM touches),
p AS (SELECT sha, string_agg(pull::VARCHAR, ',' ORDER BY pull) AS pulls FROM commit_pulls GROUP BY sha),
i AS (SELECT sha, string_agg(kind || ' ' || issue, ',' ORDER BY pull, kind <> 'fixes', issue) AS issues FROM commit_pulls JOIN pull_issues USING (pull) GROUP BY sha)
SELECT path, sha, author, place, CASE WHEN place = n AND n < 300 THEN 'introduced' END AS role, pulls, coalesce(issues, '') AS issues FROM r LEFT JOIN p USING (sha) LEFT JOIN i USING (sha) WHERE place <= 300""")
def y05(t):
    issues = F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i["kind"], i["issue"].cast("string"))), ",")
    return timeline(_touches(t), *_links(t)).select("path", "sha", "author", "place", "role", F.array_join(F.col("pulls").cast("array<string>"), ",").alias("pulls"), issues.alias("issues"))


@query("y07_evolution", """WITH v AS (SELECT l_partkey AS key, l_orderkey, l_linenumber, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_suppkey DESC, l_extendedprice DESC) AS r, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem WHERE l_returnflag <> 'R'),
k AS (SELECT *, CASE WHEN r = total THEN 1 ELSE least(total, 40) - r + 1 END AS version FROM v WHERE r < 40 OR r = total)
SELECT key, l_orderkey, l_linenumber, version, total, total > 40 AS truncated, CASE WHEN r = total THEN 'introduced' END AS role, l_linenumber AS start_line, l_linenumber + q - 1 AS end_line, 2 AS added, 1 AS removed FROM k""")
def y07(t):
    c, text = F.col, lambda name: F.col(name).cast("long").cast("string")
    hunk = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1 +"), text("l_linenumber"), F.lit(","), text("l_quantity"), F.lit(" @@\n+new\n-old\n+more"))
    diff = F.when(c("l_returnflag") != "R", hunk).otherwise("merged")
    changes = t.lineitem.select(c("l_partkey").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice").alias("at"), "l_orderkey", "l_linenumber", diff.alias("diff"), F.lit(None).cast("string").alias("text"))
    return evolution(changes).select("key", "l_orderkey", "l_linenumber", "version", "total", "truncated", "role", "start_line", "end_line", "added", "removed")


@query("g12_history_lane", f"""WITH {_TOUCHES_SQL}, {_LINKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY authored_at DESC, sha) AS place, count(*) OVER (PARTITION BY path) AS n FROM touches),
k AS (SELECT path, sha, CASE WHEN place = n THEN 'introduced' ELSE 'modified' END AS via FROM r WHERE place <= 3 OR place = n),
p AS (SELECT path, sha, pull FROM k JOIN commit_pulls USING (sha)),
i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY kind <> 'fixes', pull, issue, kind) AS place FROM (SELECT DISTINCT path, pull, kind, issue FROM p JOIN pull_issues USING (pull)))
SELECT path, 'modifies' AS kind, sha::VARCHAR AS src, path::VARCHAR AS dst, via FROM k UNION ALL SELECT path, 'merged_in', sha::VARCHAR, pull::VARCHAR, NULL FROM p
UNION ALL SELECT path, kind, pull::VARCHAR, issue::VARCHAR, NULL FROM i WHERE place <= 6""")
def g12(t):
    return history_lane(_touches(t), *_links(t))


_ALL_STEPS_SQL = DEPENDS_SQL.replace(" AND confidence >= 0.985", "")


@query("g13_related_code", f"""WITH {_ALL_STEPS_SQL}, e AS (SELECT *, CASE WHEN (src + dst) % 5 = 0 THEN 'inherits' ELSE 'calls' END AS kind FROM depends),
s AS (SELECT dst AS node, src AS far, 'caller' AS relation, 0 AS turn, 6 AS n, weight, confidence FROM e WHERE kind = 'calls' UNION ALL SELECT src, dst, 'callee', 1, 6, weight, confidence FROM e WHERE kind = 'calls'
UNION ALL SELECT src, dst, 'base', 2, 3, weight, confidence FROM e WHERE kind = 'inherits' UNION ALL SELECT dst, src, 'subclass', 3, 3, weight, confidence FROM e WHERE kind = 'inherits'),
r AS (SELECT *, row_number() OVER (PARTITION BY node, relation ORDER BY p_size % 10 = 0, confidence DESC, weight DESC, far) AS rank FROM s JOIN part ON p_partkey = far)
SELECT node, place, relation, far FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank, turn) AS place FROM r WHERE rank <= n) WHERE place <= 6""")
def g13(t):
    t = type(t)(t.spark, t.folder, floor=None)
    e = depends(t).withColumn("kind", F.when((F.col("src") + F.col("dst")) % 5 == 0, "inherits").otherwise("calls"))
    return related(e, t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 10 == 0).alias("is_test")))


@query("n02_evidence", """SELECT conv_id, '<repository name="r" indexed_sources="code, issue" />' || chr(10) || '<evidence>' || chr(10) || string_agg('<source id="S' || (turn + 1) || '" type="' || CASE WHEN turn % 2 = 0 THEN 'code" path="a.py" lines="' || turn || '-' || (turn + 4) || '" symbol="function f"' ELSE 'graph" analysis="impact of f" relation="''q''"' END || '>' || chr(10) || coalesce(text, '') || chr(10) || '</source>', chr(10) ORDER BY turn) || chr(10) || '</evidence>' AS evidence FROM conversations GROUP BY conv_id""")
def n02(t):
    turn, odd = F.col("turn"), F.col("turn") % 2 != 0
    kind = F.when(odd, "graph").otherwise("code")
    s = t.conversations.select("conv_id", (turn + 1).alias("place"), kind.alias("type"), F.when(~odd, "a.py").alias("path"), F.when(~odd, turn).alias("start_line"), F.when(~odd, turn + 4).alias("end_line"), F.lit("function").alias("symbol_kind"), F.lit("f").alias("symbol"), F.when(odd, '"q"').alias("relation"), F.col("text").alias("content"))
    return evidence(s, "conv_id", F.lit("r"), F.lit("code, issue"))
