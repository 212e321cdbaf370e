"""What stands round a symbol: callers, callees, bases and subclasses, the packages that it uses, and the edges of history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.history import _LINKS_SQL, _links
from sedimenta.plans.projection import ALL_DEPENDS_SQL, depends
from sedimenta.plans.registry import query


def one_hop(e: DataFrame, is_test: DataFrame, near_ids: DataFrame, kind: str, reverse: bool, exclude: DataFrame, limit: int) -> DataFrame:
    """The best `limit` far ends (node, anchor, weight, confidence) of the edges of a kind at near_ids (node), without those in
    exclude (node): production code first, then confidence, weight and id. Both id frames hold a few columns' nodes."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    own = e.filter(F.col("kind") == kind).join(F.broadcast(near_ids.select(F.col("node").alias(near))), near, "left_semi")
    own = own.join(F.broadcast(exclude.select(F.col("node").alias(far))), far, "left_anti")
    best = F.max_by(near, F.struct("confidence", -F.col(near)))
    found = own.groupBy(F.col(far).alias("node")).agg(best.alias("anchor"), F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"))
    return found.join(is_test, "node").orderBy("is_test", F.desc("confidence"), F.desc("weight"), "node").limit(limit).drop("is_test")


def symbol_relations(e: DataFrame, is_test: DataFrame, target: int, per_column: int = 12, kin: int = 6) -> DataFrame:
    """(side, depth, relation, node, anchor, weight, confidence, stage) round the target: callers and callees up to two hops away,
    bases and subclasses one. A node that stands in a nearer column isn't in a farther one; columns hold `per_column` or
    `kin` nodes, so each but the last is read once and goes on as rows of the driver. e is (src, kind, dst, weight, confidence)."""
    start = e.sparkSession.createDataFrame([(target,)], "node long")
    ids = lambda *frames: reduce(DataFrame.unionByName, [f.select("node") for f in frames])
    fixed = lambda f: e.sparkSession.createDataFrame(f.collect(), f.schema)
    near = [fixed(one_hop(e, is_test, start, kind, back, start, n)) for kind, back, n in (("calls", True, per_column), ("inherits", True, kin), ("calls", False, per_column), ("inherits", False, kin))]
    callers, _, callees, _ = near
    shown = ids(start, *near)
    callers2 = fixed(one_hop(e, is_test, callers, "calls", True, shown, per_column))
    callees2 = one_hop(e, is_test, callees, "calls", False, ids(shown, callers2), per_column)
    names = (("in", 1, "caller"), ("in", 1, "subclass"), ("out", 1, "callee"), ("out", 1, "base"), ("in", 2, "caller"), ("out", 2, "callee"))
    out = [f.select(F.lit(side).alias("side"), F.lit(depth).alias("depth"), F.lit(name).alias("relation"), "node", "anchor", "weight", "confidence", F.lit(k).alias("stage")) for k, (f, (side, depth, name)) in enumerate(zip([*near, callers2, callees2], names))]
    return reduce(DataFrame.unionByName, out)


def assemble(relations: DataFrame, target: int) -> DataFrame:
    """(part, src, dst, relation, side, depth) of a drawing: one "node" row for the target and for each node, at the first column
    that holds it, and one "edge" row for each relation, between the node and its anchor in the edge's own direction."""
    first = F.min_by(F.struct("relation", "side", "depth"), "stage")
    none = F.lit(None).cast("long").alias("dst")
    nodes = relations.groupBy("node").agg(first.alias("f")).select(F.lit("node").alias("part"), F.col("node").alias("src"), none, "f.relation", "f.side", "f.depth")
    own = relations.sparkSession.createDataFrame([("node", target, None, None, "target", 0)], "part string, src long, dst long, relation string, side string, depth int")
    into = F.col("side") == "in"
    edges = relations.select(F.lit("edge").alias("part"), F.when(into, F.col("node")).otherwise(F.col("anchor")).alias("src"), F.when(into, F.col("anchor")).otherwise(F.col("node")).alias("dst"), "relation", "side", "depth")
    return own.unionByName(nodes).unionByName(edges)


def packages_used(symbols: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """(symbol, package, stdlib): the packages that a symbol's file imports and whose bound names stand in the symbol's lines as
    words of their own, not after a dot. symbols (symbol, file, start_line, end_line), files (file, text), imports (file, package,
    stdlib, bound); each text is cut to the symbol's lines before any import is looked at."""
    cut = F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    code = symbols.join(files, "file").select("symbol", "file", F.array_join(cut, "\n").alias("code"))
    of_file = imports.groupBy("file").agg(F.collect_set(F.struct("package", "stdlib", "bound")).alias("imports"))
    named = lambda n: F.regexp_like(F.col("code"), F.concat(F.lit(r"(?U)(?<![\w.])\Q"), n, F.lit(r"\E\b")))
    used = F.filter("imports", lambda i: F.exists(i["bound"], lambda n: (n != "") & named(n)))
    return code.join(of_file, "file").select("symbol", F.explode(used).alias("u")).select("symbol", "u.package", "u.stdlib")


def history_edges(commits: DataFrame, changes: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """(src_kind, src, kind, dst_kind, dst, weight) of the graph's history: commits (sha, email, name) give authored edges, changes
    (sha, path, insertions, deletions) of known files modifies edges with their churn (1 at least), and links (src_kind, src,
    kind, dst_kind, dst) of known commits stand as they are."""
    text = lambda name, to: F.col(name).cast("string").alias(to)
    who = F.lower(F.coalesce(F.nullif("email", F.lit("")), F.nullif("name", F.lit("")), F.lit("unknown")))
    one, c = F.lit(1).cast("long").alias("weight"), F.lit("commit")
    authored = commits.select(F.lit("author").alias("src_kind"), who.alias("src"), F.lit("authored").alias("kind"), c.alias("dst_kind"), text("sha", "dst"), one)
    churn = F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    known = changes.join(files.select("path").distinct(), "path", "left_semi")
    weight = F.when(churn == 0, 1).otherwise(churn).cast("long")
    modifies = known.select(c.alias("src_kind"), text("sha", "src"), F.lit("modifies").alias("kind"), F.lit("file").alias("dst_kind"), text("path", "dst"), weight.alias("weight"))
    own = commits.select(c.alias("src_kind"), text("sha", "src")).distinct()
    kept = links.filter("src_kind <> 'commit'").unionByName(links.join(own, ["src_kind", "src"], "left_semi"))
    return authored.unionByName(modifies).unionByName(kept.select("src_kind", "src", "kind", "dst_kind", "dst", one))


def _column(name: str, near: str, far: str, kind: str, ids: str, shown: str, n: int) -> str:
    return f"""{name} AS (SELECT {far} AS node, (array_agg({near} ORDER BY confidence DESC, {near}))[1] AS anchor, sum(weight) AS weight, max(confidence) AS confidence FROM e JOIN part ON p_partkey = {far}
WHERE kind = '{kind}' AND {near} IN ({ids}) AND {far} NOT IN ({shown}) GROUP BY {far}, p_size ORDER BY p_size % 10 = 0, max(confidence) DESC, sum(weight) DESC, {far} LIMIT {n})"""


_SHOWN = "SELECT 1 UNION ALL " + " UNION ALL ".join(f"SELECT node FROM {x}" for x in ("c1", "s1", "k1", "b1"))
_RELATIONS_SQL = ",\n".join([
    f"WITH {ALL_DEPENDS_SQL}, e AS (SELECT *, CASE WHEN (src + dst) % 5 = 0 THEN 'inherits' ELSE 'calls' END AS kind FROM depends)",
    _column("c1", "dst", "src", "calls", "1", "1", 12), _column("s1", "dst", "src", "inherits", "1", "1", 6),
    _column("k1", "src", "dst", "calls", "1", "1", 12), _column("b1", "src", "dst", "inherits", "1", "1", 6),
    _column("c2", "dst", "src", "calls", "SELECT node FROM c1", _SHOWN, 12),
    _column("k2", "src", "dst", "calls", "SELECT node FROM k1", _SHOWN + " UNION ALL SELECT node FROM c2", 12),
    "rels AS (" + " UNION ALL ".join(f"SELECT '{side}' AS side, {depth} AS depth, '{name}' AS relation, node, anchor, weight, confidence, {k} AS stage FROM {x}" for k, (x, side, depth, name) in enumerate((("c1", "in", 1, "caller"), ("s1", "in", 1, "subclass"), ("k1", "out", 1, "callee"), ("b1", "out", 1, "base"), ("c2", "in", 2, "caller"), ("k2", "out", 2, "callee")))) + ")",
])


def _relations(t):
    t = type(t)(t.spark, t.folder, floor=None)
    e = depends(t).withColumn("kind", F.when((F.col("src") + F.col("dst")) % 5 == 0, "inherits").otherwise("calls"))
    return symbol_relations(e, t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 10 == 0).alias("is_test")), 1)


@query("g05_symbol_neighborhood", f"{_RELATIONS_SQL} SELECT side, depth, relation, node, anchor, weight, confidence FROM rels")
def g05(t):
    return _relations(t).drop("stage")


@query("g15_neighborhood_assembly", f"""{_RELATIONS_SQL} SELECT 'node' AS part, 1 AS src, NULL AS dst, NULL AS relation, 'target' AS side, 0 AS depth
UNION ALL (SELECT DISTINCT ON (node) 'node', node, NULL, relation, side, depth FROM rels ORDER BY node, stage)
UNION ALL SELECT 'edge', CASE side WHEN 'in' THEN node ELSE anchor END, CASE side WHEN 'in' THEN anchor ELSE node END, relation, side, depth FROM rels""")
def g15(t):
    return assemble(_relations(t), 1)


@query("g11_packages_used", r"""WITH s AS (SELECT doc_id AS symbol, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS code, text FROM documents),
i AS (SELECT symbol, code, 'first' AS package, false AS stdlib, regexp_extract(text, '[a-z]+') AS bound FROM s UNION ALL SELECT symbol, code, 'long', true, regexp_extract(text, '[a-z]{9,}') FROM s)
SELECT symbol, package, stdlib FROM i WHERE bound <> '' AND regexp_matches(code, '(^|[^\p{L}\p{N}_.])' || bound || '([^\p{L}\p{N}_]|$)')""")
def g11(t):
    d = t.documents.select(F.col("doc_id").alias("file"), "text")
    symbols = d.select(F.col("file").alias("symbol"), "file", F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    bound = lambda p: F.array(F.regexp_extract("text", p, 0)).alias("bound")
    imports = d.select("file", F.lit("first").alias("package"), F.lit(False).alias("stdlib"), bound("[a-z]+")).unionByName(d.select("file", F.lit("long").alias("package"), F.lit(True).alias("stdlib"), bound("[a-z]{9,}")))
    return packages_used(symbols, d, imports)


@query("g23_history_edges", f"""WITH {_LINKS_SQL} SELECT 'author' AS src_kind, lower(o_orderpriority) AS src, 'authored' AS kind, 'commit' AS dst_kind, o_orderkey::VARCHAR AS dst, 1 AS weight FROM orders
UNION ALL SELECT 'commit', l_orderkey::VARCHAR, 'modifies', 'file', l_partkey::VARCHAR, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_quantity::BIGINT + l_linenumber END FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT 'commit', sha::VARCHAR, 'merged_in', 'pull_request', pull::VARCHAR, 1 FROM commit_pulls UNION ALL SELECT 'pull_request', pull::VARCHAR, kind, 'issue', issue::VARCHAR, 1 FROM pull_issues""")
def g23(t):
    pulls, issues = _links(t)
    text = lambda name, to: F.col(name).cast("string").alias(to)
    row = lambda a, src, kind, b, dst: [F.lit(a).alias("src_kind"), text(src, "src"), kind.alias("kind"), F.lit(b).alias("dst_kind"), text(dst, "dst")]
    links = pulls.select(*row("commit", "sha", F.lit("merged_in"), "pull_request", "pull")).unionByName(issues.select(*row("pull_request", "pull", F.col("kind"), "issue", "issue")))
    commits = t.orders.select(F.col("o_orderkey").alias("sha"), F.lit("").alias("email"), F.col("o_orderpriority").alias("name"))
    first = F.col("l_linenumber") == 1
    changes = t.lineitem.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.when(~first, F.col("l_quantity").cast("long")).alias("insertions"), F.when(~first, F.col("l_linenumber")).alias("deletions"))
    return history_edges(commits, changes, t.part.filter("p_size > 5").select(F.col("p_partkey").alias("path")), links)
