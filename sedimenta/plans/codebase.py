"""How the driver's star schema stands for the facts of a code base: files, definitions, imports, calls and base classes.

A part is a file, whose language and folder follow from its key; customers are classes, orders their methods, suppliers functions;
lineitem has the imports and calls. All frames are made of texts that Spark and the SQL read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.plans.registry import Tables


def language(k: str) -> str:
    return f"(CASE WHEN {k} % 5 < 2 THEN 'python' WHEN {k} % 5 = 2 THEN 'java' WHEN {k} % 5 = 3 THEN 'tsx' ELSE 'go' END)"


def path(k: str) -> str:
    """Path of the file of part k."""
    box = f"({k} - {k} % 10)"
    python = f"CASE WHEN {k} % 10 = 0 THEN concat('pkg', {k} % 7, '/sub', {k} % 3, '/box', {k}, '/__init__.py') WHEN {k} % 10 = 5 THEN concat('pkg', {box} % 7, '/sub', {box} % 3, '/box', {box}, '/m', {k}, '.py') ELSE concat('pkg', {k} % 7, '/sub', {k} % 3, '/m', {k}, '.py') END"
    tsx = f"CASE WHEN {k} % 2 = 0 THEN concat('web/src/d', {k} % 7, '/c', {k}, '/index.tsx') ELSE concat('web/src/d', {k} % 7, '/c', {k}, '.tsx') END"
    return f"(CASE WHEN {k} % 5 < 2 THEN {python} WHEN {k} % 5 = 2 THEN concat('java/org/d', {k} % 7, '/T', {k}, '.java') WHEN {k} % 5 = 3 THEN {tsx} ELSE concat('svc/g', {k} % 7, '/f', {k}, '.go') END)"


FILES = ("part", [f"{path('p_partkey')} AS path", f"{language('p_partkey')} AS language"])
#: The part that an import aims at: of the same language and folder, or none.
_TO = "aim"
_AIM = "l_partkey + 35 * (l_suppkey % 7 - 3) AS aim"
_MODULE = f"""(CASE
WHEN l_partkey % 5 < 2 AND l_linenumber % 4 = 0 THEN concat('pkg', {_TO} % 7, '.sub', {_TO} % 3, '.m', {_TO})
WHEN l_partkey % 5 < 2 AND l_linenumber % 4 = 1 THEN concat('sub', ({_TO} - {_TO} % 10) % 3, '.box', {_TO} - {_TO} % 10)
WHEN l_partkey % 5 < 2 AND l_linenumber % 4 = 2 THEN concat('sub', {_TO} % 3, '.m', {_TO})
WHEN l_partkey % 5 < 2 THEN 'json.decoder'
WHEN l_partkey % 5 = 2 AND l_linenumber % 3 = 0 THEN concat('org.d', {_TO} % 7, '.T', {_TO})
WHEN l_partkey % 5 = 2 AND l_linenumber % 3 = 1 THEN concat('app.org.d', {_TO} % 7, '.T', {_TO}, '.member')
WHEN l_partkey % 5 = 2 THEN 'com.acme.Thing'
WHEN l_partkey % 5 = 3 AND l_linenumber % 3 = 0 THEN concat('@/d', {_TO} % 7, '/c', {_TO})
WHEN l_partkey % 5 = 3 AND l_linenumber % 3 = 1 THEN concat('../d', {_TO} % 7, '/c', {_TO})
WHEN l_partkey % 5 = 3 THEN '@scope/pkg/deep'
WHEN l_linenumber % 2 = 0 THEN concat('example.org/svc/g', l_suppkey % 9) ELSE 'github.com/x/y' END)"""
_NAME = f"(CASE WHEN l_linenumber = 7 THEN '*' WHEN l_partkey % 5 < 2 AND l_linenumber % 4 = 1 THEN concat('m', {_TO} - {_TO} % 10 + 5) ELSE concat('Type', l_suppkey % 90) END)"
IMPORTS = ("lineitem", ["concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey, '/', CAST(l_quantity AS INT)) AS imp", f"{path('l_partkey')} AS path", f"{language('l_partkey')} AS language", "l_linenumber AS line", f"{_MODULE} AS module", f"{_NAME} AS name", "CASE WHEN l_partkey % 5 < 2 AND l_linenumber % 4 = 2 THEN 2 ELSE 0 END AS level"])
CLASSES = ("customer", [f"{path('c_custkey')} AS path", f"{language('c_custkey')} AS language", "concat('Type', c_custkey % 90) AS name", "'class' AS kind", "CAST(NULL AS STRING) AS parent", "10 AS a", "200 AS b"])
_STEP = "(CASE WHEN o_orderkey % 50 = 0 THEN concat('solo', o_orderkey) ELSE concat('step', o_orderkey % 400) END)"
METHODS = ("orders", [f"{path('o_custkey')} AS path", f"{language('o_custkey')} AS language", f"concat('Type', o_custkey % 90, '.', {_STEP}) AS name", "'method' AS kind", "concat('Type', o_custkey % 90) AS parent", "CAST(11 + o_orderkey % 90 * 2 AS INT) AS a", "CAST(12 + o_orderkey % 90 * 2 AS INT) AS b"])
FUNCTIONS = ("supplier", [f"{path('s_suppkey')} AS path", f"{language('s_suppkey')} AS language", "concat('make', s_suppkey % 60) AS name", "'function' AS kind", "CAST(NULL AS STRING) AS parent", "201 AS a", "220 AS b"])
RUNS = ("part", [f"{path('p_partkey')} AS path", f"{language('p_partkey')} AS language", "concat('launch', p_partkey % 500) AS name", "'function' AS kind", "CAST(NULL AS STRING) AS parent", "221 AS a", "230 AS b"])
BASES = ("customer", [f"{path('c_custkey')} AS path", "10 AS class_line", "concat('Type', (c_custkey * 7 + 1) % 90) AS name", "10 AS line"])
_CALL = """(CASE l_orderkey % 8 WHEN 0 THEN concat('Type', (l_orderkey % 100 + 1) % 90) WHEN 1 THEN concat('make', l_suppkey % 60) WHEN 2 THEN concat('launch', l_suppkey % 500)
WHEN 4 THEN concat('make', l_suppkey % 60) WHEN 7 THEN concat('solo', l_orderkey - l_orderkey % 50) ELSE concat('step', l_orderkey % 400) END)"""
_RECEIVER = """(CASE l_orderkey % 8 WHEN 3 THEN CASE WHEN l_linenumber % 3 = 0 THEN 'super' ELSE 'self' END WHEN 4 THEN concat('mod', l_suppkey % 30) WHEN 5 THEN concat('ns.Type', l_suppkey % 90) WHEN 6 THEN concat('self._type_', l_suppkey % 90) WHEN 7 THEN 'x' END)"""
DECLARED = ("supplier", ["s_suppkey AS seq", "CASE WHEN s_suppkey % 3 = 0 THEN 'pypi' WHEN s_suppkey % 3 = 1 THEN 'npm' ELSE 'go' END AS ecosystem", "CASE WHEN s_suppkey % 3 = 0 THEN concat('Pkg', s_suppkey % 9) WHEN s_suppkey % 3 = 1 THEN CASE WHEN s_suppkey = 4 THEN '@scope/pkg' ELSE concat('left-pad', s_suppkey) END WHEN s_suppkey = 5 THEN 'github.com/x' WHEN s_suppkey = 8 THEN 'github.com/x/y' ELSE concat('gopkg.in/m', s_suppkey) END AS name"])
CALLS = ("lineitem", [f"{path('l_partkey')} AS path", "CAST(10 + l_orderkey % 225 AS INT) AS line", f"{_CALL} AS name", f"{_RECEIVER} AS receiver"])
#: Names that files pass on: an order's first line imports from the class's file, each next line from the file of the line before; the
#: first import of a name in a file counts.
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_LINK = [f"{path('l_partkey')} AS path", "concat('Type', (l_orderkey % 100 + 1) % 90) AS local", "l_orderkey * 10 + l_linenumber AS seq", f"coalesce(lag({path('l_partkey')}) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}), {path('(l_orderkey % 100 + 1)')}) AS target"]
LINKS_SQL = f"links AS (SELECT path, local, min(seq) AS seq, min_by(target, struct_pack(a := seq, b := target)) AS target, local AS orig FROM (SELECT {', '.join(_LINK)} FROM lineitem WHERE l_orderkey % 3 = 0) GROUP BY path, local)"
MODULES = ("lineitem", [f"{path('l_partkey')} AS path", "concat('mod', l_suppkey % 30) AS local", f"{path('l_suppkey')} AS target"])
WILDCARDS = ("lineitem", [f"{path('l_partkey')} AS path", f"{path('l_suppkey')} AS target"])


def sql(name: str, *facts: tuple[str, list[str]], where: str = "", distinct: bool = False) -> str:
    """`name` AS (...) of facts for a WITH clause."""
    each = [f"SELECT {'DISTINCT ' * distinct}{', '.join(cols)} FROM {f'(SELECT *, {_AIM} FROM lineitem)' if table == 'lineitem' else table} {where}" for table, cols in facts]
    return f"{name} AS ({' UNION ALL '.join(each)})"


def frame(t: Tables, *facts: tuple[str, list[str]], where: str = "true") -> DataFrame:
    out = None
    for table, cols in facts:
        rows = getattr(t, table).filter(where)
        one = (rows.selectExpr("*", _AIM) if table == "lineitem" else rows).selectExpr(*cols)
        out = one if out is None else out.unionByName(one)
    return out


FILES_SQL = sql("files", FILES)
IMPORTS_SQL = sql("imports", IMPORTS)
SYMBOLS_SQL = f"{sql('defs', CLASSES, METHODS, FUNCTIONS, RUNS)}, symbols AS (SELECT path, any_value(language) AS language, name, any_value(kind) AS kind, any_value(parent) AS parent, min(a) AS a, max(b) AS b, regexp_replace(name, '^.*[.]', '') AS short FROM defs GROUP BY path, name)"
_FEW = "WHERE l_linenumber = 5 AND l_orderkey % 5 = 0"
SCOPE_SQL = f"{LINKS_SQL}, {sql('modules', MODULES, where='WHERE l_linenumber = 4', distinct=True)}, {sql('wildcards', WILDCARDS, where=_FEW, distinct=True)}"
CALLS_SQL, BASES_SQL, DECLARED_SQL = sql("calls", CALLS), sql("bases", BASES), sql("declared", DECLARED)


def files(t: Tables) -> DataFrame:
    return frame(t, FILES)


def imports(t: Tables) -> DataFrame:
    i = frame(t, IMPORTS)
    none = F.create_map().cast("map<string,string>")
    return i.select("imp", "path", "language", "line", "module", F.array("name").alias("names"), none.alias("aliases"), F.lit(None).cast("string").alias("alias"), "level")


def go_modules(t: Tables) -> DataFrame:
    """One go.mod stands in the folder of all Go files."""
    return t.part.filter("p_partkey = 4").selectExpr("'svc' AS dir", "'example.org/svc' AS module")


def symbols(t: Tables) -> DataFrame:
    d = frame(t, CLASSES, METHODS, FUNCTIONS, RUNS)
    return d.groupBy("path", "name").agg(F.min("language").alias("language"), F.min("kind").alias("kind"), F.min("parent").alias("parent"), F.min("a").alias("start"), F.max("b").alias("end"))


def bindings(t: Tables):
    """(names, modules, wildcards) as operators.modules.Bindings has them."""
    link = t.lineitem.filter("l_orderkey % 3 = 0").selectExpr(*_LINK)
    names = link.groupBy("path", "local").agg(F.min("seq").alias("seq"), F.min(F.struct("seq", "target"))["target"].alias("target")).withColumn("orig", F.col("local"))
    return names, frame(t, MODULES, where="l_linenumber = 4").distinct(), frame(t, WILDCARDS, where="l_linenumber = 5 and l_orderkey % 5 = 0").distinct()


def declared(t: Tables) -> DataFrame:
    return frame(t, DECLARED)


def calls(t: Tables) -> DataFrame:
    return frame(t, CALLS)


def bases(t: Tables) -> DataFrame:
    return frame(t, BASES)
