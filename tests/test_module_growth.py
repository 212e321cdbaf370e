"""What the steps of operators.modules and operators.codegraph hold: imports are written once, folders stay folders."""

from test_codegraph import files_of, imports_of, small_plans  # noqa: F401
from test_names_growth import steps  # noqa: F401

from sedimenta.functions.files import normal_path
from sedimenta.operators import modules as M
from sedimenta.plans.storage import Kept

PATHS = ["p/__init__.py", "p/a.py", "p/b.py", *[f"svc/g/f{k:02}.go" for k in range(12)]]
ROWS = [("p/a.py", "python", m, names, {}, None, level) for m, names, level in (("p", ["b", "X"], 0), ("", ["a"], 1), ("numpy.linalg", [], 0), ("p.b", ["*"], 0))]
ROWS += [(f"svc/g/f{k:02}.go", "go", m, [], {}, None, 0) for k in range(12) for m in ("ex.org/svc/g", "fmt")]


def test_imports_are_written_once(spark, steps):  # noqa: F811
    """Four imports of Python are stored, 24 of Go aren't; results are the same with columns that come along."""
    files, imports, go = files_of(spark, PATHS), imports_of(spark, ROWS), spark.createDataFrame([("svc", "ex.org/svc")], "dir string, module string")
    kept = Kept(spark, "modules")
    found = M.resolve_modules(files, imports, go, kept, M.SCOPE)
    stored = sum(n for tag, n in steps if tag != "index")
    assert stored <= 4 + 1 + 2 + 12, steps
    plain = M.resolve_modules(files, imports, go)
    for own, other in zip(found, plain, strict=True):
        assert sorted(map(str, own.select(other.columns).collect())) == sorted(map(str, other.collect()))
    assert found.targets.count() == 12 * 12 + 3
    assert found.externals.count() == 12 + 1
    for own, other in zip(M.bind(imports, found), M.bind(imports, plain), strict=True):
        assert sorted(map(str, own.collect())) == sorted(map(str, other.collect()))


def test_plain_paths_are_normal(spark):
    cases = {"a/b": "a/b", "a/../b": "b", "a//b": "a/b", "./a": "a", "a/..": ".", "": ".", "a/": "a", "..a/b..": "..a/b..", "../a": "../a", "a/.": "a", "/a": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", normal_path(df.p).alias("n")).collect()} == cases


def test_files_of_folders_come_in_by_many_tasks(spark):
    """Twelve scopes of a folder are dealt out before its files come in, though adaptive plans would join them in one task."""
    files, imports, go = files_of(spark, PATHS), imports_of(spark, ROWS), spark.createDataFrame([("svc", "ex.org/svc")], "dir string, module string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        scopes = M.bind(imports, M.resolve_modules(files, imports, go)).modules
        rows = scopes.filter("local = 'g'").selectExpr("path", "target", "spark_partition_id() AS task").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(rows) == len({(r.path, r.target) for r in rows}) == 144
    assert len({r.task for r in rows}) > 1
