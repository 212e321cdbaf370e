"""Code chunks of files written out, against what their definitions ask for."""

from pyspark.sql import functions as F

from sedimenta.operators import codechunks as C

DEF = "path string, kind string, name string, parent string, start int, end int"


def chunks(spark, text, defs, path="a.py"):
    files = spark.createDataFrame([(path, text)], "path string, t string").select("path", C.split_lines(F.col("t")).alias("lines"))
    rows = C.code_chunks(files, spark.createDataFrame([(path, *d) for d in defs], DEF)).orderBy("start", F.desc("end")).collect()
    return [(r.kind, r.name, r.start, r.end, r.truncated) for r in rows], rows


def test_definitions_and_module_code(spark):
    text = "import redis\n\nCACHE_TTL = 300\nclient = redis.Redis()\n\n\ndef get_user(user_id):\n    x\n    y\n    return x\n\n\nclass Store:\n    def save(self):\n        pass\n"
    got, rows = chunks(spark, text, [("function", "get_user", None, 7, 10), ("class", "Store", None, 13, 15), ("method", "Store.save", "Store", 14, 15)])
    assert got == [("module", None, 1, 4, False), ("function", "get_user", 7, 10, False), ("class", "Store", 13, 15, False)]
    assert "CACHE_TTL = 300" in rows[0].content and rows[2].content.endswith("pass")


def test_large_class_is_split_into_methods(spark):
    body = "\n".join(f"    def m{i}(self):\n" + "\n".join(f"        x = {j}" for j in range(20)) for i in range(10))
    text = f'class Big:\n    """Doc."""\n{body}\n'
    defs = [("class", "Big", None, 1, 212), *(("function", f"Big.m{i}", "Big", 3 + 21 * i, 23 + 21 * i) for i in range(10))]
    got, _ = chunks(spark, text, defs)
    assert got == [("class", "Big", 1, 2, True), *(("method", f"Big.m{i}", 3 + 21 * i, 23 + 21 * i, False) for i in range(10))]


def test_large_without_members_nested_and_gaps(spark):
    text = "\n".join(f"l{i}" for i in range(1, 501))
    defs = [("function", "long", None, 1, 170), ("class", "Out", None, 180, 480), ("class", "Out.In", "Out", 200, 400), ("function", "Out.In.f", "Out.In", 390, 399), ("function", "Out.g", "Out", 470, 480), ("function", "Out.In.small.no", "Out.In.f", 391, 392)]
    got, _ = chunks(spark, text, defs)
    assert [x for x in got if x[1] == "long"] == [("function", "long", 1, 60, False), ("function", "long", 51, 110, False), ("function", "long", 101, 160, False), ("function", "long", 151, 170, False)]
    assert [x for x in got if x[1] and x[1].startswith("Out")] == [("class", "Out", 180, 199, True), ("class", "Out.In", 200, 319, True), ("method", "Out.In.f", 390, 399, False), ("method", "Out.g", 470, 480, False)]
    assert [x[2:4] for x in got if x[0] == "module"] == [(171, 179), (320, 379), (370, 389), (400, 459), (450, 469), (481, 500)]


def test_files_without_definitions_and_blank_ones(spark):
    assert chunks(spark, "x = 1", [])[0] == [("module", None, 1, 1, False)]
    assert chunks(spark, "\n \n\t\n", [])[0] == [] and chunks(spark, "", [])[0] == []
    assert chunks(spark, "def f(): 1\n\nx\ny\n\n", [("function", "f", None, 1, 1)])[0] == [("function", "f", 1, 1, False)]
    text = "\r\n".join(f"line {i}" for i in range(150))
    assert [x[2:4] for x in chunks(spark, text, [])[0]] == [(1, 60), (51, 110), (101, 150)]


def test_every_file_goes_its_way(spark):
    files = spark.createDataFrame([("a.py", "x\n"), ("b.md", "# T\ntext"), ("c.dat", "\n".join(map(str, range(70)))), ("d.txt", "plain"), ("e.go", "")], "path string, content string")
    sections = lambda d: d.select("path", F.lit("S").alias("name"), F.lit(1).alias("start"), F.lit(1).alias("end"), "content")
    got = C.chunk_files(files, spark.createDataFrame([], DEF), sections).collect()
    assert sorted((r.path, r.source_type, r.kind, r.start, r.end) for r in got) == [("a.py", "code", "module", 1, 1), ("b.md", "doc", "section", 1, 1), ("c.dat", "code", "window", 1, 60), ("c.dat", "code", "window", 51, 70), ("d.txt", "doc", "section", 1, 1)]


def test_lines_are_joined_once_and_never_broadcast(spark):
    """A file's lines may be of any length, which Spark's estimate of an array's size doesn't know."""
    files = spark.createDataFrame([("a.py", ["x", "y"]), ("b.py", ["", "z"])], "path string, lines array<string>")
    df = C.code_chunks(files, spark.createDataFrame([("a.py", "function", "f", None, 1, 2)], DEF))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("lines#") and physical.count("Join") == 1 and "Broadcast" not in physical
    assert sorted((r.path, r.kind, r.start, r.end) for r in df.collect()) == [("a.py", "function", 1, 2), ("b.py", "module", 2, 2)]
