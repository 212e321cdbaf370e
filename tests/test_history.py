"""Timelines, versions and evidence of small written-out histories."""

from pyspark.sql import functions as F

from sedimenta.operators.history import evidence, evolution, linked, timeline


def test_a_cut_history_has_no_origin(spark):
    touches = spark.createDataFrame([("a", s, s) for s in range(1, 5)] + [("b", 9, 1)], "path string, sha long, authored_at long")
    pulls = spark.createDataFrame([(4, 7), (4, 7), (4, 6)], "sha long, pull long")
    issues = spark.createDataFrame([(7, "mentions", 1), (7, "fixes", 2), (6, "fixes", 2)], "pull long, kind string, issue long")
    got = {(r.path, r.sha): (r.place, r.role, r.pulls) for r in timeline(touches, pulls, issues, 3).collect()}
    assert got == {("a", 4): (1, None, [6, 7]), ("a", 3): (2, None, None), ("a", 2): (3, None, None), ("b", 9): (1, "introduced", None)}
    (row,) = linked(pulls, issues).collect()
    assert [tuple(i) for i in row.issues] == [("fixes", 2), ("fixes", 2), ("mentions", 1)]


def test_versions_keep_origin_and_newest(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [("k", n, f"+++ b/x\n@@ -1 +{n},2 @@\n+a\n-b\n+c", text) for n in range(1, 4)] + [("k", 5, "@@ -3 +2,0 @@\n-x", text), ("k", 6, "no hunk", text)]
    df = spark.createDataFrame(rows, "key string, at int, diff string, text string")
    got = {r["at"]: (r.version, r.total, r.truncated, r.role, r.start_line, r.end_line, r.code, r.added, r.removed) for r in evolution(df, 3, 1).collect()}
    assert got == {
        1: (1, 4, True, "introduced", 1, 2, "one\n…", 2, 1),
        3: (2, 4, True, None, 3, 4, "three\n…", 2, 1),
        5: (3, 4, True, None, None, None, None, 0, 1),
    }
    assert {r["at"]: r.version for r in evolution(df).collect()} == {1: 1, 2: 2, 3: 3, 5: 4}


def test_evidence_text(spark):
    rows = [(1, 2, "graph", None, None, None, None, 'f"x', None, "b"), (1, 1, "code", "a.py", 3, 5, "function", "f", None, None)]
    df = spark.createDataFrame(rows, "q int, place int, type string, path string, start_line int, end_line int, symbol_kind string, symbol string, relation string, content string")
    (row,) = evidence(df, "q", F.lit("r"), F.lit("code"), F.lit("f")).collect()
    assert row.evidence == """<repository name="r" indexed_sources="code" />
<evidence>
<source id="S1" type="code" path="a.py" lines="3-5" symbol="function f">

</source>
<source id="S2" type="graph" analysis="impact of f'x">
b
</source>
</evidence>
<selection>The developer has selected f; the question is about it.</selection>"""
