"""Neighbourhoods, package use and history edges of small written-out graphs."""

from sedimenta.operators.neighborhood import assemble, history_edges, packages_used, symbol_relations


def test_two_hops_and_drawing(spark):
    rows = [(2, "calls", 1, 1, 0.9), (3, "calls", 2, 1, 0.8), (1, "calls", 4, 2, 0.7), (4, "calls", 5, 1, 0.6), (4, "calls", 3, 1, 0.9), (1, "inherits", 6, 1, 1.0), (7, "inherits", 1, 1, 1.0), (1, "calls", 1, 1, 1.0), (2, "calls", 4, 1, 0.9)]
    e = spark.createDataFrame(rows, "src long, kind string, dst long, weight long, confidence double")
    tests = spark.createDataFrame([(n, False) for n in range(1, 8)], "node long, is_test boolean")
    rels = symbol_relations(e, tests, 1)
    got = {(r.side, r.depth, r.relation, r.node, r.anchor) for r in rels.collect()}
    assert got == {("in", 1, "caller", 2, 1), ("in", 1, "subclass", 7, 1), ("out", 1, "callee", 4, 1), ("out", 1, "base", 6, 1), ("in", 2, "caller", 3, 2), ("out", 2, "callee", 5, 4)}
    drawn = [tuple(r) for r in assemble(rels, 1).collect()]
    assert sorted(r[1] for r in drawn if r[0] == "node") == [1, 2, 3, 4, 5, 6, 7]
    assert {r[1:4] for r in drawn if r[0] == "edge"} == {(2, 1, "caller"), (7, 1, "subclass"), (1, 4, "callee"), (1, 6, "base"), (3, 2, "caller"), (4, 5, "callee")}


def test_production_code_comes_before_tests(spark):
    e = spark.createDataFrame([(n, "calls", 1, 1, n / 10) for n in range(2, 6)], "src long, kind string, dst long, weight long, confidence double")
    tests = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True), (5, True)], "node long, is_test boolean")
    assert {r.node for r in symbol_relations(e, tests, 1, per_column=3).collect()} == {2, 3, 5}


def test_names_count_as_words_of_their_own(spark):
    files = spark.createDataFrame([("f", "import np\nx.np()\nnp.zeros(pd2)\né_np"), ("g", None)], "file string, text string")
    symbols = spark.createDataFrame([("a", "f", 2, 2), ("b", "f", 3, 3), ("c", "f", 4, 4), ("d", "g", 1, 9), ("e", "f", 9, 12)], "symbol string, file string, start_line int, end_line int")
    imports = spark.createDataFrame([("f", "numpy", False, ["np"]), ("f", "pandas", False, ["pd", ""]), ("f", "none", True, None), ("g", "x", True, ["x"])], "file string, package string, stdlib boolean, bound array<string>")
    assert [tuple(r) for r in packages_used(symbols, files, imports).collect()] == [("b", "numpy", False)]


def test_history_edges(spark):
    commits = spark.createDataFrame([("s", None, "Ann"), ("t", "B@x", "B"), ("u", None, None)], "sha string, email string, name string")
    changes = spark.createDataFrame([("s", "a", 2, None), ("s", "gone", 1, 1), ("t", "a", 0, 0)], "sha string, path string, insertions int, deletions int")
    links = spark.createDataFrame([("commit", "s", "merged_in", "pull_request", "1"), ("commit", "lost", "merged_in", "pull_request", "1"), ("pull_request", "1", "fixes", "issue", "2")], "src_kind string, src string, kind string, dst_kind string, dst string")
    got = {tuple(r) for r in history_edges(commits, changes, spark.createDataFrame([("a",)], "path string"), links).collect()}
    assert got == {
        ("author", "ann", "authored", "commit", "s", 1), ("author", "b@x", "authored", "commit", "t", 1), ("author", "unknown", "authored", "commit", "u", 1),
        ("commit", "s", "modifies", "file", "a", 2), ("commit", "t", "modifies", "file", "a", 1),
        ("commit", "s", "merged_in", "pull_request", "1", 1), ("pull_request", "1", "fixes", "issue", "2", 1),
    }
