"""Modules, scopes, classes and calls of small code bases written out; names passed on along chains; rebuilt graphs against whole ones."""

import random

import pytest

from sedimenta.operators import codegraph as G
from sedimenta.operators import modules as M
from sedimenta.operators import names as N
from sedimenta.plans.storage import Kept


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Many small jobs: without compiled stages and adaptive plans they take a third of the time."""
    own = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


IMPORT = "imp string, path string, language string, line int, module string, names array<string>, aliases map<string,string>, alias string, level int"
SYMBOL = "path string, language string, name string, kind string, parent string, start int, end int"


def imports_of(spark, rows):
    """Rows (path, language, module, names, aliases, alias, level)."""
    return spark.createDataFrame([(str(k), p, lang, k + 1, m, names, aliases, alias, level) for k, (p, lang, m, names, aliases, alias, level) in enumerate(rows)], IMPORT)


def files_of(spark, paths):
    return spark.createDataFrame([(p, None) for p in paths], "path string, language string")


def resolved(spark, paths, rows, go=()):
    """Of each import its files, submodules and package."""
    r = M.resolve_modules(files_of(spark, paths), imports_of(spark, rows), spark.createDataFrame(list(go), "dir string, module string"))
    out = [([], {}, None) for _ in rows]
    for x in r.targets.orderBy("ord", "file").collect():
        out[int(x.imp)][0].append(x.file)
    for x in r.submodules.collect():
        out[int(x.imp)][1][x.name] = x.file
    for x in r.externals.collect():
        out[int(x.imp)] = (out[int(x.imp)][0], out[int(x.imp)][1], x.package)
    return out


def test_python_modules(spark):
    paths = ["rq/__init__.py", "rq/job.py", "rq/cli/cli.py", "tests/json.py", "tests/test_job.py", "src/pkg/sub.py"]
    got = resolved(spark, paths, [
        ("rq/cli/cli.py", "python", "job", ["Job"], {}, None, 2),
        ("tests/test_job.py", "python", "rq", ["job"], {}, None, 0),
        ("rq/job.py", "python", "json", [], {}, None, 0),
        ("rq/job.py", "python", "", ["cli", "job"], {}, None, 1),
        ("rq/job.py", "python", "pkg.sub", [], {}, "s", 0),
        ("rq/job.py", "python", "numpy.linalg", [], {}, None, 0),
        ("rq/cli/cli.py", "python", "", ["cli"], {}, None, 1),
    ])
    assert got == [(["rq/job.py"], {}, None), (["rq/__init__.py"], {"job": "rq/job.py"}, None), ([], {}, "json"), (["rq/__init__.py"], {"job": "rq/job.py"}, None), (["src/pkg/sub.py"], {}, None), ([], {}, "numpy"), (["rq/cli/cli.py"], {"cli": "rq/cli/cli.py"}, None)]


def test_javascript_modules(spark):
    paths = ["src/lib/api.ts", "src/components/index.tsx", "src/app/page.tsx", "src/app/x.ts"]
    page = "src/app/page.tsx"
    got = resolved(spark, paths, [(page, "tsx", m, [], {}, None, 0) for m in ("@/lib/api", "../components", "react", "@scope/pkg/deep", "node:fs/promises", "./x.js", "./gone", "@/gone", "../lib/api?raw")])
    assert got == [(["src/lib/api.ts"], {}, None), (["src/components/index.tsx"], {}, None), ([], {}, "react"), ([], {}, "@scope/pkg"), ([], {}, "fs"), (["src/app/x.ts"], {}, None), ([], {}, None), ([], {}, None), (["src/lib/api.ts"], {}, None)]


def test_other_modules(spark):
    paths = ["svc/a/x.go", "svc/a/y.go", "svc/a/x_test.go", "svc/main.go", "app/src/main/java/com/acme/Tool.java", "lib/Tool.kt", "crates/k/src/a/b.rs", "crates/k/src/a/mod.rs", "lib/tool/run.rb", "app/near.rb", "inc/util/log.h", "src/here.h"]
    rows = [
        ("svc/main.go", "go", "ex.org/svc/a", [], {}, None, 0), ("svc/main.go", "go", "fmt", [], {}, None, 0), ("svc/main.go", "go", "ex.org/svc/none", [], {}, None, 0),
        ("x.java", "java", "com.acme.Tool", [], {}, None, 0), ("x.java", "java", "com.acme.Tool.run", ["run"], {}, None, 0), ("x.java", "java", "org.none.Thing", [], {}, None, 0), ("x.java", "java", "com.acme.*", ["*"], {}, None, 0),
        ("crates/k/src/m.rs", "rust", "crate::a::b::C", ["C"], {}, None, 0), ("crates/k/src/a/b.rs", "rust", "super::a", [], {}, None, 0), ("x.rs", "rust", "serde::de", [], {}, None, 0), ("x.rs", "rust", "std::io", [], {}, None, 0),
        ("app/x.rb", "ruby", "tool/run", [], {}, None, 0), ("app/x.rb", "ruby", "./near", [], {}, None, 0), ("app/x.rb", "ruby", "rails/all", [], {}, None, 0),
        ("src/x.c", "c", "here.h", [], {}, None, 0), ("src/x.c", "c", "util/log.h", [], {}, None, 0), ("src/x.c", "c", "stdio.h", [], {}, None, -1),
    ]
    got = resolved(spark, paths, rows, [("svc", "ex.org/svc"), ("other", "ex.org/s")])
    assert [(f, p) for f, _, p in got] == [(["svc/a/x.go", "svc/a/y.go"], None), ([], "fmt"), ([], None), (["app/src/main/java/com/acme/Tool.java"], None), (["app/src/main/java/com/acme/Tool.java"], None), ([], "org.none"), ([], None), (["crates/k/src/a/b.rs"], None), (["crates/k/src/a/mod.rs"], None), ([], "serde"), ([], None), (["lib/tool/run.rb"], None), (["app/near.rb"], None), ([], "rails"), (["src/here.h"], None), (["inc/util/log.h"], None), ([], None)]


def test_bound_names(spark):
    rows = [("a", "tsx", "react", ["default", "useRef"], {"React": "default", "ref": "useRef"}, None, 0), ("a", "python", "numpy.linalg", [], {}, "la", 0), ("a", "python", "numpy.linalg", [], {}, None, 0), ("a", "go", "github.com/x/y", [], {}, None, 0)]
    got = imports_of(spark, rows).orderBy("line").select(M.bound_names().alias("b")).collect()
    assert [r.b for r in got] == [["React", "ref"], ["la"], ["numpy"], ["y"]]


def scopes(spark, names=(), modules=(), wildcards=()):
    return M.Bindings(spark.createDataFrame(list(names), "path string, local string, seq int, target string, orig string"), spark.createDataFrame(list(modules), "path string, local string, target string"), spark.createDataFrame(list(wildcards), "path string, target string"))


def test_names_passed_on(spark):
    """Chains of 1, 2 and 50 links, a circle, a chain into it, one that leads nowhere, and alternatives."""
    names = [("one", "A", 0, "home", "A"), ("two", "A", 0, "one", "A")]
    names += [(f"c{k}", f"n{k}", 0, f"c{k + 1}", f"n{k + 1}") for k in range(49)] + [("c49", "n49", 0, "home", "A")]
    names += [(f"r{k}", "x", 0, f"r{(k + 1) % 7}", "x") for k in range(7)] + [("into", "x", 0, "r3", "x")]
    names += [(f"d{k}", "y", 0, f"d{k + 1}", "y") for k in range(9)]
    names += [("v", "z", 0, "u", "z"), ("v", "z", 1, "home", "A"), ("u", "z", 0, "v", "z"), ("u", "z", 1, "home", "B"), ("w", "z", 0, "d0", "y"), ("w", "z", 1, "two", "A"), ("home", "B", 0, "one", "A")]
    symbols = spark.createDataFrame([("home", "python", "A", "class", None, 1, 2), ("home", "python", "B", "class", None, 3, 4)], SYMBOL)
    index = N.Index(symbols)
    got = {(r.at, r.want): (r.file, r.name, r.hops) for r in N.passed_on(scopes(spark, names), index).collect()}
    want = {("one", "A"): ("home", "A", 1), ("two", "A"): ("home", "A", 2), **{(f"c{k}", f"n{k}"): ("home", "A", 50 - k) for k in range(50)}}
    want |= {("v", "z"): ("home", "A", 1), ("u", "z"): ("home", "B", 1), ("w", "z"): ("home", "A", 3)}
    assert got == want
    assert N.passed_on(scopes(spark, names), index, hops=3).filter("at like 'c%'").count() == 3


#: A small package: (path, qualified name, kind, parent, lines).
SYMBOLS = [
    ("pkg/queue.py", "Queue", "class", None, 3, 8), ("pkg/queue.py", "Queue.enqueue", "method", "Queue", 4, 5), ("pkg/queue.py", "Queue.enqueue_call", "method", "Queue", 7, 8),
    ("pkg/utils.py", "helper", "function", None, 1, 2),
    ("pkg/worker.py", "Worker", "class", None, 5, 10), ("pkg/worker.py", "Worker.work", "method", "Worker", 6, 10),
    ("pkg/base.py", "Base", "class", None, 1, 3), ("pkg/base.py", "Base.start", "method", "Base", 2, 3),
]
IMPORTS = [
    ("pkg/__init__.py", "python", "queue", ["Queue"], {}, None, 1), ("pkg/queue.py", "python", "redis", [], {}, None, 0), ("pkg/worker.py", "python", "pkg", ["Queue"], {}, None, 0),
    ("pkg/worker.py", "python", "pkg.utils", [], {}, "u", 0), ("pkg/worker.py", "python", "base", ["Base"], {}, None, 1),
]
CALLS = [("pkg/queue.py", 5, "enqueue_call", "self"), ("pkg/queue.py", 8, "Redis", "redis"), ("pkg/worker.py", 7, "Queue", None), ("pkg/worker.py", 8, "enqueue", "q"), ("pkg/worker.py", 9, "helper", "u"), ("pkg/worker.py", 10, "start", "self")]
PATHS = ["pkg/__init__.py", "pkg/queue.py", "pkg/utils.py", "pkg/worker.py", "pkg/base.py", "pyproject.toml"]


def facts(spark, paths=PATHS, symbols=SYMBOLS, imports=IMPORTS, calls=CALLS, bases=(("pkg/worker.py", 5, "Base", 5),), declared=(("pyproject.toml", 0, "pypi", "redis"),)):
    return G.Facts(
        spark.createDataFrame([(p, "python") for p in paths], "path string, language string"), spark.createDataFrame([(p, "python", *rest) for p, *rest in symbols], SYMBOL), imports_of(spark, list(imports)),
        spark.createDataFrame(list(calls), "path string, line int, name string, receiver string"), spark.createDataFrame(list(bases), "path string, class_line int, name string, line int"),
        spark.createDataFrame([], "dir string, module string"), spark.createDataFrame(list(declared), "path string, seq int, ecosystem string, name string"),
    )


def edges_of(graph):
    return {(r.src, r.kind, r.dst): (r.weight, round(r.confidence, 2), r.via, tuple(r.lines)) for r in graph.edges.collect()}


def test_graph_of_a_package(spark):
    kept = Kept(spark, "test")
    e = edges_of(G.build(facts(spark), kept))
    q, w = "pkg/queue.py::Queue", "pkg/worker.py::Worker"
    assert e[f"{q}.enqueue", "calls", f"{q}.enqueue_call"] == (1, 1.0, "self", (5,))
    assert e[f"{w}.work", "calls", q] == (1, 1.0, "import", (7,))
    assert e[f"{w}.work", "calls", "pkg/utils.py::helper"] == (1, 1.0, "module import", (9,))
    assert e[f"{w}.work", "calls", f"{q}.enqueue"][1:3] == (0.4, "unique method name")
    assert e[f"{w}.work", "calls", "pkg/base.py::Base.start"][1:3] == (0.9, "inherited")
    assert e[w, "inherits", "pkg/base.py::Base"][1:3] == (1.0, "import")
    assert ("pkg/queue.py", "defines", q) in e and (q, "contains", f"{q}.enqueue") in e
    assert {d for s, k, d in e if s == "pkg/worker.py" and k == "imports"} == {"pkg/__init__.py", "pkg/utils.py", "pkg/base.py"}
    assert ("pkg/queue.py", "imports", "pypi:redis") in e and ("pyproject.toml", "declares", "pypi:redis") in e
    assert len([1 for _, k, _ in e if k == "calls"]) == 5
    kept.drop()


def test_ladder_of_names(spark):
    """Each way that a name may be meant, and what goes first."""
    s = [("a.go", "go", "Here", "function", None, 1, 2), ("b.go", "go", "There", "function", None, 1, 2), ("x/m.py", "python", "Far", "class", None, 1, 9), ("x/m.py", "python", "Far.lone_one", "method", "Far", 2, 3), ("y.java", "java", "Own", "class", None, 1, 20), ("y.java", "java", "Own.go", "method", "Own", 2, 4), ("y.java", "java", "Own.me", "method", "Own", 5, 8), ("z.py", "python", "get", "function", None, 1, 2), ("z.py", "python", "Two", "class", None, 4, 9), ("z2.py", "python", "Two", "class", None, 4, 9), ("z.py", "python", "Two.act", "method", "Two", 5, 6), ("z2.py", "python", "Two.act", "method", "Two", 5, 6), ("g/q.go", "go", "Far", "function", None, 1, 1)]
    index = N.Index(spark.createDataFrame(s, SYMBOL))
    b = scopes(spark, [("i.py", "F", 0, "x/m.py", "Far"), ("j.py", "D", 0, "x/m.py", "default")], [("i.py", "zz", "z.py")], [("k.py", "z.py")])
    site = lambda path, lang, want, parent=None: (path, lang, want, parent)
    sites = [site("i.py", "python", "F"), site("y.java", "java", "go", "Own"), site("a.go", "go", "Here"), site("a.go", "go", "There"), site("k.py", "python", "get"), site("i.py", "python", "get"), site("i.py", "python", "Own"), site("i.py", "python", "There"), site("i.py", "python", "Two"), site("i.py", "python", "Far")]
    got = {(r.path, r.want): (r["keys"], r.confidence, r.via) for r in N.resolve_names(index, b, spark.createDataFrame(sites, "path string, language string, want string, parent string")).collect()}
    assert got == {("i.py", "F"): (["x/m.py::Far"], 1.0, "import"), ("y.java", "go"): (["y.java::Own.go"], 0.95, "same class"), ("a.go", "Here"): (["a.go::Here"], 0.95, "same file"), ("a.go", "There"): (["b.go::There"], 0.85, "same package"), ("k.py", "get"): (["z.py::get"], 0.85, "wildcard import"), ("i.py", "There"): (["b.go::There"], 0.5, "unique name")}
    calls = [("i.py", 1, "get", "zz"), ("i.py", 2, "act", "self.two"), ("i.py", 3, "lone_one", "x"), ("i.py", 4, "lone_one", "ns.F"), ("y.java", 6, "go", "this"), ("y.java", 7, "me", "super"), ("y.java", 8, "me", "self"), ("i.py", 5, "absent", None), ("i.py", 6, "gone", "zz")]
    found = N.resolve_calls(index, b, spark.createDataFrame(calls, "path string, line int, name string, receiver string"), spark.createDataFrame([], "cls string, base string, line int, confidence double, via string"))
    got = sorted((r.path, r.line, r.target, r.confidence, r.via) for r in found.collect())
    assert got == [("i.py", 1, "z.py::get", 1.0, "module import"), ("i.py", 2, "z.py::Two.act", 0.7, "receiver name"), ("i.py", 2, "z2.py::Two.act", 0.7, "receiver name"), ("i.py", 3, "x/m.py::Far.lone_one", 0.4, "unique method name"), ("i.py", 4, "x/m.py::Far.lone_one", 0.9, "class member"), ("y.java", 6, "y.java::Own.go", 1.0, "self")]


def test_ancestors_of_a_diamond_and_a_circle(spark):
    edges = [("D", "B", 1), ("D", "C", 2), ("B", "A", 1), ("C", "A", 1), ("C", "Z", 2), ("P", "Q", 1), ("Q", "P", 1), ("L0", "L1", 1), ("L1", "L2", 1), ("L2", "L3", 1), ("L3", "L4", 1), ("L4", "L5", 1)]
    df = spark.createDataFrame(edges, "cls string, base string, line int")
    up = N.ancestors(df, spark.createDataFrame([("D",), ("P",), ("L0",)], "cls string"), Kept(spark, "test")).orderBy("cls", "level", "place").collect()
    got = {k: [(r.base, r.level) for r in up if r.cls == k] for k in ("D", "P", "L0")}
    assert got == {"D": [("B", 1), ("C", 1), ("A", 2), ("Z", 2)], "P": [("Q", 1)], "L0": [("L1", 1), ("L2", 2), ("L3", 3), ("L4", 4)]}


def random_base(rng):
    """A code base of a few files that use each other at random."""
    paths = [f"p{k % 2}/m{k}.py" for k in range(8)] + ["p0/__init__.py"]
    kinds, symbols, calls, bases, imports = ["Al", "Be", "Ga", "De"], [], [], [], []
    for p in paths[: rng.choice([7, 8, 9])]:
        for k in rng.sample(kinds, 2):
            symbols += [(p, k, "class", None, 1 + 10 * kinds.index(k), 9 + 10 * kinds.index(k))]
            symbols += [(p, f"{k}.{m}", "method", k, 2 + 10 * kinds.index(k) + 2 * j, 3 + 10 * kinds.index(k) + 2 * j) for j, m in enumerate(rng.sample(["open_it", "shut_it", "turn_it", "only_" + p[4]], 2))]
            if rng.random() < 0.6:
                bases.append((p, 1 + 10 * kinds.index(k), rng.choice(kinds), 1 + 10 * kinds.index(k)))
        for line in range(2, 40, 3):
            calls.append((p, line, rng.choice([*kinds, "open_it", "shut_it", "turn_it", "only_3", "only_5"]), rng.choice([None, "self", "al", "Be", "mod", "super"])))
        for _ in range(3):
            to = rng.choice(paths)
            name = rng.choice([["Al"], ["Be", "Ga"], ["*"], [], ["m" + to[4]]])
            imports.append((p, "python", rng.choice([to[:2], to[:2] + "." + to[3:5], "redis"]), name, {}, "mod" if not name else None, 0))
    return symbols, imports, calls, bases


def test_rebuilt_graph_equals_a_whole_one(spark):
    """Two turns, in each of which a file changes, one comes and one goes at random; what is made anew gives the graph of a whole build."""
    rng = random.Random(1)
    rows, kept = random_base(rng), Kept(spark, "test")
    here = sorted({r[0] for r in rows[0]})
    before = facts(spark, here, *rows)
    graph = G.build(before, kept)
    for turn in range(2):
        fresh, new = random_base(rng), f"p1/new{turn}.py"
        edited, gone = rng.sample([p for p in here if "new" not in p], 2)
        moved = {edited: edited, here[0]: new}  # facts of the new file are those of another under its name
        parts = [[(moved[r[0]], *r[1:]) for r in part if r[0] in moved] for part in fresh]
        rows = [[r for r in old if r[0] not in (edited, gone)] + part for old, part in zip(rows, parts, strict=True)]
        here = sorted({*here, new} - {gone})
        after = facts(spark, here, *rows)
        changed = spark.createDataFrame([(edited,), (gone,), (new,)], "path string")
        graph, again = G.rebuild(before, graph, after, changed, kept)
        before = after
    whole = G.build(after, kept)
    assert edges_of(graph) == edges_of(whole)
    assert {tuple(r)[:2] for r in graph.inherits.collect()} == {tuple(r)[:2] for r in whole.inherits.collect()}
    assert {"p1/new1.py", edited} <= {r.path for r in again.collect()}
    kept.drop()


def test_unrelated_files_stay(spark):
    """An edit of a file whose names nobody else uses touches that file alone."""
    kept = Kept(spark, "test")
    before = facts(spark)
    graph = G.build(before, kept)
    more = [*SYMBOLS, ("pkg/utils.py", "private_thing", "function", None, 5, 6)]
    after, again = G.rebuild(before, graph, facts(spark, symbols=more), spark.createDataFrame([("pkg/utils.py",)], "path string"), kept)
    assert [r.path for r in again.collect()] == ["pkg/utils.py"]
    assert edges_of(after) == edges_of(graph) | {("pkg/utils.py", "defines", "pkg/utils.py::private_thing"): (1, 1.0, None, ())}
    kept.drop()


GO_FILES, GO_IMPORT = ["svc/a/x.go", "svc/a/y.go", "svc/a/x_test.go", "main.go"], ("main.go", "go", "ex.org/svc/a", [], {}, None, 0)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_path_alias_asks_three_keys_for_each_root(spark):
    """Not one for each ending."""
    asked = M.asked_paths(imports_of(spark, [("a/b/c.tsx", "tsx", "@/x.js", [], {}, None, 0)]))
    assert asked.count() == 3 * 2 * 3
    paths = ["a/src/x.ts", "a/src/x.jsx", "x/index.d.ts", "src/x.js"]
    assert resolved(spark, paths, [("a/b/c.tsx", "tsx", m, [], {}, None, 0) for m in ("@/x", "@/x.js", "../../x", "../../src/x.js", "../../x/index")]) == [([f], {}, None) for f in ("a/src/x.ts", "a/src/x.ts", "x/index.d.ts", "src/x.js", "x/index.d.ts")]


def test_files_of_go_folders_take_no_part_in_packages(spark):
    imports = imports_of(spark, [GO_IMPORT, ("main.go", "go", "github.com/x/y", [], {}, None, 0)])
    r = M.resolve_modules(files_of(spark, GO_FILES), imports, spark.createDataFrame([("svc", "ex.org/svc")], "dir string, module string"))
    assert "_test.go" not in optimized(r.externals) and [x.package for x in r.externals.collect()] == ["github.com/x/y"]


def test_go_scopes_and_edges_are_made_for_folders(spark):
    """Distinct before the files of a folder come in; the edges to them aren't stored."""
    imports = imports_of(spark, [GO_IMPORT, GO_IMPORT])
    modules = spark.createDataFrame([("svc", "ex.org/svc")], "dir string, module string")
    b = M.bind(imports, M.resolve_modules(files_of(spark, GO_FILES), imports, modules))
    assert optimized(b.modules).startswith("Union")
    assert sorted(map(tuple, b.modules.collect())) == [("main.go", "a", "svc/a/x.go"), ("main.go", "a", "svc/a/y.go")]
    none = lambda schema: spark.createDataFrame([], schema)
    kept = Kept(spark, "graph")
    facts = G.Facts(files_of(spark, GO_FILES), none(SYMBOL), imports, none("path string, line int, name string, receiver string"), none("path string, class_line int, name string, line int"), modules, none("path string, seq int, ecosystem string, name string"))
    edges = G.build(facts, kept).edges
    assert "Join" in optimized(edges)
    assert sorted((e.src, e.kind, e.dst, e.weight, e.lines) for e in edges.collect()) == [("main.go", "imports", f"svc/a/{f}.go", 2.0, [1, 2]) for f in "xy"]
    kept.drop()
