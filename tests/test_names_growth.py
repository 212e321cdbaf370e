"""What the steps of operators.names hold: their size must grow with the input, whatever the results do."""

import pytest
from pyspark.sql import functions as F
from test_codegraph import SYMBOL, scopes, small_plans  # noqa: F401

from sedimenta.operators import names as N
from sedimenta.plans.storage import Kept


@pytest.fixture
def steps(monkeypatch):
    """Tag and rows of each stored step; keys of a list count as rows."""
    out, write = [], Kept.write

    def count(self, df, tag):
        df = write(self, df, tag)
        size = F.greatest(F.size("keys"), F.lit(1)) if "keys" in df.columns else F.lit(1)
        out.append((tag, df.select(F.sum(size)).first()[0] or 0))
        return df

    monkeypatch.setattr(Kept, "write", count)
    return out


def test_pointers_that_have_settled_are_not_stored_again(spark, steps):
    """200 names one link from home, a circle of three, a dead end: none has an alternative, so there is one round, and 200 pointers are stored once."""
    names = [(f"n{k}", "A", 0, "home", "A") for k in range(200)] + [(f"r{k}", "x", 0, f"r{(k + 1) % 3}", "x") for k in range(3)] + [("d", "y", 0, "e", "y"), ("c", "A", 0, "n0", "A")]
    symbols = spark.createDataFrame([("home", "python", "A", "class", None, 1, 2)], SYMBOL)
    found = N.passed_on(scopes(spark, names), N.Index(symbols))
    assert {(r.at, r.file, r.hops) for r in found.collect()} == {(f"n{k}", "home", 1) for k in range(200)} | {("c", "home", 2)}
    assert [tag for tag, _ in steps].count("first") == 1
    assert sum(n for tag, n in steps if tag == "pointers") < 220


N_FILES = 12
#: Files of one Go folder, each of which has a function and a class of the same names, the class with a method.
PACKAGE = [row for k in range(N_FILES) for row in ((f"g/f{k:02}.go", "go", "make_it", "function", None, 1, 2), (f"g/f{k:02}.go", "go", "Thing", "class", None, 10, 20), (f"g/f{k:02}.go", "go", "Thing.turn", "method", "Thing", 11, 12))]
USERS = [(f"g/u{k:02}.go", "go", f"Own{k}", "class", None, 1, 9) for k in range(N_FILES)]
KEYS = {name: [f"g/f{k:02}.go::{name}" for k in range(N_FILES)] for name in ("make_it", "Thing")}


def test_names_of_a_folder_stay_one_list(spark, steps):
    """Twelve uses of a name with twelve definitions: no step has 144."""
    index = N.Index(spark.createDataFrame(PACKAGE + USERS, SYMBOL))
    sites = [(f"g/u{k:02}.go", "go", "make_it", None) for k in range(N_FILES)]
    found = N.resolve_names(index, scopes(spark), spark.createDataFrame(sites, "path string, language string, want string, parent string"))
    assert [(r.path, r["keys"], r.via) for r in found.orderBy("path").collect()] == [(s[0], KEYS["make_it"], "same package") for s in sites]
    assert max(n for _, n in steps) <= 2 * len(PACKAGE + USERS)


def test_a_class_of_a_folder_is_the_first_other_one(spark, steps):
    index = N.Index(spark.createDataFrame(PACKAGE + USERS, SYMBOL))
    bases = [(f"g/u{k:02}.go", 1, "Thing", 1) for k in range(N_FILES)] + [("g/f00.go", 10, "Thing", 10), ("g/u03.go", 1, "make_it", 2)]
    found = N.inheritance(index, scopes(spark), spark.createDataFrame(bases, "path string, class_line int, name string, line int"))
    assert sorted((r.cls, r.base, r.via) for r in found.collect()) == [(f"g/u{k:02}.go::Own{k}", "g/f00.go::Thing", "same package") for k in range(N_FILES)]
    assert max(n for _, n in steps) <= 2 * len(PACKAGE + USERS)


def test_calls_of_a_folder_become_rows_at_the_end(spark, steps):
    """Bare calls reach all definitions of the folder, a call on a class the method of its first one; a definition's call of itself is left out."""
    index = N.Index(spark.createDataFrame(PACKAGE + USERS, SYMBOL))
    calls = [(f"g/u{k:02}.go", line, name, receiver) for k in range(N_FILES) for line, name, receiver in ((3, "make_it", None), (4, "turn", "ns.Thing"))]
    none = spark.createDataFrame([], "cls string, base string, line int, confidence double, via string")
    found = N.resolve_calls(index, scopes(spark), spark.createDataFrame(calls, "path string, line int, name string, receiver string"), none)
    want = [(f"g/u{k:02}.go", 3, key, "same package") for k in range(N_FILES) for key in KEYS["make_it"]]
    want += [(f"g/u{k:02}.go", 4, "g/f00.go::Thing.turn", "class member") for k in range(N_FILES)]
    assert sorted((r.path, r.line, r.target, r.via) for r in found.collect()) == sorted(want)
    assert max(n for _, n in steps) <= 2 * len(PACKAGE + USERS)
