import random
import re

import pytest

from sedimenta.llm import near_dedup
from sedimenta.llm.near_dedup import near_duplicates, stage


def brute(rows, num=85, den=100):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    lead = {g: min((k for k in v if k is not None), default=None) for g, v in groups.items()}
    return sorted([(k, len(sets[i]), lead[find(i)], k == lead[find(i)]) for i, (k, _) in enumerate(rows)], key=str)


def rows_of(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉ") for _ in range(3))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append(r.choice([" ", "\t", "  \n"]).join(w).replace("a", r.choice("aA")))
    rows += ["", None, "one", "One", "one two", " \n ", "a b c d", "A  b c d", rows[0], rows[0]]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [32, 2])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "PER_COPY", 3)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_links_from_080_on(spark, seed):
    rows = rows_of(seed)
    assert brute(rows, 80) != brute(rows, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in stage(spark, df, "").collect()} == {r[0] for r in brute(rows, 80) if r[3]}


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "x y z"), (7, "x y z"), (None, None)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, n int, cls string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 1, 5, True), (7, 1, 5, False), (None, 0, None, True)], key=str)
    out = stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, None), (None, "a b c d e f"), (5, "x y z")], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_fills_every_coordinate_and_estimates():
    import numpy as np

    a = near_dedup.mix(np.arange(1, 301, dtype=np.uint64))
    b = near_dedup.mix(np.arange(61, 361, dtype=np.uint64))
    s = near_dedup.sketch(np.repeat([0, 1, 2], [300, 300, 1]), np.concatenate([a, b, a[:1]]), 3)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.1
