"""Ranked search against a plain version, and its parts."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from sedimenta.llm import ranked_search as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    counts = [Counter(terms(t)) for _, t in docs]
    lens = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(n > 0 for n in lens), sum(lens)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, n in zip(docs, counts, lens, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + 75 * n * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(found)[:top])]
    return out


def rows(n: int, seed: int):
    rng = np.random.default_rng(seed)
    words = ["w%d" % k for k in range(60)] + ["Été", "naïve", "ÀB", "x_y", "日本"]
    weights = 1 / np.arange(1, len(words) + 1)
    return [(int(k), " ".join(rng.choice(words, int(rng.integers(0, 60)), p=weights / weights.sum())).replace("w3 ", "W3-")) for k in rng.permutation(n)]


@pytest.mark.parametrize("block, entries", [(S.BLOCK, S.ENTRIES), (200, 50)])
def test_against_plain_version(spark, block, entries):
    docs, items = rows(300, 1), rows(25, 2)
    docs += [(1000 + k, docs[5][1]) for k in range(40)]  # equal scores
    got = S.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), block=block, entries=entries)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == sorted(brute(docs, items))


def test_odd_rows(spark):
    long = " ".join(f"a{k}" for k in range(300_000))
    docs = [(1, None, 1), (2, "", 1), (3, " \t.,", 1), (4, "the cat", 1), (4, "the cat", 1), (None, "the cat", 1), (5, long, 1), (6, "dog", 1), (7, "dog bird", 1)]
    items = [(1, None, 1), (2, "...", 1), (3, "cat", 1), (3, "cat cat", 1), (None, "a7 a8", 1), (9, "zebra", 1)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item int"), spark.createDataFrame(items, "item_id long, text string, score int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in S.ranked_search(d, i).collect()]
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in docs], [r[:2] for r in items]), key=key)
    assert S.ranked_search(d.limit(0), i).collect() == S.ranked_search(d, i.limit(0)).collect() == S.ranked_search(d.filter("doc_id < 4"), i).collect() == []


def test_ids_of_any_type(spark):
    docs = [("b", "x"), ("a", "x"), (None, "x"), ("c", "y")]
    got = S.ranked_search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("q", "x")], "item_id string, text string"))
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


def test_radix_order():
    for most in (0, 1, 65_535, 65_536, 10**7, 2**40, 2**48 + 5):
        x = np.random.default_rng(5).integers(0, most + 1, 5000)
        assert (S.radix_order(x, most) == np.argsort(x, kind="stable")).all()
