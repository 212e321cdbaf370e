"""Importance resampling against a plain version: features, CRCs, gains, ranks."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sedimenta.llm import resampling as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in docs for f in features(t, longest))
    t = Counter(of(f) for x in target for f in features(x, longest))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    rows = []
    for doc, text in docs:
        fs = features(text, longest)
        weight = sum(gain(of(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(words(text)), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ok = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(ok[: percent * len(ok) // 100])}
    return [(*r, rank.get(id(r))) for r in rows]


def texts(n, seed, longest=80):
    rng = np.random.default_rng(seed)
    pool = [f"w{k}" for k in range(200)] + ["Ünï", "日本", "A-B", "CAFÉ"]
    return [" ".join(rng.choice(pool, int(rng.integers(0, longest)))) for _ in range(n)]


@pytest.mark.parametrize("longest, nodes", [(1, R.NODES), (3, R.NODES), (3, 500)])
def test_against_plain_version(spark, longest, nodes):
    docs, target = list(enumerate(texts(300, 1))), texts(20, 2)
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, nodes=nodes, buckets=997)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())) == sorted(brute(docs, target, longest, 997))


def test_trie_holds_counts_and_states():
    trie = R.WordTrie(3)
    raw = [b"a b a b c", b"b c", b"", b"a"]
    trie.count_in(R.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), R.NOT_ALNUM))
    want = Counter(f for t in raw for f in features(t.decode(), 3))
    got = {int(c): int(n) for crc, count in zip(trie.crc, trie.count, strict=True) for c, n in zip(crc, count, strict=True)}
    assert got == {zlib.crc32(f.encode()): n for f, n in want.items()}


def test_odd_rows(spark):
    long = " ".join(f"a{k}" for k in range(400_000))
    some = " ".join(["word"] * 25)
    docs = [(1, None, 1, 1), (2, "", 1, 1), (3, " ..\n", 1, 1), (4, some, 1, 1), (4, some, 1, 1), (None, some, 1, 1), (5, long, 1, 1), *((10 + k, f"{some} x{k}", 1, 1) for k in range(30))]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int, _part int")
    t = spark.createDataFrame([("word word",), (None,)], "text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in R.resample(d, t).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in docs], ["word word", None]), key=key)
    assert R.resample(d.limit(0), t).collect() == []
    assert {r.weight for r in R.resample(d.filter("doc_id < 4"), t.limit(0)).collect()} == {0}


def test_ranks_follow_one_order(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "pmod(xxhash64(id), 50) as v")
    got = R.ranked(rows, [R.F.col("v").desc(), R.F.col("id")], "rank").collect()
    want = {r.id: k + 1 for k, r in enumerate(sorted(got, key=lambda r: (-r.v, r.id)))}
    assert {r.id: r["rank"] for r in got} == want
