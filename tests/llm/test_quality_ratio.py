"""op4's mean ratio and verdict against a plain version: n-grams counted one by one with the xxhash library."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash

from sedimenta.llm import quality_rules as Q

LOW = 1 << 63


def signed(x):
    return x - (1 << 64) if x >= LOW else x


def word_hash(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), 42))


def pair_hash(a, b):
    seed = xxhash.xxh64_intdigest((a % (1 << 64)).to_bytes(8, "little"), 42)
    return signed(xxhash.xxh64_intdigest((b % (1 << 64)).to_bytes(8, "little"), seed))


def grams(text):
    h = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [x % Q.BUCKETS for x in h] + [pair_hash(a, b) % Q.BUCKETS for a, b in zip(h, h[1:])]


def test_mean_ratio_and_verdict(spark):
    r = random.Random(2)
    good, bad = "the river runs past old stone houses in spring".split(), "win cash now click here free prize offer".split()
    docs = [(i, " ".join(r.choices(good if i % 3 else good + bad, k=r.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "naïve café")]
    labels = [(i, int(i % 3 > 0)) for i in range(40)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    trusted = {i for i, q in labels if q}
    t, all_ = Counter(g for i, x in docs if i in trusted for g in grams(x)), Counter(g for _, x in docs for g in grams(x))
    nt, nr = (sum(c.values()) + Q.SMOOTHING * Q.BUCKETS for c in (t, all_))
    ratio = lambda b: math.log((t[b] + Q.SMOOTHING) / nt) - math.log((all_[b] + Q.SMOOTHING) / nr)
    mean = {i: sum(map(ratio, grams(x))) / len(grams(x)) if grams(x) else 0.0 for i, x in docs}
    scores = sorted(mean[i] for i in trusted)
    at = Q.QUANTILE * (len(scores) - 1)
    cut = scores[int(at)] + (at - int(at)) * (scores[min(int(at) + 1, len(scores) - 1)] - scores[int(at)])
    model = Q.fit(d, lab)
    assert model.threshold == pytest.approx(cut, abs=1e-4)
    for row in Q.judge(d, model).collect():
        assert row.mean_ratio == pytest.approx(mean[row.doc_id], abs=1e-4)
        assert row.kept == (not row.base_failed and row.mean_ratio >= model.threshold)


def test_all_trusted_documents_count(spark):
    """More than 10,000 of them; the quantile is percentile()'s."""
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat('a b w', id) AS text")
    model = Q.fit(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert max(map(abs, model.ratios)) < 1e-12
    scores = spark.range(1501).selectExpr("(id * 7919 % 1501) * 0.37D AS s")
    for n in (1, 2, 201, 777, 1501):
        some = scores.orderBy("s").limit(n)
        assert Q._low_quantile(some, n) == some.selectExpr(f"percentile(s, {Q.QUANTILE})").first()[0]
