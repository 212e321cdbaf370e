import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import common, quality_rules, url_filter

RULES = url_filter.RULES


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {p for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé#|日😀") for _ in range(r.randint(1, 3)))
    line = lambda: r.choice([" ", "\t ", "\x0b"]).join(word() for _ in range(r.randint(0, 30)))
    out = []
    for _ in range(60):
        ls = [line() for _ in range(r.randint(1, 6))]
        out.append("\n".join(r.choice(ls) for _ in range(r.randint(1, 9))))
    return out + [None, "", " \n\t", "a " * 500, "one two three four five six seven eight one two three four five six seven eight", "x\u00a0y \u2003 z", "\x00 a"]


@pytest.mark.parametrize("seed", [1, 2])
def test_statistics_equal_brute_force(spark, seed):
    rows = list(enumerate(texts(seed))) + [(None, "a b"), (0, "dup")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_words int").repartition(3)
    m = quality_rules.fit(df, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    got = quality_rules.judge(df, m).collect()
    key = lambda x: str(x)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=key) == sorted(((i, *base(t)) for i, t in rows), key=key)
    assert all(r.kept == (not r.base_failed and r.mean_ratio >= m.threshold) for r in got)


def test_ratio_prefers_trusted_text(spark):
    r = random.Random(3)
    good = [" ".join(r.choice(["calm", "river", "stone", "meadow"]) for _ in range(60)) for _ in range(40)]
    bad = [" ".join(r.choice(["###", "buy", "click", "$$$"]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    m = quality_rules.fit(df, spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)], "doc_id long, quality int"))
    s = {x.doc_id: x.mean_ratio for x in quality_rules.judge(df, m).collect()}
    assert min(s[i] for i in range(40)) > max(s[i] for i in range(40, 80))


def test_quality_rules_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    m = quality_rules.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_rules.judge(df, m).first().mean_ratio == 0
    assert quality_rules.judge(df.limit(0), m).count() == 0


def split(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fit = [(len(r), r, v) for v, r in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "http://x.org", "http://x.org/", "https://shop.com/de/a", "https://shop.com/fr/a", "ftp://com/de/", "http://notcom/de/", "", None, "example.org/es/", "http://a://b/c", "http://ünï.org/é", "http://h.net/#/es/", "x://y.org?q=/es/", "http://e.com/DE/", "http://a.com\n/de/"]


def test_rules_and_verdicts(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])] + [(100 + i, f"http://s{i}.org/en/{i}") for i in range(60)] + [(200 + i, f"http://t{i}.com/de/{i}") for i in range(60)] + [(300 + i, f"http://n{i}.net/{'de' if i % 2 else 'en'}/{i}") for i in range(40)]
    df = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, host string")
    m = url_filter.fit(df)
    got = url_filter.judge(df, m).collect()
    want = sorted(((i, *split(u), rule(*split(u))[0]) for i, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == want
    for r in got:
        assert r.verdict == (dict((b, a) for a, b in RULES)[r.rule] if r.rule else "allow" if r.score >= m.cut else "block")
    verdict = {r.page_id: r.verdict for r in got}
    assert sum(verdict[i] == ("block" if i % 2 else "allow") for i in range(300, 340)) >= 36


def test_scores_count_each_context_by_itself(spark):
    """Scores of exact contexts, on more of them than any table of 1,024 has."""
    r = random.Random(5)
    chars = "abcdefghijklmnopqrstuvwxyz0123456789-_éü日"
    part = lambda: "".join(r.choice(chars) for _ in range(r.randint(3, 12)))
    words = [part() for _ in range(150)]
    url = lambda: f"http://{r.choice(words)}.{r.choice(['org', 'com', 'net'])}/{r.choice(['de', 'en', 'fr'])}/{r.choice(words)}/{part()}"
    rows = [(i, url()) for i in range(1, 1500)] + [(None, None), (0, ""), (0, ""), (9999, "http://x.org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    held = {x.url for x in df.filter("pmod(xxhash64(url), 5) = 0").collect()}
    verdict = {u: rule(*split(u))[1] for _, u in rows}
    n, total = Counter(), Counter()
    pad = lambda u: "\x02" * 4 + (u or "") + "\x03"
    for _, u in rows:
        if verdict[u] and u not in held:
            for i in range(4, len(pad(u))):
                for k in range(1, 5):
                    n[verdict[u], pad(u)[i - k : i + 1]] += 1
                    total[verdict[u], pad(u)[i - k : i]] += 1
    contexts = {c for _, c in total}
    assert sum(len(c) == 4 for c in contexts) > 1024
    size = 0.5 * (1 + len({t[1] for _, t in n if len(t) == 2}))

    def ratio(t):
        for k in range(4, 0, -1):
            c = t[4 - k : 4]
            if total["allow", c] + total["block", c] >= 8:
                p = [math.log((n[v, t[4 - k :]] + 0.5) / (total[v, c] + size)) for v in ("allow", "block")]
                return p[0] - p[1]
        return 0.0

    for x in url_filter.judge(df, url_filter.fit(df)).join(df.select("page_id", "url"), "page_id").collect():
        p = pad(x.url)
        if x.page_id not in (0, None):
            assert x.score == pytest.approx(sum(ratio(p[i - 4 : i + 1]) for i in range(4, len(p))) / (len(p) - 4), abs=1e-5)
    assert url_filter.judge(df, url_filter.fit(df)).count() == len(rows)


def test_url_filter_without_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(df, url_filter.fit(df)).count() == 0


def test_long_urls(spark):
    """Places of long URLs by a plain version; a URL of 2 million characters takes seconds."""
    r = random.Random(7)
    urls = ["", "a", "http://x.org/" + "".join(r.choice("abc/é日😀\n") for _ in range(3 * url_filter.PIECE + 3)), "😀" * (url_filter.PIECE - 5), "b" * url_filter.PIECE]
    df = spark.createDataFrame(list(enumerate(urls)), "row int, u string")
    got = Counter((x["row"], x.text) for x in url_filter._places(df, "row").collect())
    want = Counter()
    for k, u in enumerate(urls):
        p = "\x02" * 4 + u + "\x03"
        want.update((k, p[i - 4 : i + 1]) for i in range(4, len(p)))
    assert got == want
    rows = [(1, "http://long.net/" + "".join(r.choice("abcdef/") for _ in range(2_000_000)))] + [(100 + i, f"http://s{i}.{'org/en' if i % 2 else 'com/de'}/{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    began = time.time()
    got = {x.page_id: x for x in url_filter.judge(df, url_filter.fit(df)).select("page_id", "host", "rule", F.length("path").alias("n")).collect()}
    assert time.time() - began < 120
    assert (got[1].host, got[1].rule, got[1].n, len(got)) == ("long.net", None, 2_000_001, 81)


def test_no_python_in_the_plans(spark, monkeypatch):
    """Neither in what the operators return nor in the steps that they run."""
    plans = []
    keep = lambda f: lambda self, *a, **b: plans.append(self._jdf.queryExecution().executedPlan().toString()) or f(self, *a, **b)
    for name in ("collect", "count", "first", "toArrow"):
        monkeypatch.setattr(DataFrame, name, keep(getattr(DataFrame, name)))
    monkeypatch.setattr(common, "_written", lambda df, path, f=common._written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, path))
    docs = spark.createDataFrame([(k, f"good words {k}" if k % 2 else f"bad words {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()
    pages = spark.createDataFrame([(k, f"http://s{k}.{'org/en' if k % 2 else 'com/de'}/{k}") for k in range(60)], "page_id long, url string")
    url_filter.judge(pages, url_filter.fit(pages)).collect()
    assert len(plans) > 10 and not [p for p in plans if re.search("Python|Pandas|Arrow|BatchEval", p)]
