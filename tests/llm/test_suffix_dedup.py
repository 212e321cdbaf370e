import hashlib
import random

import pytest

from sedimenta.llm.suffix_dedup import stage, suffix_dedup


def brute(rows, length):
    """Each byte under a string that also starts earlier; rows in order of (id, text)."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw = (t or "").encode()
        cut = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                cut[p : p + length] = b"\1" * length
            seen.add(w)
        left = bytes(b for b, c in zip(raw, cut) if not c)
        n_spans = sum(1 for p in range(len(cut)) if cut[p] and (p == 0 or not cut[p - 1]))
        out.append((i, len(raw), sum(cut), n_spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    para = lambda k: " ".join(word() for _ in range(k))
    shared = [para(r.randint(20, 80)) for _ in range(4)]
    docs = [(i, " ".join(r.choice(shared) if r.random() < 0.4 else para(r.randint(1, 60)) for _ in range(r.randint(0, 5)))) for i in range(n)]
    return docs + [(n, "x" * 700), (n + 1, "ab" * 300), (n + 2, None), (n + 3, ""), (n + 4, docs[3][1]), (n + 5, shared[0][:99] + "ééé" * 60)]


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 100), (1, 287), (2, 400)])
def test_equals_brute_force(spark, seed, length):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup(df, length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_lengths_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="length"):
        suffix_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=1 << 16)


def test_long_text_in_pieces(spark):
    """2.3 MB, worked on in pieces of 1 MB: passages over the border of two pieces and in the last one are found."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh") for _ in range(150))
    text = list("".join(r.choice("ijklmnop") for _ in range(2_300_000)))
    places = (10, (1 << 20) - 60, 2_250_000)
    for k, at in enumerate(places):
        text[at : at + 152] = [str(k), *passage, str(k)]
    got = suffix_dedup(spark.createDataFrame([(7, "".join(text)), (8, passage[:120])], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x.start, x.end) for x in got[0].removed] == [(p + 1, p + 151) for p in places[1:]]
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_text) == (120, 1, "")


def test_repeated_and_null_ids_and_clashing_columns(spark):
    rows = [(None, "q" * 50 + "w" * 120), (1, "w" * 130), (1, "w" * 130), (1, "z" * 99)]
    df = spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows], "doc_id long, text string, key int, rest string, __ int, pad int")
    got = suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 100)
    out = stage(spark, df, "")
    assert out.columns == df.columns and out.count() == 4


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_keys_are_few_and_lose_no_link(spark):
    from sedimenta.llm.common import SHARE, hot_keys, spread_join

    big = spark.range(2000).selectExpr("id as key", "cast(if(id % 3 = 0, 0, id) as long) as gram")
    counts = big.groupBy("gram").count()
    hot = hot_keys(counts, "gram", "count")
    assert hot == [0] and len(hot) <= SHARE and hot_keys(counts.limit(0), "gram", "count") == []
    small = counts.filter("count > 1").select("gram")
    assert spread_join(big, small, ["gram"], "gram", hot, ["key"], "left_semi").count() == 667
    assert spread_join(big, counts, ["gram"], "gram", hot, ["key"]).select("key", "gram", "count").distinct().count() == 2000
