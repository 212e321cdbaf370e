import hashlib
import random
import re

import numpy as np
import pytest

from sedimenta.llm import decontaminate
from sedimenta.llm.decontaminate import contamination, stage


def words(t):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(10, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1) if v else ():
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abÉç1") for _ in range(2))
    para = lambda n: r.choice([" ", ", ", "\n-"]).join(word() for _ in range(n))
    items = [(k, para(r.choice([1, 3, 9, 10, 11, 40]))) for k in range(25)] + [(99, None), (98, "..."), (5, para(20))]
    docs = []
    for i in range(80):
        parts = [para(r.randint(0, 40)) for _ in range(3)]
        if r.random() < 0.5:
            v = r.choice(items)[1] or ""
            a = r.randint(0, len(v) // 2)
            parts.insert(1, v[a:].upper() if r.random() < 0.3 else v)
        docs.append((i, " ".join(parts)))
    return docs + [(80, None), (81, ""), (80, docs[0][1]), (None, docs[1][1])], items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [1 << 20, 300])
def test_equals_brute_force(spark, seed, block):
    docs, items = data(seed)
    d = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, rest int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b, block=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    out = stage_of(spark, d, b)
    assert out.columns == d.columns and out.count() == sum(not r[-1] for r in brute(docs, items))


def stage_of(spark, d, b):
    out = contamination(d, b, carry=True).filter("not contaminated")
    return out.selectExpr("doc_id", "text", "rest.rest")


def test_longest_match_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "x y " + "a b c d e f g h i j k l m n".upper() + " z")], "doc_id long, text string")
    b = spark.createDataFrame([(4, "q a b c d e f g h i j k l m"), (3, "a b c d e f g h i j k")], "item_id long, text string")
    r = contamination(d, b).first()
    assert r.longest.asDict() == {"item_id": 4, "start": 2, "words": 13} and r.n_hit == 13 and r["items"] == [3, 4]
    assert not contamination(d, b.limit(0)).first().contaminated
    assert contamination(d.limit(0), b).count() == 0


def test_string_ids_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "one two three", 1, 2)], "doc_id long, text string, __ int, pad int")
    b = spark.createDataFrame([("b,x", "two three"), ("a", "ONE"), (None, "two"), ("10", "four")], "item_id string, text string")
    r = contamination(d, b, carry=True, block=4).first()
    assert r["items"] == ["a", "b,x"] and r.items_sha256 == hashlib.sha256(b"a,b,x").hexdigest() and r.longest.item_id == "b,x"
    assert (r.rest["__"], r.rest["pad"], r.n_hit) == (1, 2, 3)


def test_suffix_array_is_sorted():
    r = np.random.default_rng(0)
    w = decontaminate.U(1 << 48) * r.integers(2, 9, 400).astype(np.uint64) * decontaminate.U(2)
    doc = np.repeat(np.arange(8), 50)
    order, _ = decontaminate.suffix_array(w, doc, 10)
    suffix = lambda i: [int(x) for x, d in zip(w[i : i + 10], doc[i : i + 10]) if d == doc[i]]
    rows = [suffix(i) for i in order]
    assert rows == sorted(rows) and len(set(order.tolist())) == 400


def test_sql_agrees(spark, tmp_path):
    import duckdb

    docs, items = data(9)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(decontaminate.OP9_SQL)
    assert sorted(map(tuple, cur.fetchall()), key=str) == brute(docs, items)
    got = decontaminate.op9_decontamination(spark, str(tmp_path))
    assert got.columns == [x[0] for x in cur.description]
    assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == sum(not r[-1] for r in brute(docs, items))
