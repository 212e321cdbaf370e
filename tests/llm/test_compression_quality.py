import numpy as np
from test_toxicity import SF, held, labels  # noqa: F401

from sedimenta.llm import compression_quality as cq


def test_held_out_accuracy(spark, labels):  # noqa: F811
    rows = cq.op7_quality_classifier(spark, SF).collect()
    s, y, auc = held(rows, labels, 5, 0, "quality")
    print("quality auc", auc, "kept", (s[y == 1] >= 0.3).mean(), "bad kept", (s[y == 0] >= 0.3).mean())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert auc > 0.95 and (s[y == 1] >= 0.3).mean() > 0.98 and (s[y == 0] >= 0.3).mean() < 0.35


def test_text_alone_nulls_and_clashes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = cq.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    df = spark.createDataFrame([(None, "a b c", "x"), (1, "a b c", None), (1, None, "y"), (2, "", "z")], "doc_id long, text string, score string")
    out = cq.score(df, m).collect()
    assert out[0].score == out[1].score and out[2].score == out[3].score and out[0].rest.score == "x"
    assert cq.score(df.limit(0), m).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    m = cq.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert cq.score(docs, m).first().score == 0


def test_raw_score_is_the_size_difference():
    good, bad = ([" ".join(f"{w}{(i * k) % 97}" for k in range(1, 60)).encode() for i in range(200)] for w in ("calm", "###$"))
    m = cq.Model(cq.dictionary(good), cq.dictionary(bad))
    r = m.raw([good[3], bad[3], b""])
    assert r[0] > 0 > r[1] and np.isfinite(r).all()
