import zlib

import numpy as np
import pytest

from sedimenta.llm import toxicity

SF = "/root/testdata/sf0.1"


def held(rows, labels, mod, rest, name):
    pairs = [(r, labels[r.doc_id]) for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % mod == rest]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    s, y = np.array([r.score for r, _ in pairs]), np.array([x[name] for _, x in pairs])
    rank = np.empty(len(s))
    rank[np.argsort(s)] = np.arange(len(s))
    return s, y, (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_held_out_accuracy(spark, labels):
    rows = toxicity.op1_toxicity(spark, SF).collect()
    s, y, auc = held(rows, labels, 4, 2, "toxic")
    print("toxicity auc", auc, "recall", (s[y == 1] >= 0.3).mean(), "false", (s[y == 0] >= 0.3).mean())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert auc > 0.9 and (s[y == 1] >= 0.3).mean() > 0.7 and (s[y == 0] >= 0.3).mean() < 0.03


def test_score_depends_on_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = [(None, "you idiot moron", None, None), (1, "you idiot moron", "de", "x"), (1, None, "en", "x"), (2, "", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = toxicity.score(df, m).collect()
    assert out[0].score == out[1].score and out[2].score == out[3].score and out[0].rest.score is None


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, m).first().score == 0
    assert toxicity.score(docs.limit(0), m).count() == 0


def test_gradients_learn_a_word():
    from sedimenta.llm.bytetext import column
    import pyarrow as pa

    texts = ["good day to you", "bad idiot day", "fine day", "idiot that is"] * 30
    ids, of = toxicity.features(*column(pa.record_batch([pa.array(texts)], ["text"]), "text"))
    m = toxicity.train(ids, of, np.array([0, 1, 0, 1] * 30), np.ones(120))
    p = m.score(ids, of)
    assert p[1] > 0.8 and p[3] > 0.8 and p[0] < 0.2 and p[2] < 0.2


def test_forward_pass_equals_a_plain_one(monkeypatch):
    """Word by word and filter by filter; the same in blocks of any size."""
    r = np.random.default_rng(3)
    texts = ["", "one", "a b c d e f g", "vile words in a longer text here and there " * 9, "x y"]
    import pyarrow as pa

    data, offs = toxicity.column(pa.record_batch([pa.array(texts)], ["t"]), "t")
    ids, of = toxicity.features(data, offs)
    m = toxicity.train(ids, of, np.array([0, 1, 0, 1, 0]), np.ones(5), epochs=2)
    m.bias = r.normal(size=len(m.bias)).astype(np.float32)
    want = []
    for i in range(len(texts)):
        x = m.emb[ids[of[i] : of[i + 1]]].sum(axis=1)
        n = len(x) - toxicity._PADS
        top = [max([0.0, *(sum(x[p + j] @ w[j][:, f] for j in range(len(w))) + m.bias[k * toxicity.FILTERS + f] for p in range(n))]) for k, w in enumerate(m.filters) for f in range(toxicity.FILTERS)]
        want.append(np.array(top) @ m.out + m.out_bias)
    for block in (3, 7, 1 << 16):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(m.raw(ids, of), want, atol=1e-4)
