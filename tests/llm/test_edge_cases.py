"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for each operator on documents."""

import public_tokenizers as P
import pytest

from sedimenta.llm import compression_quality, decontaminate, licenses, near_dedup, packing, quality_rules, suffix_dedup, token_counts, toxicity

TEN_MB = "".join(f"w{k} " for k in range(1_500_000))
ROWS = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (None, "same text here"), (4, " " * 5_000_000), (5, TEN_MB)]
#: Names that the operators use for columns of their own.
CLASHING = ("id", "key", "rest", "spans", "cls", "text_", "length", "pad", "__", "s")


@pytest.fixture(scope="module")
def tables(spark):
    own = ", ".join(f"{c} int" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in ROWS], f"doc_id long, text string, {own}").repartition(3)
    train = spark.createDataFrame([(k, f"good plain words {k}" if k % 2 else f"vile nasty words {k}") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text"), (2, "w7 w8 w9")], "item_id long, text string")
    return docs, toxicity.fit(train, labels), compression_quality.fit(train, labels), quality_rules.fit(train, labels), bench


def operators(tables):
    docs, toxic, quality, rules, bench = tables
    return {
        "toxicity": lambda d: toxicity.score(d, toxic),
        "near": lambda d: near_dedup.near_duplicates(d),
        "rules": lambda d: quality_rules.judge(d, rules),
        "tokens": lambda d: token_counts.section_tokens(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "passages": lambda d: suffix_dedup.suffix_dedup(d),
        "quality": lambda d: compression_quality.score(d, quality),
        "packing": lambda d: packing.pack(d, P.path("word_bpe_49k.json")),
        "benchmark": lambda d: decontaminate.contamination(d, bench, carry=True),
        "licenses": lambda d: licenses.license_scan(d),
    }


@pytest.mark.parametrize("name", ["toxicity", "tokens", "quality", "licenses"])
def test_every_row_has_a_result(tables, name):
    run = operators(tables)[name]
    assert run(tables[0]).count() == len(ROWS)
    assert run(tables[0].limit(0)).count() == 0


def test_results_of_odd_texts(tables):
    docs, run = tables[0], operators(tables)
    near = {(r.doc_id, r.n_shingles, r.component_id) for r in run["near"](docs).collect()}
    assert near == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (None, 1, 3), (4, 0, 4), (5, 1_499_996, 5)}
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in run["passages"](docs).collect() if r.doc_id in (1, 4, 5)}
    assert got == {1: (0, 0), 4: (5_000_000, 4_999_999), 5: (len(TEN_MB), 0)}
    words = {r.doc_id: r.n_words for r in run["rules"](docs).collect()}
    assert (words[1], words[4], words[5]) == (0, 0, 1_500_000)
    hits = {r.doc_id: r.n_hit for r in run["benchmark"](docs).collect()}
    assert (hits[1], hits[3], hits[5]) == (0, 2, 3)
    tokens = {r.doc_id: r.t for r in run["packing"](docs).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "t").collect()}
    assert tokens[1] == tokens[2] == tokens[4] == 1 and tokens[5] > 1_500_000
