"""The pipeline against plain Python versions of its stages, on the driver's smallest documents."""

import hashlib
import zlib

import numpy as np
from public_tokenizers import path
from test_decontaminate import brute as hits
from test_near_dedup import brute as groups
from tokenizers import Tokenizer

import corpus_pipeline
from sedimenta.llm import toxicity

SF = "/root/testdata/sf0.001"


def cut(rows, length=100):
    """(id, text) without bytes under a string that also starts earlier."""
    seen, out = set(), []
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            h = hashlib.md5(raw[p : p + length]).digest()
            if h in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(h)
        out.append((i, bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_stages_follow_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]


def test_run_equals_plain_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    flagged = {r.rest.doc_id: r.flagged for r in toxicity.score(docs, model).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not flagged[r.doc_id]]
    kept = {r[0] for r in groups(rows, 80) if r[3]}
    rows = cut([r for r in rows if r[0] in kept])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in hits(rows, items) if not r[5]}
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = set()
    for i, text in rows:
        if i in clean:
            ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
            want |= {(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
