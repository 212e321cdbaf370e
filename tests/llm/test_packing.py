import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from sedimenta.llm.packing import pack, plan
from sedimenta.llm.wordtokens import Encoder

FILE = path("word_bpe_49k.json")


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghéÉß'0123.,-!ñ") for _ in range(r.randint(1, 9)))
    out = [" ".join(word() for _ in range(r.choice([1, 10, 100, 3000]))) for _ in range(n)]
    return out + ["", None, "it's we'll I'D 'S ''s", "a\x85b c d", "ΣΟΦΟΣ İ ǅ", "<|startoftext|> x <|endoftext|>", "日本語 text", "é \x1c y", "ĲŁ ŉ Ǆ", out[0], out[0]]


def test_ids_are_the_tokenizers():
    t, e = Tokenizer.from_file(FILE), Encoder(FILE, words=50)
    for x in texts(1):
        assert np.frombuffer(e.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [{}, {"max_docs": 5}, {"max_cost": 900_000}, {"max_docs": 7, "max_cost": 2_000_000, "rule": "norm"}])
def test_pieces_round_trip_and_limits(spark, limits):
    rows = list(enumerate(texts(2)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pack(df, FILE, capacity=1000, **limits).collect()
    t = Tokenizer.from_file(FILE)
    want = set()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, s, len(ids[s : s + 1000]), zlib.crc32(ids[s : s + 1000].tobytes())) for k, s in enumerate(range(0, len(ids), 1000))}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1000 and len(parts) <= limits.get("max_docs", 10**9)
        assert len(parts) == 1 or sum(n * n for _, n in parts) <= limits.get("max_cost", 10**12)
    if not limits:
        assert len(seqs) <= -(-sum(r.length for r in got) // 1000) + 2


def test_plan_is_tight():
    r = random.Random(5)
    counts = {}
    for _ in range(20000):
        n = min(4096, int(r.lognormvariate(6, 1.2)) + 1)
        counts[n] = counts.get(n, 0) + 1
    runs = plan(counts)
    total = sum(n * c for n, c in counts.items())
    assert max(s + c for _, _, c, s, _ in runs) <= -(-total // 4096) * 1.005 + 1
    assert sum(c for _, _, c, _, _ in runs) == 20000


def test_null_repeated_and_clashing(spark):
    df = spark.createDataFrame([(None, "a b", 1, 2), (1, "a b", 1, 2), (1, "a b", 1, 2), (1, "c", 1, 2)], "doc_id long, text string, length int, offset int")
    got = pack(df, FILE).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert pack(df.limit(0), FILE).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_the_vector_fit_scores_all_open_states(rule):
    """Against a plain version that places piece by piece and scores every open bin."""
    r = random.Random(5)
    counts = {n: r.randint(1, 4) for n in r.sample(range(1, 200), 60)}
    cap, docs, cost, w = 200, 9, 45_000, (1.0, 2.0, 3.0)
    limits, scale = np.array([cap, docs, cost], float), np.array(w) / np.array([cap, docs, cost], float)
    runs = plan(counts, cap, docs, cost, rule, w)
    left: dict[int, list] = {}
    for n, _, count, seq, offset in runs:  # every run goes to a state than which no open one with room is better
        need = np.array([n, 1.0, n * n])
        value = lambda s: float(((1 - s / limits) * scale) @ need if rule == "dot" else -(((s - need) * scale) ** 2).sum())  # noqa: E731, B023
        room = [value(s) for s in (np.array(v, float) for v in left.values()) if (s >= need).all() and s[0] > 0]
        for q in range(seq, seq + count):
            mine = left.setdefault(q, [cap, docs, cost])
            assert offset == cap - mine[0]
            if mine[0] < cap and q == seq:
                assert value(np.array(mine, float)) == pytest.approx(max(room))
            left[q] = [mine[0] - n, mine[1] - 1, mine[2] - n * n]
            assert min(left[q]) >= 0
