import random
import textwrap

import numpy as np
import public_tokenizers as P
import pytest

from sedimenta.llm import licenses, token_counts

FILE = P.path("byte_bpe_50k.tiktoken")


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日😀1") for _ in range(r.randint(1, 6)))
    return ["".join(word() + r.choice([" ", "\n", "\n\n\n", ".\n", "  ", "\r\n"]) for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", "\n", "\n\n", "a\n"]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_brute_force(spark, rule):
    rows = list(enumerate(texts(4))) + [(None, "x\ny")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, section int")
    got = {}
    for r in token_counts.section_tokens(df, FILE, P.PATTERN, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens)
    enc, _ = token_counts.encoding(FILE, P.PATTERN)
    for i, t in rows:
        lines = (t or "").splitlines(keepends=True) if "\r" not in (t or "") else [x + "\n" for x in t.split("\n")]
        if "\r" in (t or ""):
            lines[-1] = lines[-1][:-1]
            lines = lines if lines[-1] else lines[:-1]
        lines = lines or [""]
        owner = [k for k, x in enumerate(lines) for _ in x.encode()]
        want = np.zeros(len(lines))
        at = 0
        for tok in enc.encode_ordinary(t or ""):
            n = len(enc.decode_single_token_bytes(tok))
            own = owner[at : at + n]
            at += n
            if rule == "start":
                want[own[0]] += 1
            elif rule == "end":
                want[own[-1]] += 1
            elif rule == "share":
                for o in own:
                    want[o] += 1 / n
            else:
                want[max(set(own), key=lambda o: (own.count(o), -o))] += 1
        assert at == len(owner)
        mine = got[i]
        assert [mine[k][2] for k in range(len(lines))] == pytest.approx(want.tolist()), t
        assert "".join((t or "")[mine[k][0] : mine[k][1]] for k in range(len(lines))) == (t or "")
    assert token_counts.section_tokens(df.limit(0), FILE, P.PATTERN).count() == 0


def test_every_template_is_found_and_named():
    s = licenses.Scanner()
    for name, t in licenses.TEMPLATES:
        found = s.scan(f"some text\n{t}\nmore text")
        assert [(f["license"], f["start"], f["end"], f["missing"], f["added"]) for f in found] == [(name, 10, 10 + len(t), [], [])]


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
@pytest.mark.parametrize("width", [30, 72])
def test_every_wrapped_template_is_found(mark, width):
    s = licenses.Scanner()
    for name, t in licenses.TEMPLATES:
        lines = [mark + x for x in textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False)]
        text = "\n".join(["def f(x): this is the text before", *lines, "and the code of this file after it"])
        found = s.scan(text)
        assert [(f["license"], f["missing"], f["added"]) for f in found] == [(name, [], [])]
        assert licenses.words(text[found[0]["start"] : found[0]["end"]]) == licenses.words(t)


@pytest.mark.parametrize("seed", range(5))
def test_every_notice_of_one_line_is_found(seed):
    r = random.Random(seed)
    s = licenses.Scanner()
    filler = "the text of this work and all files under a version of the terms for any person or later use".split()
    want, parts = [], []
    for name, t in r.sample(licenses.TEMPLATES, 12):
        parts += [" ".join(r.choices(filler, k=r.randint(0, 90))), t]
        want.append((name, t))
    text = " ".join([*parts, "that is all"])
    found = s.scan(text)
    assert [(f["license"], licenses.words(text[f["start"] : f["end"]])) for f in found] == [(n, licenses.words(t)) for n, t in want]


VARIANTS = {
    "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"],
    "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
    "Licensed under CC BY 3.0.": [],
    "Licensed under the Apache License, Version 1.1.": [],
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"],
    "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
    "This work is licensed under the GNU General Public License, version 4.": [],
}


@pytest.mark.parametrize("text", VARIANTS)
def test_versions_and_variants_must_match(text):
    assert [f["license"] for f in licenses.Scanner().scan(text)] == VARIANTS[text]


def test_long_runs_of_white_space_and_two_patterns():
    enc, sizes = token_counts.encoding(FILE, P.PATTERN)
    for text in ("a" + " " * 9000 + "b", "x\n" + " " * 9500 + "\n y", "q" + "\t" * 9999):
        want = token_counts.spans(enc, sizes, text)[1]
        ids = [i for m in token_counts.regex.finditer(P.PATTERN, text) for i in enc._encode_single_piece(m[0])]
        assert np.cumsum(sizes[ids]).tolist() == want.tolist()
    assert token_counts.spans(enc, sizes, " " * 2_000_000 + "x")[1][-1] == 2_000_001
    assert token_counts.encoding(FILE, r"\S+|\s+")[0] is not enc


def test_two_licenses_side_by_side():
    text = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert [f["license"] for f in licenses.Scanner().scan(text)] == ["Apache-2.0", "MIT"]


def test_differences_and_lookalikes():
    s = licenses.Scanner()
    t = dict(reversed(licenses.TEMPLATES))["MIT"]
    assert s.scan("This work is licensed under the GNU General Public License, version 3.")[0]["license"] == "GPL-3.0"
    f = s.scan("This book is licensed under the GNU General Public License, version 3.")[0]
    assert f["missing"] == ["work"] and f["added"] == ["book"]
    assert s.scan("a driving license costs money\nno copyright here") == [] and t
    two = s.scan("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")
    assert {x["license"] for x in two} == {"CC-BY-NC-4.0", "MIT"}


def test_ranking_is_by_saved_bytes():
    s = licenses.Scanner()
    for k, (_, t) in enumerate(licenses.TEMPLATES):
        order = s.rank(t)
        assert order[0][0] >= order[-1][0] and k in [j for _, j in order[:4]]


def test_scan_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    out = licenses.license_scan(df).collect()
    assert sorted((str(r.doc_id), r.n_findings) for r in out) == [("1", 0), ("1", 1), ("1", 1), ("None", 0)]
    assert licenses.license_scan(df.limit(0)).count() == 0
    all_ = licenses.op10_license_scan(spark, "/root/testdata/sf0.01")
    named = [r for r in all_.collect() if r.n_findings]
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    cues = ("Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.")
    assert {r.doc_id for r in named} == {i for i, t in text.items() if any(c in t for c in cues)}
