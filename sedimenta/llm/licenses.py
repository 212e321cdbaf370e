"""License scans by conditional compression.

Each word of license wording in a text opens a window that reaches as many words to either side as the longest template
may take, over line ends and comment marks. All
templates that may be there are confirmed; of those that fit as well, the one counts with which as a raw zstandard
dictionary the window saves most bytes. What is left on both sides of a finding is scanned like the rest. Templates are confirmed by the exact differences in wording: words
of the template that its part of the window lacks, and words that it has in between; a finding is that part alone.
Every word of every text is looked at."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sedimenta.llm.common import mapped, table

# Notices and opening paragraphs of public licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words that make one license another: versions, clauses and variants. None may be missing from a finding or added to it.
KEYS = r"v?\d+(?:\.\d+)*\.?|\d+-clause|by-[a-z-]+|sa|nc|nd|lesser|library|affero"
CUES = r"(?i)licen[cs]|copyright|permission|redistribut|public[\W_]+domain|free[\W_]+software|\bCC[\W_]"
#: Largest share of a template's words that may be missing.
MISSING = 0.2
LEVEL = 3

_word = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
_key = re.compile(KEYS)
_marks = re.compile(r"[^\w\s]*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _word.findall(text)]


class Scanner:
    def __init__(self, templates=TEMPLATES, missing: float = MISSING):
        self.templates, self.missing = templates, missing
        self.words = [words(t) for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.reach = max((len(w) + self.slack(len(w)) for w in self.words), default=0)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.cue = re.compile(CUES)
        self.known: dict[str, tuple] = {}

    def rank(self, block: str) -> list[tuple[int, int]]:
        """(saved bytes, template) from the best on; ties by the templates' order."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        return sorted(((alone - len(c.compress(raw)), k) for k, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def slack(self, n: int) -> int:
        """Most words that a confirmed part may have besides those of a template of n words."""
        return int(max(1, self.missing * n))

    def confirm(self, have: list[str], k: int) -> tuple[list[str], list[str], int, int] | None:
        """(missing, added, start, end) of the part of the words that is closest to the template, or None if too many
        words are missing or added everywhere. Looks around the longest common run first, then on both sides of it."""
        want = self.words[k]
        least, slack = (1 - self.missing) * len(want), self.slack(len(want))
        todo, best = [(0, len(have))], None
        while todo:
            a, b = todo.pop()
            if (self.counts[k] & Counter(have[a:b])).total() < max(1, least):
                continue
            run = SequenceMatcher(None, want, have[a:b], autojunk=False).find_longest_match()
            at = a + run.b
            lo, hi = max(a, at - run.a - slack), min(b, at - run.a + len(want) + slack)
            same = [m for m in SequenceMatcher(None, want, have[lo:hi], autojunk=False).get_matching_blocks() if m.size]
            same = _dense(same)
            i, j = lo + same[0].b, lo + same[-1].b + same[-1].size
            hit, inside = {m.a + x for m in same for x in range(m.size)}, {lo + m.b + x for m in same for x in range(m.size)}
            added = [have[x] for x in range(i, j) if x not in inside]
            gone = [w for x, w in enumerate(want) if x not in hit]
            if len(hit) >= least and len(added) <= slack and not any(map(_key.fullmatch, gone + added)):
                found = (gone, added, i, j)
                if best is None or len(found[0]) + len(added) < len(best[0]) + len(best[1]):
                    best = found
            else:
                todo += [(a, at), (at + run.size, b)]
        return best

    def winner(self, block: str) -> tuple | None:
        """(license, template, saved, missing, added, start, end), the last two in words: of the confirmed templates the
        one with fewest differences, then most saved."""
        if block in self.known:
            return self.known[block]
        best, have = None, words(block)
        count = Counter(have)
        able = {k for k, w in enumerate(self.words) if (self.counts[k] & count).total() >= (1 - self.missing) * len(w)}
        for saved, k in self.rank(block) if able else []:
            if saved > 0 and k in able and (diff := self.confirm(have, k)) is not None:
                mark = (len(diff[0]) + len(diff[1]), -saved, k)
                if best is None or mark < best[0]:
                    best = (mark, (self.templates[k][0], k, saved, *diff))
        if len(self.known) > 10_000:
            self.known.clear()
        self.known[block] = best and best[1]
        return self.known[block]

    def scan(self, text: str) -> list[dict]:
        """Findings of a text from left to right, none inside another."""
        out: list[dict] = []
        cues = [m.start() for m in self.cue.finditer(text)]
        if not cues:
            return out
        at = [m.span() for m in _word.finditer(text)]
        ends = [e for _, e in at]
        done, last = 0, -1
        for cue in cues:
            c = bisect_right(ends, cue)
            if c < done or c == last or c == len(at):
                continue
            last = c
            a, b = max(done, c - self.reach), min(len(at), c + self.reach + 1)
            while a < b and (w := self.winner(text[at[a][0] : at[b - 1][1]])):
                if a + w[6] <= c:
                    a += w[6]
                elif a + w[5] > c:
                    b = a + w[5]
                else:
                    out.append({"license": w[0], "start": at[a + w[5]][0], "end": _marks.match(text, at[a + w[6] - 1][1]).end(), "saved": w[2], "missing": w[3], "added": w[4]})
                    done = a + w[6]
                    break
        return out


def _dense(same: list) -> list:
    """The run of matching blocks with most words in blocks less words in the gaps between; stray ends fall off."""
    best, first, total = (0, 0, 0), 0, 0
    for i, m in enumerate(same):
        gap = m.b - same[i - 1].b - same[i - 1].size if i else 0
        total, first = (total - gap + m.size, first) if total >= gap and i else (m.size, i)
        best = max(best, (total, -first, i + 1))
    return same[-best[1] : best[2]]


_NAMES = ("license", "start", "end", "saved", "missing", "added")
_ARROW = pa.list_(pa.struct(list(zip(_NAMES, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True))))
_SPARK = ArrayType(StructType([StructField(n, t) for n, t in zip(_NAMES, (StringType(), LongType(), LongType(), LongType(), ArrayType(StringType()), ArrayType(StringType())), strict=True)]))


def _scan(templates, missing):
    def run(batches):
        s = Scanner(templates, missing)
        for batch in batches:
            found = [s.scan(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, _ARROW)], ["id", "findings"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, missing: float = MISSING) -> DataFrame:
    """Licenses named or quoted in texts.

    Returns a row for each row: id_col, licenses (distinct names, sorted), n_findings, findings (license, start and end in
    characters, saved bytes, missing and added words). Null and empty texts have none. Repeated rows and null ids are rows
    like others; other columns aren't read. An empty table gives an empty result."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = mapped(src, _scan(templates, missing), StructType([src.schema["id"], StructField("findings", _SPARK)]))
    names = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"])))
    return out.select(F.col("id").alias(id_col), names.alias("licenses"), F.size("findings").cast("long").alias("n_findings"), "findings")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents against all templates."""
    out = license_scan(table(spark, sf_dir, "documents"))
    first = F.get("findings", F.lit(0))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_findings", first["start"].alias("first_start"), first["end"].alias("first_end"), first["saved"].alias("first_saved"), F.size(first["missing"]).cast("long").alias("first_missing"))
