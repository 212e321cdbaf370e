"""Ids of a tokenizer that works word by word, with a bounded memory of words.

The tokenizer file splits normalised text by a pattern and encodes each part by itself, so equal parts have equal
ids. For texts of plain Latin characters the parts are taken here and looked up; parts that are
new go to the tokenizer. Any other text goes to the tokenizer whole. Ids are the same either way."""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from tokenizers import Tokenizer

#: The split pattern of word_bpe_49k.json (a fixed value of that file).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that lower-casing, composition and white space treat alike in all libraries (up to U+024F, without
#: control characters, U+0130 and the tokenizer's own marks, which begin with "<|").
_OTHER = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\|")


def _latin(kind: str) -> str:
    """Characters of a Unicode class up to U+024F, as ranges of a pattern."""
    own = [c for c in range(0x250) if regex.match(kind, chr(c))]
    firsts = [c for c in own if c - 1 not in own]
    lasts = [c for c in own if c + 1 not in own]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts, strict=True))


def _latin_parts() -> re.Pattern:
    """PARTS for plain Latin text; explicit ranges are twice as fast as classes of all Unicode."""
    letters, numbers = _latin(r"\p{L}"), _latin(r"\p{N}")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, words: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            conf = json.load(f)
        split = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        ours = (split[0].get("pattern") or {}).get("Regex") == PARTS and conf["model"].get("end_of_word_suffix") == "</w>"
        self.parts = _latin_parts().findall if ours else None
        self.words, self.known = words, {}
        if ours:
            # the same vocabulary for parts that are split and normalised already
            space = {"type": "WhitespaceSplit"}
            level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            plain = conf | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [space, level]}}
            self.plain = Tokenizer.from_str(json.dumps(plain))
            #: whether an id ends a part
            self.last = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
            self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        if self.parts is None or _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts, known = self.parts(text.lower()), self.known
        new = set(parts).difference(known)
        if new:
            if len(known) > self.words:
                known.clear()
                new = set(parts)
            new = list(new)
            ids = np.array(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
            known.update(zip(new, (raw[a:b] for a, b in zip(at, at[1:])), strict=True))
        return b"".join(map(known.__getitem__, parts))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that later tasks find the words of earlier ones."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
