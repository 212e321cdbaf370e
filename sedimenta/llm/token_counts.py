"""Token counts of sections, from one encoding of each whole document.

A document is encoded once, so tokens are those that a model would see. The byte length of each token gives its
span, and an interval join (sorted ends against sorted starts) gives each token to a section. A token over a boundary
goes by an explicit rule: "start" to the section of its first byte, "end" to that of its last, "largest" to the one that
has most of it (the earlier of equals), "share" to each by its part of the bytes."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sedimenta.llm.common import mapped, table

RULES = ("start", "end", "largest", "share")
_made: dict[tuple[str, str], tuple[tiktoken.Encoding, np.ndarray]] = {}
#: Runs of white space from this length on are beyond what the encoder's own pattern matcher can take.
_LONG = re.compile(r"\s{10000}")


def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a .tiktoken file and the byte length of each of its tokens; one for each worker process."""
    if (path, pattern) not in _made:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            sizes[i] = len(t)
        _made[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _made[path, pattern]


def spans(enc: tiktoken.Encoding, sizes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each token of a text."""
    if _LONG.search(text):  # the same pattern, split here
        ids = [i for m in regex.finditer(enc._pat_str, text) for i in enc._encode_single_piece(m[0])]
    else:
        ids = enc.encode_ordinary(text)
    end = np.cumsum(sizes[np.asarray(ids, np.int64)])
    return np.append(0, end)[:-1], end


def allocate(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [bounds[i], bounds[i + 1]); sections follow each other without gaps."""
    n = len(bounds) - 1
    a = np.searchsorted(bounds, start, side="right") - 1
    b = np.searchsorted(bounds, end, side="left") - 1
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(b, minlength=n).astype(float)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    for t in np.flatnonzero(a != b):  # tokens over a boundary
        k = np.arange(a[t], b[t] + 1)
        part = np.minimum(bounds[k + 1], end[t]) - np.maximum(bounds[k], start[t])
        if rule == "share":
            out[k] += part / (end[t] - start[t])
        else:
            out[k[np.argmax(part)]] += 1
    return out


def _count(path: str, pattern: str, rule: str):
    def run(batches):
        enc, sizes = encoding(path, pattern)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                lines = (text or "").split("\n")
                chars = np.cumsum([len(x) + 1 for x in lines])
                chars[-1] -= 1
                raw = np.cumsum([len(x.encode()) + 1 for x in lines])
                raw[-1] -= 1
                if len(raw) > 1 and raw[-1] == raw[-2]:  # nothing after the last line end
                    chars, raw = chars[:-1], raw[:-1]
                start, end = spans(enc, sizes, text or "")
                got = allocate(start, end, np.append(0, raw), rule)
                out.append([{"start": int(s), "end": int(e), "n_tokens": float(t)} for s, e, t in zip(np.append(0, chars[:-1]), chars, got, strict=True)])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kinds)], ["id", "sections"])

    return run


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each section; sections are lines, each with its line end.

    Returns a row for each section: id_col, section (from 0), start and end (characters), n_tokens (whole but under "share"). The
    sections of a text add up to its tokens. A null or empty text has one section without tokens. Repeated rows and null
    ids are rows like others; other columns aren't read. An empty table gives an empty result."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    item = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("n_tokens", DoubleType())])
    out = mapped(src, _count(path, pattern, rule), StructType([src.schema["id"], StructField("sections", ArrayType(item))]))
    return out.select(F.col("id").alias(id_col), F.posexplode("sections").alias("section", "s")).select(id_col, "section", "s.*")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every line of all documents; a token over a line end counts for the line of its first byte."""
    import public_tokenizers as P

    out = section_tokens(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
