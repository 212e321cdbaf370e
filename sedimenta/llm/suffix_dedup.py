"""Exact removal of repeated byte passages by distributed prefix doubling over sampled suffixes.

Two passages of `length` bytes are compared by ranks of growing strings. A rank names an equality class; the rank of a
longer string follows from the pair (rank of the string so far, bytes that the offset adds), and Spark brings equal pairs
together. Ranks of every position at every level would cost some 30 bytes of shuffle for each byte of text, so
positions are sampled: of each passage the place whose GRAM bytes have the least fingerprint, its anchor. Equal
passages have their anchor at the same offset, so the sample loses no match.

A block is an anchor with a range of offsets, that is, the passages that begin there; its core is the string that all
passages of the range have in common. The first block of an anchor has all offsets, and GRAM bytes as its core. In each round

1. blocks whose core has a rank that no other block has leave: none of their passages repeats;
2. of blocks that are equal from the first byte of the first passage to the last of the last, all but the first
   are repeats as a whole, and the first goes on for all of them;
3. blocks that are left are split (SPLITS), which makes their cores longer: with 100 bytes cores grow from
   32 bytes to 66, 92, 98 and 100. The new rank is that of the pair (old rank, bytes added at both ends).

A block of one passage is its own core, so the rounds end by themselves. Passages inside a shared text go by step 2 and those
outside by step 1, so a round keeps about one block for each place where a shared text begins or ends, however often it is shared.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sedimenta.llm.bytetext import BASE, CHUNK, U, chunks, column, mix, rolling, span
from sedimenta.llm.common import Steps, hot_keys, keyed, mapped, spread_join, stored, table, text_of

LENGTH = 100
GRAM = 32
#: Parts into which the rounds split a block, the last for all that follow. Most blocks of the first round leave in it.
SPLITS = (2, 4)
#: Longest passages that the packed places hold (16 bits for an offset).
LONGEST = (1 << 16) - 1
#: Low bits of a fingerprint that hold a place while the least is found; the rest decides, then the place.
_POS = 31


def _anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Sampled positions of a chunk: (position, first and last passage start that it decides, gram
    fingerprints at all positions)."""
    w, n = length - gram + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U)
    h = rolling(data, BASE[0])
    k = n - gram + 1
    g = mix(span(h, BASE[0], np.arange(k), np.arange(gram, n + 1)))
    low = U((1 << _POS) - 1)
    m, s = (g & ~low) | np.arange(k, dtype=U), 1
    while s * 2 <= w:
        m, s = np.minimum(m[:-s], m[s:]), s * 2
    if s < w:
        m = np.minimum(m[: len(m) - (w - s)], m[w - s :])
    ends = np.repeat(offs[1:], np.diff(offs))[: len(m)]
    starts = np.flatnonzero(np.arange(len(m)) + length <= ends)
    if not len(starts):
        return none, none, none, g
    a = (m[starts] & low).astype(np.int64)
    runs = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return a[runs], starts[runs], starts[np.append(runs[1:], len(starts)) - 1], g


def _parts(data: np.ndarray, offs: np.ndarray, length: int):
    """Chunks as (row of each text, bytes, offsets, place of the first byte in its text). Texts beyond CHUNK bytes come in
    pieces that share length - 1 bytes, so that each passage is in one of them and memory is bounded."""
    for x, y, d, o in chunks(data, offs):
        if len(d) <= 2 * CHUNK or y - x > 1:
            yield np.arange(x, y), d, o, 0
        else:
            for at in range(0, len(d) - length + 1, CHUNK):
                piece = d[at : at + CHUNK + length - 1]
                yield np.array([x]), piece, np.array([0, len(piece)]), at


def _ranks(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for _, d, o, _ in _parts(*column(batch, "text"), length):
                a, _, _, g = _anchors(d, o, length, gram)
                u, c = np.unique(g[a], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["core", "c"])

    return run


def _blocks(length: int, gram: int):
    """First blocks: (core, whole, key, at). whole is a second fingerprint, of the bytes of all passages and the range of offsets;
    at is first passage start << 32 | anchor's offset in it << 16 | passages."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for rows, d, o, first in _parts(*column(batch, "text"), length):
                a, lo, hi, g = _anchors(d, o, length, gram)
                doc = np.searchsorted(o, a, side="right") - 1
                h = rolling(d, BASE[1])
                whole = mix(span(h, BASE[1], lo, hi + length) + (a - lo).astype(U) * U(0x9FB21C651E98DF25) + (hi - lo).astype(U))
                at = ((first + lo - o[doc]) << 32) | ((a - lo) << 16) | (hi - lo + 1)
                cols = [g[a].view(np.int64), whole.view(np.int64), keys[rows[doc]].astype(np.int64), at.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["core", "whole", "key", "at"])

    return run


def _bytes_of(length: int):
    """The bytes of blocks, from texts with their list of (core, at)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for text, key, items in zip(batch.column("text"), batch.column("key").to_pylist(), batch.column("items").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                for it in items:
                    lo, n = it["at"] >> 32, it["at"] & LONGEST
                    out.append((it["core"], key, it["at"], raw[lo : lo + n - 1 + length]))
                    size += n + length
                    if size > 16 * CHUNK:
                        yield _table(out, kinds)
                        out, size = [], 0
            yield _table(out, kinds)

    return run


def _table(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["core", "key", "at", "bytes"])


def _covered(n: int, spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the passages that start in [lo, lo + n) of each span."""
    out: list[list[int]] = []
    for lo, k in sorted((s["lo"], s["n"]) for s in spans or ()):
        a, b = lo, min(n, lo + k - 1 + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _next_blocks(live: DataFrame, length: int, split: int) -> DataFrame:
    """The parts of blocks (r1, r2, s, w, key, a, x, y, bytes) with their new ranks; (s, w) is the range of offsets of which a block
    is a part, (x, y) those offsets of it that the block has, a the anchor's place, bytes what lies under its passages."""
    size = F.ceil(F.col("w") / split).cast("int")
    last = F.least(F.lit(split), F.ceil(F.col("w") / size)).cast("int") - 1
    d = live.select("*", size.alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("j"))
    d = d.withColumns({"s2": F.col("s") + F.col("j") * F.col("size")})
    d = d.withColumns({"w2": F.least("size", F.col("s") + F.col("w") - F.col("s2"))})
    d = d.withColumns({"x2": F.greatest("x", "s2"), "y2": F.least("y", F.col("s2") + F.col("w2") - 1)}).filter("x2 <= y2")
    # places in bytes, which begins y before the anchor; substring counts from 1
    more = [("y - s2 + 1", "s2 - s"), (f"y - s + {length + 1} - w + 1", "s + w - s2 - w2")]
    add = [F.expr(f"substring(bytes, {a}, {n})") for a, n in more]
    own = F.expr(f"substring(bytes, y - y2 + 1, {length} + y2 - x2)")
    return d.select(F.xxhash64("r1", "j", *add).alias("r1"), F.xxhash64(F.lit("second"), "r2", "j", *add).alias("r2"), F.col("s2").alias("s"), F.col("w2").alias("w"), "key", "a", F.col("x2").alias("x"), F.col("y2").alias("y"), own.alias("bytes"))


def repeated_passages(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, lo, n): passages of `length` bytes starting at lo .. lo + n - 1 that have an earlier equal,
    over rows (key long, text string) with keys that are all different."""
    if not 0 < length <= LONGEST:
        raise ValueError(f"length must be 1 to {LONGEST}")
    steps, width = Steps(rows.sparkSession, "passages"), length - gram + 1
    # ranks of the first cores; unique ones leave before anything else is known of them
    ranks = mapped(rows.select("text"), _ranks(length, gram), "core long, c long")
    again = steps.keep(ranks.groupBy("core").agg(F.sum("c").alias("c")).filter("c > 1"), "ranks")
    blocks = mapped(rows.select("key", "text"), _blocks(length, gram), "core long, whole long, key long, at long")
    shared = steps.keep(spread_join(blocks, again.select("core"), ["core"], "core", hot_keys(again, "core", "c"), ["key", "at"], "left_semi"), "shared")
    steps.drop("ranks")
    first = shared.groupBy("core", "whole").agg(F.min(F.struct("key", "at")).alias("f"), F.count("*").alias("c"))
    first = steps.keep(first.select("core", "whole", F.col("f.key").alias("fkey"), F.col("f.at").alias("fat"), "c"), "first")
    late = spread_join(shared, first.filter("c > 1").drop("c"), ["core", "whole"], "whole", hot_keys(first, "whole", "c"), ["key", "at"]).filter("key <> fkey or at <> fat")
    found = [steps.keep(late.select("key", F.shiftright("at", 32).alias("lo"), F.col("at").bitwiseAND(F.lit(LONGEST)).alias("n")), "late")]
    several = steps.keep(first.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1"), "several")
    mine = spread_join(first, several.select("core"), ["core"], "core", hot_keys(several, "core", "c"), ["fkey", "fat"], "left_semi")
    lists = mine.groupBy(F.col("fkey").alias("key")).agg(F.collect_list(F.struct("core", F.col("fat").alias("at"))).alias("items"))
    parts = mapped(rows.join(lists, "key").select("text", "key", "items"), _bytes_of(length), "core long, key long, at long, bytes binary")
    d, n = F.shiftright("at", 16).bitwiseAND(F.lit(LONGEST)).cast("int"), F.col("at").bitwiseAND(F.lit(LONGEST)).cast("int")
    live = parts.select(F.col("core").alias("r1"), F.col("core").alias("r2"), F.lit(0).alias("s"), F.lit(width).alias("w"), "key", (F.shiftright("at", 32) + d).alias("a"), (d - n + 1).alias("x"), d.alias("y"), "bytes")
    live = steps.keep(live, "live")
    steps.drop("shared", "first", "several")
    names, k = ("key", "a", "r1", "r2", "s", "w", "x", "y", "bytes"), 0
    while live.limit(1).count():
        blocks = _next_blocks(live, length, SPLITS[min(k, len(SPLITS) - 1)])
        again = steps.keep(blocks.groupBy("r1", "r2").agg(F.count("*").alias("c")).filter("c > 1"), "ranks")
        shared = spread_join(blocks, again.select("r1", "r2"), ["r1", "r2"], "r1", hot_keys(again, "r1", "c"), ["key", "a"], "left_semi")
        shared = steps.keep(shared.withColumns({"o1": F.xxhash64("r1", "x", "y", "bytes"), "o2": F.xxhash64(F.lit("second"), "r2", "x", "y", "bytes")}), "shared")
        steps.drop("ranks", f"live{k or ''}")
        first = shared.groupBy("o1", "o2").agg(F.min(F.struct(*names)).alias("f"), F.count("*").alias("c"))
        first = steps.keep(first.select("o1", "o2", "c", *[f"f.{c}" for c in names]), "first")
        equal = first.filter("c > 1").select("o1", "o2", F.col("key").alias("fkey"), F.col("a").alias("fa"), "c")
        late = spread_join(shared.select("o1", "o2", "key", "a", "x", "y"), equal.drop("c"), ["o1", "o2"], "o1", hot_keys(equal, "o1", "c"), ["key", "a"]).filter("key <> fkey or a <> fa")
        found.append(steps.keep(late.select("key", (F.col("a") - F.col("y")).alias("lo"), (F.col("y") - F.col("x") + 1).cast("long").alias("n")), "late"))
        again = steps.keep(first.groupBy("r1", "r2").agg(F.count("*").alias("c")).filter("c > 1"), "ranks")
        live = spread_join(first, again.select("r1", "r2"), ["r1", "r2"], "r1", hot_keys(again, "r1", "c"), ["key", "a"], "left_semi")
        k += 1
        live = steps.keep(live.select(*names), f"live{k}")
        steps.drop("shared", "first", "ranks")
    out = stored(reduce(DataFrame.unionByName, found), "spans")
    steps.drop()
    return out


def _digest(length: int):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                text = text.as_py()
                raw = (text or "").encode()
                cut = _covered(len(raw), spans, length)
                kept, a = [], 0
                for lo, hi in cut:
                    kept.append(raw[a:lo])
                    a = hi
                left = b"".join([*kept, raw[a:]])
                out.append((left.decode("utf-8", "ignore") if cut else text, len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in cut]))
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            made = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rest"), *made], ["id", "rest", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def _cleaned(docs: DataFrame, id_col: str, text_col: str, length: int, carry: bool) -> DataFrame:
    rows = keyed(docs, id_col, text_col, carry)
    spans = repeated_passages(rows.select("key", text_of("text").alias("text")), length, max(1, min(GRAM, length // 2)))
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    kinds = [*(rows.schema[c] for c in ("id", "rest")), StructField("kept_text", StringType()), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType()), StructField("removed", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))]
    return mapped(rows.join(lists, "key", "left").select("id", "rest", "text", "spans"), _digest(length), StructType(kinds))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Removes each byte under a `length`-byte string that also starts earlier in the collection
    (smaller id, or same document and earlier start; judged on the input, matches within one document's bytes).

    Returns a row for each row: id_col, kept_text (remaining bytes as UTF-8; halves of characters at a cut go),
    n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and removed (spans of bytes). Other columns aren't
    read, so their names can't clash. A null text is empty (kept_text stays null). Rows whose id repeats are documents
    of their own, in order of text; null ids come first. Texts under `length` bytes never change. An empty table gives
    an empty result. A length of more than LONGEST (65,535) is refused.
    """
    return _cleaned(docs, id_col, text_col, length, False).drop("rest").withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole texts of documents, 100-byte strings; digest columns only."""
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stays, with the text that isn't a repeat; n_chars follows where text went."""
    made = _cleaned(docs, "doc_id", "text", LENGTH, True)
    own = {"doc_id": F.col("id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return made.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


_WINDOWS = LENGTH - 1
#: Every 100-byte string by its bytes as hex digits, and its first start in order of (doc_id, start).
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) AS g FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {_WINDOWS})) AS s FROM d)),
f AS (SELECT r, s, row_number() OVER (PARTITION BY g ORDER BY r, s) > 1 AS late FROM w),
e AS (SELECT r, s, max(s) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM f WHERE late),
g AS (SELECT r, s, sum(CASE WHEN p IS NULL OR s > p + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM e),
c AS (SELECT r, k, min(s) AS a, max(s) + {LENGTH} AS b FROM g GROUP BY r, k),
x AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS z FROM c),
t AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS b, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY k) AS h
      FROM x JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(t.h, '') || substr(d.h, 2 * coalesce(t.b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
