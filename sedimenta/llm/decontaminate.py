"""Benchmark decontamination with suffix arrays over the training documents.

Documents are dealt in shards (the bounded chunks that a task reads). Each shard gets a word suffix array: all
suffixes sorted by their first MAX_SORT words, a word being known by its 64-bit hash. Every suffix of every test item is
looked up in it by binary search, which gives all places in the shard where the item's next words occur verbatim, and from
there the longest match. Nothing is shuffled: a shard's matches lie in its own documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sedimenta.llm.bytetext import NOT_ALNUM, U, Words, chunks, column
from sedimenta.llm.common import ARROW_ROWS, fresh, mapped, table, text_of

WINDOW = 10
#: Bytes of test texts that a worker holds at a time; more are taken in blocks of this size, one after the other.
BLOCK = 16 << 20
_PACK = 4


def suffix_array(w: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, keys): suffixes sorted by their first `depth` words. keys[k] holds, in that order, words 4k .. 4k + 3 as 16
    bits each (0 beyond the text's end); ties of one key are sorted by the next."""
    n = len(w)
    small = (w >> U(48)) | U(1)
    keys = []
    for k in range(-(-depth // _PACK)):
        key = np.zeros(n, U)
        for j in range(_PACK):
            at = k * _PACK + j
            if at < min(depth, n):
                key[: n - at] |= np.where(doc[: n - at] == doc[at:], small[at:], U(0)) << U(16 * (_PACK - 1 - j))
        keys.append(key)
    order = np.argsort(keys[0], kind="stable")
    for k in range(1, len(keys)):
        head = np.stack([x[order] for x in keys[:k]])
        same = (head[:, 1:] == head[:, :-1]).all(axis=0) if n > 1 else np.zeros(0, bool)
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if n else np.zeros(0, np.int64)
        if not len(tied):
            continue
        group = np.cumsum(np.append(True, ~same))[tied]
        sub = order[tied]
        order[tied] = sub[np.lexsort((keys[k][sub], group))]
    return order, [x[order] for x in keys]


def find(keys: list[np.ndarray], query: np.ndarray) -> tuple[int, int]:
    """Range of the suffix array whose suffixes begin with the query's words (as far as 16 bits tell)."""
    lo, hi = 0, len(keys[0])
    for k in range(0, len(query), _PACK):
        part = [int(x >> U(48)) | 1 for x in query[k : k + _PACK]]
        a = 0
        for x in part + [0] * (_PACK - len(part)):
            a = a << 16 | x
        b = a | ((1 << 16 * (_PACK - len(part))) - 1)
        key = keys[k // _PACK][lo:hi]
        lo, hi = lo + int(np.searchsorted(key, U(a), "left")), lo + int(np.searchsorted(key, U(b), "right"))
        if lo >= hi:
            return lo, lo
    return lo, hi


class Tests:
    """Test items: their words, and the start of each suffix that holds a whole window."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        arr = pa.record_batch([pa.array(texts, pa.string())], ["text"])
        data, offs = column(arr, "text")
        w = Words(data, offs, NOT_ALNUM)
        self.ids, self.hash, self.of = ids, w.hash, w.of
        n = np.diff(w.of)
        self.size = np.minimum(n, window)
        self.item = np.repeat(np.arange(len(ids)), np.where(n > 0, n - self.size + 1, 0))
        first = np.cumsum(np.where(n > 0, n - self.size + 1, 0)) - np.where(n > 0, n - self.size + 1, 0)
        self.start = w.of[:-1][self.item] + np.arange(len(self.item)) - first[self.item]
        self.head = np.array([self._head(i) for i in range(len(self.item))], U).reshape(-1, 2)
        self.window = window

    def _head(self, i: int) -> tuple[int, int]:
        """Least and greatest first key of suffixes that begin with this window."""
        k = min(_PACK, int(self.size[self.item[i]]))
        a = 0
        for x in self.hash[self.start[i] : self.start[i] + k]:
            a = a << 16 | int(x >> U(48)) | 1
        a <<= 16 * (_PACK - k)
        return a, a | ((1 << 16 * (_PACK - k)) - 1)


class Shard:
    """Words of a chunk of documents and their suffix array."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int):
        w = Words(data, offs, NOT_ALNUM)
        self.hash, self.doc, self.of = w.hash, w.doc, w.of
        self.order, self.keys = suffix_array(w.hash, w.doc, window)


def _matches(tests: Tests, w: Shard) -> tuple[np.ndarray, ...]:
    """(word place, item, words matched from there on) for each occurrence of a test window in a shard."""
    order, keys = w.order, w.keys
    lo, hi = np.searchsorted(keys[0], tests.head[:, 0], "left"), np.searchsorted(keys[0], tests.head[:, 1], "right")
    out = []
    for q in np.flatnonzero(hi > lo):
        item, s = tests.item[q], tests.start[q]
        k = int(tests.size[item])
        words = tests.hash[s : s + k]
        a, b = find([x[lo[q] : hi[q]] for x in keys], words) if k > _PACK else (0, hi[q] - lo[q])
        at = order[lo[q] + a : lo[q] + b]
        at = at[at + k <= len(w.doc)]
        at = at[w.doc[at] == w.doc[at + k - 1]]
        for j in range(k):  # whole hashes, not their first 16 bits
            at = at[w.hash[at + j] == words[j]]
        if len(at):
            long, live, end = np.full(len(at), k), np.arange(len(at)), tests.of[item + 1]
            while len(live) and s + long[live[0]] < end:
                nxt = at[live] + long[live]
                ok = nxt < len(w.doc)
                live, nxt = live[ok], nxt[ok]
                ok = (w.doc[nxt] == w.doc[at[live]]) & (w.hash[nxt] == tests.hash[s + long[live[:1]][0]] if len(live) else True)
                live = live[ok]
                long[live] += 1
            out.append((at, np.full(len(at), item), np.full(len(at), k), long))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _merged(pairs) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def _scan(tests: list, window: int, kind: pa.DataType):
    """Adds n_words, spans, items and longest to rows (id, rest, text). The suffix arrays of a batch's shards are made once and
    searched for one block of test items after the other; a worker holds one block at a time."""
    match = pa.struct([("item_id", kind), ("start", pa.int64()), ("words", pa.int64())])

    def run(batches):
        for batch in batches:
            shards = [(x, y, Shard(d, o, window)) for x, y, d, o in chunks(*column(batch, "text"))]
            n = batch.num_rows
            pairs, items, best = [set() for _ in range(n)], [set() for _ in range(n)], [None] * n
            for block in tests:
                t = block.value if len(tests) == 1 else block.load_from_path(block._path)
                for x, y, w in shards:
                    at, item, k, long = _matches(t, w)
                    if not len(at):
                        continue
                    doc = w.doc[at]
                    by = np.argsort(doc, kind="stable")
                    cut = np.searchsorted(doc[by], np.arange(y - x + 1))
                    for i in np.unique(doc):
                        rows = by[cut[i] : cut[i + 1]]
                        a = at[rows] - w.of[i]
                        pairs[x + i].update(zip(a.tolist(), (a + k[rows]).tolist(), strict=True))
                        items[x + i] |= {t.ids[j] for j in set(item[rows].tolist())}
                        top = rows[np.lexsort((item[rows], a, -long[rows]))[0]]
                        if best[x + i] is None or long[top] > best[x + i]["words"]:
                            best[x + i] = {"item_id": t.ids[item[top]], "start": int(at[top] - w.of[i]), "words": int(long[top])}
            n_words = [k for _, _, w in shards for k in np.diff(w.of).tolist()]
            cols = [pa.array(n_words, pa.int64()), pa.array(list(map(_merged, pairs)), pa.list_(_SPAN)), pa.array([sorted(v, key=str) for v in items], pa.list_(kind)), pa.array(best, match)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "rest", "text")), *cols], ["id", "rest", "text", "n_words", "spans", "items", "longest"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Test items in blocks of at most `limit` bytes (a longer item is a block of its own), one at a time."""
    b = benchmark.select(F.col(f"`{item_col}`").alias("i"), text_of(text_col).alias("t")).filter("i is not null")
    ids, texts, size = [], [], 0
    for r in b.orderBy("i", "t").toLocalIterator():
        n = len(r.t.encode())
        if ids and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i), texts.append(r.t)
        size += n
    yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, carry: bool = False) -> DataFrame:
    """Verbatim matches of test items in documents, in one scan of the documents.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A test window is `window` consecutive
    words of an item; an item of fewer, but not none, is one window. Returns a row for each row: id_col, n_words, n_hit
    (words inside any occurrence of a window), n_items, items_sha256 (of the items' ids, sorted as strings, comma-joined),
    contaminated, spans (word places), items, longest (item_id, start, words of the longest match); with carry also rest, a struct
    of the documents' other columns. Item ids keep their type, whatever it is. Null or empty texts have no words. Repeated rows and
    null ids are rows like others; items with a null id are left out, and items that share an id count once. Empty tables: no
    rows, or no hits. Test items go to the workers in blocks of at most `block` bytes of text.
    """
    spark = docs.sparkSession
    rest, (pad,) = [F.col(f"`{c}`") for c in docs.columns if carry and c not in (id_col, text_col)], fresh(docs, "pad")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*rest, F.lit(0).alias(pad)).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    item = benchmark.select(F.col(f"`{item_col}`").alias("i")).schema["i"].dataType
    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    longest = StructType([StructField("item_id", item), StructField("start", LongType()), StructField("words", LongType())])
    schema = StructType([*rows.schema.fields, StructField("n_words", LongType()), StructField("spans", span), StructField("items", ArrayType(item)), StructField("longest", longest)])
    tests = [spark.sparkContext.broadcast(Tests(ids, texts, window)) for ids, texts in _blocks(benchmark, item_col, item_text, block)]
    rows = mapped(rows, _scan(tests, window, to_arrow_type(item)), schema, 4 * ARROW_ROWS if len(tests) > 1 else ARROW_ROWS)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>"))), 256)
    out = rows.select("id", *(["rest", "text"] if carry else []), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "items", "longest")
    return out.withColumnRenamed("id", id_col)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Whole documents against the whole benchmark, windows of 10 words."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a verbatim window of the benchmark go."""
    out = contamination(docs, table(spark, sf_dir, "benchmark"), carry=True).filter("not contaminated")
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


#: Windows of words as strings: DuckDB compares them directly.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT r, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
