"""Ranked lexical search by sort-based accumulation.

One scan turns documents into postings of the questions' terms: a document's length, and its matched terms with their counts.
With the terms' document frequencies, a task then takes the postings of its range of documents, looks up each posting's questions,
concatenates (question, document, impact) for all of them, radix-sorts the packed question-document keys and sums each run of equal
keys. A heap keeps the best documents of each question; what the ranges kept is ranked by Spark. Questions go to the workers in blocks of bounded
size, a scan for each block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sedimenta.llm.bytetext import NOT_ALNUM, Words, chunks, column
from sedimenta.llm.common import Steps, mapped, stored, table, text_of

TOP = 10
#: Bytes of question texts that a worker holds at a time, and (question, document, impact) entries that it sorts at once.
BLOCK, ENTRIES = 8 << 20, 1 << 21
#: Rows of postings in a batch.
ROWS = 4096


class Questions:
    """A block of questions as postings by term: for term k, questions item[of[k]:of[k + 1]] hold it times[...] times."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [t.encode() for t in texts]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), NOT_ALNUM)
        self.ids = ids
        self.terms, term = np.unique(w.hash, return_inverse=True)
        pair, self.times = np.unique(term.astype(np.int64) * max(1, len(ids)) + w.doc, return_counts=True)
        self.item = pair % max(1, len(ids))
        self.of = np.searchsorted(pair // max(1, len(ids)), np.arange(len(self.terms) + 1))


def blocks(questions: DataFrame, item_col: str, text_col: str, limit: int):
    """Questions in blocks of at most `limit` bytes (a longer one is a block of its own), one block at a time."""
    ids, texts, size = [], [], 0
    for r in questions.select(F.col(f"`{item_col}`").alias("i"), text_of(text_col).alias("t")).toLocalIterator():
        n = len(r.t.encode())
        if ids and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i), texts.append(r.t)
        size += n
    if ids:
        yield ids, texts


def _postings(terms):
    """(id, n, terms, tf) of each row: its number of terms, and the places in the question terms of those it holds."""

    def run(batches):
        known = terms.value
        for batch in batches:
            for x, y, d, o in chunks(*column(batch, "text")):
                w = Words(d, o, NOT_ALNUM)
                at = np.searchsorted(known, w.hash)
                hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == w.hash) if len(known) else np.zeros(0, int)
                pair, tf = np.unique(w.doc[hit].astype(np.int64) * max(1, len(known)) + at[hit], return_counts=True)
                of = np.searchsorted(pair // max(1, len(known)), np.arange(y - x + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(of), pa.array(v)) for v in ((pair % max(1, len(known))).astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(x, y - x), pa.array(np.diff(w.of).astype(np.int64)), *lists], ["id", "n", "terms", "tf"])

    return run


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """Order of whole numbers from 0 to `most`, by stable passes over 16 bits each, low bits first (numpy sorts 16-bit numbers by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(1, int(most).bit_length()), 16):
        order = order[np.argsort(((keys >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
    return order


def accumulate(row: np.ndarray, term: np.ndarray, impact: np.ndarray, q: Questions, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of all pairs that share a term, in that order, from postings (row, term, impact)."""
    each = q.of[term + 1] - q.of[term]
    ends = np.cumsum(each)
    src = np.repeat(np.arange(len(term)), each)
    entry = np.arange(len(src)) - np.repeat(ends - each, each) + q.of[term][src]
    key = q.item[entry] * rows + row[src]
    order = radix_order(key, len(q.ids) * rows)
    key, value = key[order], (impact[src] * q.times[entry])[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    score = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.int64)
    return key[first] // rows, key[first] % rows, score


def _better(entry):
    return -entry[0], entry[1] is None, entry[1]


def _best(block, weights, n_docs: int, n_terms: int, top: int, entries: int, kind):
    """The `top` best documents of a task's rows for each question, as (place of the question, id, score)."""

    def run(batches):
        q, w = block.value, weights.value
        best: dict[int, list] = {}
        least = np.ones(len(q.ids), np.int64)
        fans = q.of[1:] - q.of[:-1]
        for batch in batches:
            lists = batch.column("terms")
            of = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
            n = batch.column("n").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(of))
            m = 25 + (75 * n * n_docs) // n_terms
            impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            use = np.flatnonzero(impact > 0)
            row, term, impact = row[use], term[use], impact[use]
            sizes = np.cumsum(np.bincount(row, fans[term], minlength=batch.num_rows))
            a = 0
            while a < batch.num_rows:  # whole rows, of about `entries` entries
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + entries, side="right")))
                x, y = np.searchsorted(row, (a, b))
                item, at, score = accumulate(row[x:y] - a, term[x:y], impact[x:y], q, b - a)
                keep = np.flatnonzero(score >= least[item])
                item, at, score = item[keep], at[keep] + a, score[keep]
                ids = batch.column("id")
                place = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
                order = np.lexsort((place[at], -score, item))
                item, at, score = item[order], at[order], score[order]
                k = np.arange(len(item)) - np.searchsorted(item, item)
                keep = np.flatnonzero(k < top)
                new: dict[int, list] = {}
                for i, v, s in zip(item[keep].tolist(), ids.take(pa.array(at[keep])).to_pylist(), score[keep].tolist(), strict=True):
                    new.setdefault(i, []).append((s, v))
                for i, found in new.items():
                    best[i] = heapq.nsmallest(top, best.get(i, []) + found, key=_better)
                    if len(best[i]) == top:
                        least[i] = best[i][-1][0]
                a = b
        out = [(i, v, s) for i, found in best.items() for s, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.int64())], ["at", "id", "score"])

    return run


def ranked_search(docs: DataFrame, questions: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """The `top` best documents of every question.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A term's weight and a document's
    length m are those of the contract, in 64-bit whole numbers; a score sums weight * ((1e9 * tf) div (1000 * tf + 8 * m)) over a
    question's terms, repeats included. Returns item_col, rank (from 1), id_col, score, for scores above 0; equal scores by ascending
    id, null ids last, repeated ids in any order. Each row of either table is a document or question of its own, also where ids are null or
    repeat; null and empty texts have no terms, and find or are found by nothing. Other columns aren't read. Empty tables give an empty result.
    Questions are held by a worker, and pass through the driver, `block` bytes of text at a time; each block costs a scan.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = src.schema["id"].dataType
    item = questions.select(F.col(f"`{item_col}`").alias("i")).schema["i"].dataType
    schema = StructType([StructField("item", item), StructField("rank", IntegerType()), StructField("id", kind), StructField("score", LongType())])
    out, stats = spark.createDataFrame([], schema), None
    steps = Steps(spark, "search")
    for k, (ids, texts) in enumerate(blocks(questions, item_col, item_text, block)):
        q = Questions(ids, texts)
        rows = mapped(src, _postings(sc.broadcast(q.terms)), f"id {kind.simpleString()}, n long, terms array<int>, tf array<long>")
        rows = steps.keep(rows.filter("n > 0"), f"postings{k}")
        stats = stats or rows.agg(F.count("*"), F.sum("n")).first()
        if not stats[0]:
            break
        df = np.zeros(len(q.terms), np.int64)
        for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * stats[0] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = mapped(rows, _best(sc.broadcast(q), sc.broadcast(weights), stats[0], stats[1], top, entries, to_arrow_type(kind)), f"at int, id {kind.simpleString()}, score long", ROWS)
        place = F.row_number().over(Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
        found = found.withColumn("rank", place).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("at", IntegerType()), StructField("item", item)]))
        found = stored(found.join(F.broadcast(names), "at").select("item", "rank", "id", "score"), "found")
        steps.drop(f"postings{k}")
        out = found if not k else out.unionByName(found)
    steps.drop()
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """All documents for every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT i, item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
           FROM (SELECT i, item_id, unnest(w) AS t FROM q) x JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
