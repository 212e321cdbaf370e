"""Importance resampling towards a target distribution, with word tries.

A task puts the features of its texts, runs of 1 to `longest` words, into a trie of its own: a node is a path of words and
holds how often it was walked and the CRC of the path's bytes, continued from its parent's. The totals of the CRC's buckets are
merged by Spark, for the corpus and for the target; each bucket's gain is the smoothed log ratio of both. A second walk adds the
gains, which the nodes then carry, over each document. Documents are drawn without replacement by weight plus Gumbel noise.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bytetext import NOT_ALNUM, U, Words, chunks, column, mix
from sedimenta.llm.common import mapped, stored, table, text_of

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
#: A document needs that many words to be drawn; hundredths of such documents that are drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Nodes of a task's trie; beyond it, totals are handed out and the trie starts anew.
NODES = 1 << 20


class WordTrie:
    """Nodes by level, in order of a 64-bit hash of the path from the root."""

    def __init__(self, longest: int, gains: np.ndarray | None = None):
        self.longest, self.gains = longest, gains
        self.clear()

    def clear(self) -> None:
        self.path = [np.zeros(0, U) for _ in range(self.longest)]
        self.crc = [np.zeros(0, np.uint32) for _ in range(self.longest)]
        self.count = [np.zeros(0, np.int64) for _ in range(self.longest)]

    def size(self) -> int:
        return sum(map(len, self.path))

    def walk(self, w: Words):
        """For each level the places of a chunk where a path of that length starts, and the nodes they end in. New paths get
        nodes; a node's CRC continues its parent's by one word."""
        low, h, doc, n = w.low.tobytes(), w.hash, w.doc, len(w.doc)
        at, key = np.arange(n), h
        states = np.zeros(n, np.uint32)  # of the parents, by place
        for k in range(self.longest):
            if k:
                inside = at[at + k < n]
                inside = inside[doc[inside] == doc[inside + k]]
                key = mix(key[np.searchsorted(at, inside)] * U(0x9E3779B97F4A7C15) + h[inside + k])
                at = inside
            paths, first, of = np.unique(key, return_index=True, return_inverse=True)
            new = np.flatnonzero(~np.isin(paths, self.path[k], assume_unique=True))
            if len(new):
                crcs = np.fromiter((zlib.crc32((b" " if k else b"") + low[w.start[p + k] : w.end[p + k]], int(states[p])) for p in at[first[new]]), np.uint32, len(new))
                path = np.concatenate([self.path[k], paths[new]])
                order = np.argsort(path, kind="stable")
                self.path[k], self.crc[k] = path[order], np.concatenate([self.crc[k], crcs])[order]
                self.count[k] = np.concatenate([self.count[k], np.zeros(len(new), np.int64)])[order]
            node = np.searchsorted(self.path[k], paths)[of]
            states[at] = self.crc[k][node]
            yield k, at, node

    def count_in(self, w: Words) -> None:
        for k, _, node in self.walk(w):
            self.count[k] += np.bincount(node, minlength=len(self.path[k]))

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for crc, count in zip(self.crc, self.count, strict=True):
            np.add.at(out, crc % buckets, count)
        return out

    def gain(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(features, sum of gains) of each text of a chunk."""
        n, total = np.zeros(len(w.of) - 1, np.int64), np.zeros(len(w.of) - 1, np.int64)
        for k, at, node in self.walk(w):
            value = self.gains[self.crc[k] % len(self.gains)][node]
            np.add.at(total, w.doc[at], value)
            n += np.bincount(w.doc[at], minlength=len(n))
        return n, total


def _totals(longest: int, buckets: int, nodes: int):
    def run(batches):
        trie = WordTrie(longest)

        def out():
            t = trie.totals(buckets)
            b = np.flatnonzero(t)
            trie.clear()
            return pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(t[b])], ["bucket", "n"])

        for batch in batches:
            for _, _, d, o in chunks(*column(batch, "text")):
                trie.count_in(Words(d, o, NOT_ALNUM))
                if trie.size() > nodes:
                    yield out()
        yield out()

    return run


def _scores(longest: int, nodes: int, gains):
    def run(batches):
        trie = WordTrie(longest, gains.value)
        for batch in batches:
            for x, y, d, o in chunks(*column(batch, "text")):
                w = Words(d, o, NOT_ALNUM)
                n, weight = trie.gain(w)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(x, y - x), pa.array(np.diff(w.of).astype(np.int64)), pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"])
                if trie.size() > nodes:
                    trie.clear()

    return run


def bucket_totals(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, nodes: int = NODES) -> dict[int, int]:
    """Features of all texts by bucket; a row for each bucket at most comes to the driver."""
    parts = mapped(docs.select(text_of(text_col).alias("text")), _totals(longest, buckets, nodes), "bucket int, n long")
    return {r.bucket: r.n for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of both shares, by bucket."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def ranked(rows: DataFrame, order: list, rank: str) -> DataFrame:
    """Adds 1, 2, 3 ... in the given order, from one range-partitioned sort: a row's rank is its place in its partition after the
    sizes of those before. The sorted rows are written first, so that places stay as they are."""
    last = (1 << 33) - 1
    at = F.monotonically_increasing_id()
    rows = stored(rows.orderBy(*order).select("*", F.shiftright(at, 33).alias("_part"), (at.bitwiseAND(F.lit(last)) + 1).alias("_at")), "ranked")
    before, base = 0, {}
    for part, n in sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.max("_at")).collect()):  # a row for each partition
        base[part], before = before, before + n
    bases = rows.sparkSession.createDataFrame(list(base.items()), "_part long, _base long")
    return rows.join(F.broadcast(bases), "_part").withColumn(rank, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT, nodes: int = NODES) -> DataFrame:
    """Scores every document by how much likelier its features are in the target than in the corpus, and draws.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a feature is a run of 1 to `longest` words
    joined by one space, its bucket the CRC-32 of its bytes modulo `buckets`. Returns a row for each row: id_col, n_words,
    n_features, weight (sum of gains), score (weight plus noise from sha256 of `seed:id`), rank (1, 2, 3 ... of the `percent`
    hundredths of documents with at least `least` words that score highest; null for the rest). Null and empty texts have no
    features, weight 0 and no rank. Repeated rows are rows like others, in any order among themselves; a null id's noise is that of
    the empty id, and it comes first among equal scores. Other columns aren't read. Empty tables: no rows, or gains of 0 features.
    """
    spark = docs.sparkSession
    gains = spark.sparkContext.broadcast(gains_of(bucket_totals(docs, text_col, longest, buckets, nodes), bucket_totals(target, target_text, longest, buckets, nodes), buckets))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    rows = mapped(src, _scores(longest, nodes, gains), f"id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = stored(rows.withColumn("score", F.col("weight") + noise.cast("long")), "scores")
    enough = F.col("n_words") >= least
    drawn = rows.filter(enough).count() * percent // 100
    inside = ranked(rows.filter(enough).withColumn("_salt", F.rand(0)), [F.col("score").desc(), F.col("id").asc_nulls_first(), "_salt"], "rank").drop("_salt")
    inside = inside.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return inside.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long"))).withColumnRenamed("id", id_col)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents towards the benchmark, single words in 10,000 buckets, a tenth drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 written out over the bytes of each distinct word.
OP12_SQL = r"""
WITH RECURSIVE step(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS f FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
bytes AS (SELECT f, list_transform(range(1, 2 * strlen(f), 2), lambda p: CAST('0x' || substr(hex(f), p, 2) AS BIGINT)) AS b FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
bucket AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS k FROM bytes, tab),
s AS (SELECT k, count(*) AS s FROM dw JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bw JOIN bucket USING (f) GROUP BY k),
sums AS (SELECT (SELECT count(*) FROM dw) AS sa, (SELECT count(*) FROM bw) AS ta),
gain AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (sa + 10000) / ((s.s + 1.0::DOUBLE) * (ta + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), sums),
weight AS (SELECT r, sum(g) AS g FROM dw JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n, CAST(coalesce(g, 0) AS BIGINT) AS weight, CAST(coalesce(g, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (r)),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER () AS n FROM scored WHERE n >= 20)
SELECT doc_id, CAST(scored.n AS BIGINT) AS n_features, weight, score, CASE WHEN k <= 10 * ranks.n // 100 THEN CAST(k AS BIGINT) END AS rank FROM scored LEFT JOIN ranks USING (r)
"""
