"""Best-fit packing of token sequences under several capacities at once.

Pieces of equal length are alike, so the packing is decided on the histogram of lengths (at most `capacity`
counts, whatever the input), not on the pieces: lengths go from long to short, and each takes, among the open
bins that are alike, those with the best vector fit. Bins in one state (residual tokens, documents, attention cost)
move as a block. The plan is a list of runs: `count` pieces of a length from rank `first` on go to that many
sequences from `sequence` on, at one offset. Pieces then find their run by their rank within their length; ranks are
counted in many salted groups, so a length that a third of the pieces share is no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import mapped, release, stored, table, text_of
from sedimenta.llm.wordtokens import encoder

CAPACITY = 4096
END = 1


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "dot", weights=(1.0, 1.0, 1.0)) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, count, sequence, offset) that place counts[length] pieces of each length.

    A piece needs (length, 1, length**2) of (tokens, documents, attention cost). Of the bins with room for all three,
    rule "dot" takes the greatest weighted dot product of need and residual, "norm" the least weighted
    norm of what is left; both in shares of the capacities. Ties go to the fuller bin. Among bins of one
    residual token count both rules agree with plain best fit.
    """
    docs = max_docs or capacity + 1
    cost = max_cost or capacity * capacity + 1
    cap = np.array([capacity, docs, cost], float)
    scale = np.array(weights) / cap
    open_: dict[tuple[int, int, int], list[list[int]]] = {}
    order: list[tuple[int, int, int]] = []
    runs, next_seq = [], 0

    def add(state, block):
        if state not in open_:
            insort(order, state)
        open_.setdefault(state, []).append(block)

    def choose(n):
        """The best of all open states with room, in order of residual tokens; the scan stops where no later state can win."""
        need = np.array([n, 1.0, n * n])
        best, found = -np.inf, None
        for at in range(bisect_left(order, (n, 1, n * n)), len(order), STEP):
            r = np.array(order[at : at + STEP], float)
            if rule == "dot":  # a residual's share is smaller where a bin is fuller
                score = ((1 - r / cap) * scale) @ need
                limit = (1 - r[0, 0] / cap[0]) * scale[0] * n + scale[1] + scale[2] * n * n
            else:
                score = -(((r - need) * scale) ** 2).sum(axis=1)
                limit = -(((r[0, 0] - n) * scale[0]) ** 2)
            if limit < best:
                break
            score[(r < need).any(axis=1)] = -np.inf
            k = int(np.argmax(score))
            if score[k] > best:
                best, found = score[k], order[at + k]
        return found

    for n in sorted((n for n in counts if n <= capacity), reverse=True):
        first, left = 0, counts[n]
        while left:
            s = choose(n)
            if s is None:
                per = max(1, min(capacity // n, docs, cost // (n * n)))
                bins = -(-left // per)
                full = left // per
                for k, (size, m) in enumerate(((per, full), (left - full * per, bins - full))):
                    if m:
                        for j in range(size):
                            runs.append((n, first, m, next_seq, j * n))
                            first += m
                        state = (capacity - size * n, docs - size, cost - size * n * n)
                        if state[0] and state[1] > 0 and state[2] > 0:
                            add(state, [next_seq, m, size * n])
                        next_seq += m
                left = 0
                continue
            block = open_[s][-1]
            m = min(left, block[1])
            runs.append((n, first, m, block[0], block[2]))
            state = (s[0] - n, s[1] - 1, s[2] - n * n)
            if state[0] and state[1] > 0 and state[2] > 0:
                add(state, [block[0], m, block[2] + n])
            block[0] += m
            block[1] -= m
            if not block[1]:
                open_[s].pop()
                if not open_[s]:
                    del open_[s]
                    order.pop(bisect_left(order, s))
            first += m
            left -= m
    return runs


#: States that are scored at a time.
STEP = 64


def _pieces(tokenizer: str, capacity: int, end: int):
    def run(batches):
        enc = encoder(tokenizer)
        mark = np.uint32(end).tobytes()
        for batch in batches:
            rest, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = enc.encode(text) + mark
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rest.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            cols = [batch.column("id").take(pa.array(rest, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "crc"])

    return run


def _place(runs: np.ndarray):
    """Sequence and offset from length and rank, by binary search in the plan."""
    keys = runs[:, 0] << 44 | runs[:, 1]

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, n << 44 | rank, side="right") - 1
            cols = [*(batch.column(c) for c in ("id", "piece", "start", "length", "crc")), pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, max_docs: int | None = None, max_cost: int | None = None, rule: str = "dot", weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Packs documents into sequences of at most `capacity` tokens, max_docs pieces and max_cost summed squared lengths.

    A document is its ids, then `end`; a longer one is cut into pieces of `capacity`. Returns a row for each piece:
    id_col, piece (int), start, length, ids_crc32, sequence_id, offset (places without gaps from 0). A null or empty text is one
    piece of one token. Repeated rows are pieces of their own; a null id stays null. Other columns aren't read.
    A piece that no bin may hold (max_cost below its own cost) gets a sequence of its own. Empty table, empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    kinds = f"id {kind}, piece int, start long, length long, crc long"
    rows = stored(mapped(src, _pieces(tokenizer, capacity, end), kinds), "pieces")
    salts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc", "start"), F.lit(salts)).cast("int"))
    groups = rows.groupBy("length", "salt").agg(F.count("*").alias("c"))
    base = groups.withColumn("base", F.sum("c").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    base = stored(base.select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"), "c"), "bases")
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("c")).collect()}  # at most `capacity` rows
    runs = np.array(plan(counts, capacity, max_docs, max_cost, rule, weights), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "crc"))
    ranked = rows.withColumn("within", within).join(base.drop("c"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within") - 1)
    release(spark)
    placed = mapped(ranked.select("id", "piece", "start", "length", "crc", F.col("rank").cast("long").alias("rank")), _place(runs), kinds + ", sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col).withColumnRenamed("crc", "ids_crc32")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts, sequences of 4096 tokens; the other capacities don't bind."""
    from public_tokenizers import path

    return pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents that are left."""
    from public_tokenizers import path

    return pack(docs, path("word_bpe_49k.json"))
