"""Bounded samples of labelled rows, and calibration of their raw scores."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import stored, text_of

#: Bytes of text that a class's sample may have in all, and a text of it.
MOST_BYTES, LONGEST = 48 << 20, 1 << 20


def trim() -> None:
    """Gives memory that training no longer needs back to the system; the driver has other work to do after it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod (null ids: of the empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "utf-8")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()):
    """At most `most` rows of each class, least hashes first, of labels whose remainder isn't `held`, as far as MOST_BYTES
    of text go: (texts as an Arrow table with text, y, h and extra columns, weights that give the classes their shares
    back). Null ids and labels are left out, and so are texts beyond LONGEST bytes; a label's id that repeats has its largest label,
    a document's id that repeats its least row."""
    want = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", mod) != held))
    want = want.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).select(F.col("doc_id").alias("lid"), "y", F.xxhash64("doc_id").alias("h"))
    total = {r.y: r["n"] for r in want.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [want.filter(F.col("y") == y).orderBy("h", "lid").limit(most) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])  # at most 2 * most rows
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), *[F.col(f"`{c}`") for c in extra])
    rows = src.filter(F.octet_length("text") <= LONGEST).join(F.broadcast(ids), src.id == ids.lid).groupBy("lid", "y", "h").agg(F.min(F.struct("text", *extra)).alias("d"))
    rows = stored(rows.select("lid", "y", "h", "d.*"), "sample")
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("h", "lid"))
    chosen = rows.select("lid", size.alias("size")).filter(F.col("size") <= MOST_BYTES).select("lid")
    got = rows.join(F.broadcast(chosen), "lid", "left_semi").select("text", "y", "h", *extra).orderBy("h", "text").toArrow()
    y = np.asarray(got.column("y").to_numpy(), int)
    weight = np.array([total.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    return got, y, (weight / max(weight.sum(), 1e-9) * 2)[y] if len(y) else np.zeros(0)


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) with sigmoid(a * raw + b) as the chance of label 1, by damped Newton steps; a isn't negative."""
    m, s = float(raw.mean()), float(raw.std()) or 1.0
    x, (a, b) = (raw - m) / s, (1.0, 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(hess, [(g * x).sum() + 1e-2 * a, g.sum()])
        a, b = a - 0.7 * da, b - 0.7 * db
    a = max(a, 0.0)
    return a / s, b - a * m / s


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score from which calling a row 1 has the greatest F1, midway to the next lower score."""
    o = np.argsort(-p, kind="stable")
    p, y, weight = p[o], y[o], weight[o]
    hit, called = np.cumsum(weight * y), np.cumsum(weight)
    f = 2 * hit / (called + (weight * y).sum())
    f[:-1][p[:-1] == p[1:]] = -1  # equal scores are called together
    k = int(np.argmax(f))
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])
