"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first bytes, so that inflected forms of a
stem share what they learn. Filters of several widths slide over the words; each filter's greatest response (and at
least 0) goes to a logistic output. Scores are calibrated on rows that training didn't see, and so are the
thresholds by language. Language is never an input of the score."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sedimenta.llm.bytetext import BASE, NOT_ALNUM, U, Words, chunks, column, mix, span
from sedimenta.llm.common import ARROW_ROWS, ship, table, text_of
from sedimenta.llm.labelled import best_threshold, platt, remainder, sample, trim

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 16, 16, (1, 2, 3), (4, 5)
#: Labelled rows of each class that training and calibration take at most.
SAMPLE = 3000
#: Fewest rows of each class by which a language gets a threshold of its own.
LEAST = 30
_PADS = max(WIDTHS) - 1
#: Words that the forward pass takes at a time.
BLOCK = 1 << 16


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, of): bucket ids of each word (word and prefixes; 0 pads _PADS places after each text), and each text's first place."""
    w = Words(data, offs, NOT_ALNUM)
    hashes = [w.hash] + [mix(span(w.h, BASE[0], w.start, np.minimum(w.start + k, w.end)) + U(k)) for k in PREFIXES]
    ids = np.stack([(h % U(BUCKETS - 1)).astype(np.int32) + 1 for h in hashes], axis=1)
    out = np.zeros((len(w.doc) + _PADS * (len(offs) - 1), ids.shape[1]), np.int32)
    out[np.arange(len(w.doc)) + _PADS * w.doc] = ids
    return out, w.of + _PADS * np.arange(len(offs))


@dataclass
class Model:
    emb: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    a: float = 1.0
    b: float = 0.0
    #: Score of every text where there is nothing to learn from.
    prior: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    def pooled(self, ids: np.ndarray, of: np.ndarray):
        """(word vectors, responses, greatest response of each filter and text)."""
        x = self.emb[ids].sum(axis=1)
        n = len(x) - _PADS
        z = np.empty((len(x), len(self.filters) * FILTERS), np.float32)
        for k, w in enumerate(self.filters):
            part = z[:, k * FILTERS : (k + 1) * FILTERS]
            part[:n] = x[:n] @ w[0]
            for j in range(1, len(w)):
                part[:n] += x[j : n + j] @ w[j]
        z += self.bias
        z[ids[:, 0] == 0] = 0
        return x, z, np.maximum(np.maximum.reduceat(z, of[:-1], axis=0), 0)

    def raw(self, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Outputs before calibration, BLOCK places at a time: a text of any length needs no more memory than a block."""
        top = np.zeros((len(of) - 1, len(self.filters) * FILTERS), np.float32)
        for a in range(0, len(ids), BLOCK):
            b = min(a + BLOCK, len(ids))
            first = int(np.searchsorted(of, a, side="right")) - 1
            last = int(np.searchsorted(of, b, side="left"))
            cut = np.append(np.maximum(of[first:last], a), b + _PADS) - a
            part = ids[a : b + _PADS]
            part = np.concatenate([part, np.zeros((b + _PADS - a - len(part), ids.shape[1]), ids.dtype)])
            x = self.emb[part].sum(axis=1)
            z = np.empty((b - a, top.shape[1]), np.float32)
            for k, w in enumerate(self.filters):
                z[:, k * FILTERS : (k + 1) * FILTERS] = sum(x[j : j + b - a] @ w[j] for j in range(len(w)))
            z += self.bias
            z[part[: b - a, 0] == 0] = 0
            top[first:last] = np.maximum(top[first:last], np.maximum.reduceat(z, cut[:-1], axis=0))
        return top @ self.out + self.out_bias

    def score(self, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(of) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(ids, of) + self.b, -30, 30)))


def train(ids: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray, only: np.ndarray | None = None, epochs: int = 0, batch: int = 64, rate: float = 0.1, seed: int = 7) -> Model:
    """Weighted logistic loss, Adagrad; gradients flow through the greatest responses alone. Six epochs, more (up to 20) where rows are few."""
    chosen = np.arange(len(y)) if only is None else only
    epochs = epochs or max(6, min(20, 40_000 // max(1, len(chosen))))
    r = np.random.default_rng(seed)
    emb = (r.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32)
    emb[0] = 0
    filters = [(r.normal(size=(w, DIM, FILTERS)) * (0.5 / w**0.5)).astype(np.float32) for w in WIDTHS]
    k = len(WIDTHS) * FILTERS
    m = Model(emb, filters, np.zeros(k, np.float32), (r.normal(size=k) * 0.1).astype(np.float32), 0.0)
    memory = [np.full_like(p, 1e-3) for p in (m.emb, *m.filters, m.bias, m.out)] + [np.array(1e-3)]

    def step(i, p, g, at=slice(None)):
        memory[i][at] += g * g
        p[at] -= rate * g / np.sqrt(memory[i][at])

    for _ in range(epochs):
        order = chosen[r.permutation(len(chosen))]
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            sizes = of[rows + 1] - of[rows]
            at = np.cumsum(np.append(0, sizes))
            part = ids[np.repeat(of[rows] - at[:-1], sizes) + np.arange(at[-1])]
            x, z, pool = m.pooled(part, at)
            p = 1 / (1 + np.exp(-np.clip(pool @ m.out + m.out_bias, -30, 30)))
            e = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dpool = e[:, None] * m.out * (pool > 0)
            doc, f = np.nonzero(dpool)
            top = _first_places(z, at, pool, doc, f)
            g = dpool[doc, f]
            demb_at, demb = [], []
            for c, w in enumerate(m.filters):
                own = (f // FILTERS) == c
                fo, to, go = f[own] % FILTERS, top[own], g[own]
                dw = np.zeros_like(w)
                for j in range(len(w)):
                    np.add.at(dw[j].T, fo, x[to + j] * go[:, None])
                    demb_at.append(to + j), demb.append(w[j].T[fo] * go[:, None])
                step(1 + c, w, dw)
            dbias = np.zeros(k, np.float32)
            np.add.at(dbias, f, g)
            step(1 + len(WIDTHS), m.bias, dbias)
            dout = pool.T @ e
            step(2 + len(WIDTHS), m.out, dout.astype(np.float32))
            memory[-1] += e.sum() ** 2
            m.out_bias -= rate * float(e.sum()) / float(np.sqrt(memory[-1]))
            if demb_at:
                words = part[np.concatenate(demb_at)]
                u, inv = np.unique(words, return_inverse=True)
                ge = np.zeros((len(u), DIM), np.float32)
                np.add.at(ge, inv.reshape(words.shape), np.concatenate(demb)[:, None, :])
                step(0, m.emb, ge, u)
                m.emb[0] = 0
    return m


def _first_places(z, at, pool, doc, f):
    """The first place of each (text, filter) whose response is the greatest."""
    seg = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place, filt = np.nonzero(z == pool[seg])
    key = seg[place] * z.shape[1] + filt
    u, first = np.unique(key, return_index=True)
    return place[first[np.searchsorted(u, doc * z.shape[1] + f)]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held: int = 2, most: int = SAMPLE) -> Model:
    """A calibrated model from at most `most` labelled rows of each class; a quarter of them calibrates."""
    langs = ("lang",) if "lang" in docs.columns else ()
    got, y, weight = sample(docs, labels, label, mod, held, most, extra=langs)
    if len(set(y.tolist())) < 2:
        m = Model(np.zeros((1, DIM)), [], np.zeros(0), np.zeros(0), 0.0)
        m.prior = float(y.mean()) if len(y) else 0.0
        return m
    parts = [features(d, o) for _, _, d, o in chunks(*column(got, "text"))]
    ids = np.concatenate([p[0] for p in parts])
    of = np.cumsum(np.concatenate([[0], *(np.diff(p[1]) for p in parts)]))
    test = np.asarray(got.column("h").to_numpy()) % 4 == 0
    names = np.array([x or "" for x in got.column("lang").to_pylist()]) if langs else None
    del got, parts
    trim()
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        test = np.arange(len(y)) % 2 == 0
    fit_rows = np.flatnonzero(~test)
    sizes = np.diff(of)
    m = train(ids, of, y, np.ones(len(y)), fit_rows)
    raw = np.concatenate([m.raw(ids[of[i] : of[i + 1]], np.array([0, sizes[i]])) for i in np.flatnonzero(test)])
    yt, wt = y[test], weight[test]
    m.a, m.b = platt(raw, yt, wt)
    p = 1 / (1 + np.exp(-np.clip(m.a * raw + m.b, -30, 30)))
    m.threshold = best_threshold(p, yt, wt)
    if langs:
        names = names[test]
        for name in set(names.tolist()) - {""}:
            own = names == name
            if min((yt[own] == 0).sum(), (yt[own] == 1).sum()) >= LEAST:
                m.thresholds[name] = best_threshold(p[own], yt[own], wt[own])
    del ids, of
    trim()
    return m


def _chance(model):
    """A function of a text column for the score; the text alone goes to Python and a number comes back."""

    @F.arrow_udf(DoubleType())
    def chance(texts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), ARROW_ROWS):
            data, offs = column(pa.record_batch([texts.slice(i, ARROW_ROWS)], ["text"]), "text")
            out += [model.value.score(*features(d, o)) for _, _, d, o in chunks(data, offs, 1 << 18)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return chance


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(rest, score, flagged): rest is the row as a struct, score the chance of label 1 (0 to 1) from the whole text alone, flagged
    whether it reaches the threshold of the row's lang (of all languages where lang is null, unknown or no column). Null and empty
    texts have the score of no words. Rows are worked on one by one, so repeated rows and ids don't matter."""
    ship(docs.sparkSession)
    chance = _chance(docs.sparkSession.sparkContext.broadcast(model))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), chance(text_of(text_col)).alias("score"))
    limit = F.lit(model.threshold)
    if "lang" in docs.columns:
        for name, t in sorted(model.thresholds.items()):
            limit = F.when(F.col("rest.lang") == name, F.lit(t)).otherwise(limit)
    return out.withColumn("flagged", F.col("score") >= limit)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; labels of rows with remainder 2 of 4 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("rest.doc_id").alias("doc_id"), (remainder("rest`.`doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("flagged").alias("over_language_threshold"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents over the threshold of their language go."""
    out = score(docs, fit(docs, table(spark, sf_dir, "labels"))).filter("not flagged")
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
