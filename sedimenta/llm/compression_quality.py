"""Quality by compression: how much better a dictionary of good text helps than one of bad text.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed with each;
the difference of the two sizes over its own length is its raw score (junk that merely repeats itself gains from neither), which a logistic curve, fitted on rows that the
dictionaries didn't see, turns into the chance of label 1."""

from __future__ import annotations

import threading
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sedimenta.llm.common import fresh, mapped, table
from sedimenta.llm.labelled import platt, remainder, sample

#: Labelled rows of each class at most; bytes of a dictionary; compression level.
SAMPLE, DICTIONARY, LEVEL = 3000, 110 << 10, 3
#: The dictionary's trainer takes whole texts, in pieces of at most so many bytes.
PIECE = 4000


@dataclass
class Model:
    good: bytes
    bad: bytes
    a: float = 1.0
    b: float = 0.0
    #: Score of every text where there is nothing to learn from.
    prior: float | None = None

    def raw(self, texts) -> np.ndarray:
        made = _compressors(self.good, self.bad)
        sizes = np.array([[len(c.compress(t)) for c in made] for t in texts], float).reshape(-1, 2)
        return (sizes[:, 1] - sizes[:, 0]) / np.array([max(len(t), 1) for t in texts])

    def score(self, texts) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(texts) + self.b, -30, 30)))


_local = threading.local()


def _compressors(good: bytes, bad: bytes):
    """Compressors are kept by worker; loading a dictionary costs more than compressing a short text."""
    if getattr(_local, "of", None) != (good, bad):
        out = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False))
        _local.of, _local.made = (good, bad), out
    return _local.made


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    texts = [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]
    size = min(DICTIONARY, max(1 << 10, sum(map(len, texts)) // 30))
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, most: int = SAMPLE) -> Model:
    """Dictionaries from three quarters of at most `most` labelled rows of each class, calibration from the rest."""
    got, y, weight = sample(docs, labels, label, mod, held, most)
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", prior=float(y.mean()) if len(y) else 0.0)
    texts = [t.encode() for t in got.column("text").to_pylist()]
    test = np.asarray(got.column("h").to_numpy()) % 4 == 0
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        test = np.arange(len(y)) % 2 == 0
    m = Model(*(dictionary([texts[i] for i in np.flatnonzero(~test & (y == k))]) for k in (1, 0)))
    m.a, m.b = platt(m.raw([texts[i] for i in np.flatnonzero(test)]), y[test], weight[test])
    return m


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            s = m.score([(t or "").encode() for t in batch.column("text_").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(s, pa.float64())], ["rest", "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(rest, score): rest is the row as a struct, score the chance of label 1 (0 to 1) from the whole text alone. Null is the empty
    text, which has a score like others. Rows are worked on one by one, so repeated rows and ids don't matter."""
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias(fresh(docs, "pad")[0])).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    kinds = StructType([src.schema["rest"], StructField("score", DoubleType())])
    return mapped(src, _score(docs.sparkSession.sparkContext.broadcast(model)), kinds)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; labels of rows with remainder 0 of 5 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("rest.doc_id").alias("doc_id"), (remainder("rest`.`doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
