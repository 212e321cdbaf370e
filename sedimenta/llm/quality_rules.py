"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio between trusted text and the corpus.

Everything is built-in functions on the JVM. Words and pairs of words are hashed to BUCKETS; two multinomials with
added smoothing, of trusted documents and of all documents, give each bucket a log ratio. A text's score is the mean
ratio of its n-grams. The threshold is a low quantile of the trusted documents' own scores, so the same text always
has the same verdict. Buckets are a fixed number, so the table that goes into the plan doesn't grow with the data."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import table, text_of
from sedimenta.llm.native import constants, let, words

BUCKETS, SMOOTHING = 8192, 1.0
#: Share of the trusted documents that may score below the threshold.
QUANTILE = 0.005
#: Ids of trusted documents that are broadcast at most, so that texts needn't be shuffled; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
WINDOW = 8


@dataclass
class Model:
    ratios: list[float]
    threshold: float


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _grams(h: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.when(F.size(h) > 1, F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(h[i], x), F.lit(BUCKETS)).cast("int")))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def _mean_ratio(h: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a text's n-grams; 0 for a text without words."""
    t = constants(ratios)
    return let(_grams(h), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + t[b]) / F.size(g)).otherwise(F.lit(0.0)))


def _repeated_words(h: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more, the first one included."""
    last = F.size(h) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(h, i + 1, WINDOW)))

    def places(s):
        """Places of windows with an equal neighbour, in a list sorted by hash."""
        same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def count(w):
        s = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        new = lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(s, lambda s: let(places(s), new))).otherwise(F.lit(0))

    return F.when(last >= 1, let(windows, count)).otherwise(F.lit(0)).cast("long")


def statistics(text: Column, ratios: list[float] | None = None) -> Column:
    """A struct of the base columns of a text and, with ratios, its mean log ratio."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")

    def rest(h):
        cols = [F.size(h).cast("long").alias("n_words"), _repeated_words(h).alias("n_repeat_words")]
        return F.struct(*cols, *([_mean_ratio(h, ratios).alias("mean_ratio")] if ratios else []))

    chars = F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long")
    return F.struct(let(_hashes(text), rest).alias("r"), chars.alias("word_chars"), symbols.alias("n_symbols"), n.alias("n_dup_lines"))


def _counts(df: DataFrame) -> dict[int, int]:
    """Counts of the buckets, at most BUCKETS rows."""
    g = df.select(F.explode(let(_hashes(F.col("text")), _grams)).alias("b"))
    return {r.b: r["n"] for r in g.groupBy("b").agg(F.count("*").alias("n")).collect()}


def _low_quantile(scores: DataFrame, n: int) -> float:
    """The QUANTILE of n scores (s), between neighbours in proportion, as percentile() has it; only the scores below it leave their tasks."""
    at = QUANTILE * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    v = [x.s for x in scores.orderBy("s").limit(high + 1).orderBy(F.desc("s")).limit(high - low + 1).collect()]
    return v[0] if low == high else (high - at) * v[1] + (at - low) * v[0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Ratios and threshold from all documents labelled 1, and from all documents. Without trusted documents all ratios are 0."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    want = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("q")).filter("q = 1")
    want = want.select(F.col("doc_id").alias("id"))
    trusted = src.join(F.broadcast(want) if want.count() <= BROADCAST_IDS else want, "id", "left_semi")
    t, r = _counts(trusted), _counts(src)
    if not t:
        return Model([0.0] * BUCKETS, 0.0)
    nt, nr = sum(t.values()) + SMOOTHING * BUCKETS, sum(r.values()) + SMOOTHING * BUCKETS
    ratios = [math.log((t.get(b, 0) + SMOOTHING) / nt) - math.log((r.get(b, 0) + SMOOTHING) / nr) for b in range(BUCKETS)]
    own = trusted.select(let(_hashes(F.col("text")), lambda h: _mean_ratio(h, ratios)).alias("s"))
    return Model(ratios, float(_low_quantile(own, trusted.count())))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, mean_ratio, kept.

    Words are runs of anything but ASCII white space. A null text has no words: it fails. Rows are judged one by one, so
    null or repeated ids and repeated rows don't matter; other columns aren't read. An empty table gives an empty result."""
    d = docs.select(F.col(f"`{id_col}`").alias(id_col), statistics(text_of(text_col), model.ratios).alias("s"))
    d = d.select(id_col, "s.r.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.r.n_repeat_words", "s.r.mean_ratio")
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("mean_ratio") >= F.lit(model.threshold)))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
