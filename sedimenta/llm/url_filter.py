"""URL filters: rules by host and path, and a character language-model ratio for all other URLs.

Two variable-order Markov models, of URLs that the rules accept and of those that they reject, predict each character
from up to ORDER characters before it. Contexts are counted as they are, in tables that grow with the input; at a
place the longest context that was seen LEAST times decides, with added smoothing. A URL's score is the mean log-likelihood
difference of its characters; the cut is the one that separates rule-decided URLs, kept out of the
counts, best. Places with the same ORDER + 1 characters have the same difference, so it's found once for each such
string and joined back. Built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import hot_keys, spread_join, stored, table

ORDER, LEAST, SMOOTHING = 4, 8, 0.5
#: Differences are kept in units of 1 / SCALE, so that sums don't depend on the order of rows.
SCALE = 1_000_000
#: (verdict, rule) of the production query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of the rule-decided URLs (by hash) that calibrates; width and number of score bins on either side of 0.
HELD, BIN, BINS = 5, 0.01, 500
#: Characters of a URL that are taken apart at a time.
PIECE = 4096


@dataclass
class Model:
    """Differences in units of 1 / SCALE: `ratios` (text, ratio) of a context with a character after it, `contexts` (context,
    other) of a context with a character that it never had; None without URLs of both verdicts. The least accepted score."""

    contexts: DataFrame | None
    ratios: DataFrame | None
    cut: float


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without "://"."""
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _places(rows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, text): each character of the column u, and its end, with the ORDER characters before it. A URL is cut into pieces, which
    overlap by ORDER, and a piece into characters once, so the work is linear in the URL's length and a row holds a piece at a time."""
    padded = F.concat(F.lit("\x02" * ORDER), F.coalesce(F.col("u"), F.lit("")), F.lit("\x03"))
    ends = F.sequence(F.lit(1), F.length("u") - ORDER, F.lit(PIECE))
    # the outer forms, as Spark would otherwise work the arrays out once more to drop empty ones, which don't occur
    pieces = rows.select(*keep, padded.alias("u")).select(*keep, F.explode_outer(F.transform(ends, lambda i: F.substring(F.col("u"), i, F.lit(PIECE + ORDER)))).alias("piece"))
    pieces = pieces.select(*keep, F.split("piece", "").alias("chars"))
    runs = F.transform(F.sequence(F.lit(1), F.size("chars") - ORDER), lambda i: F.array_join(F.slice("chars", i, F.lit(ORDER + 1)), ""))
    return pieces.select(*keep, F.explode_outer(runs).alias("text"))


def _orders(texts: DataFrame, *keep: str) -> DataFrame:
    """(*keep, k, context, text): the end of each text for each order."""
    each = texts.select(*keep, F.col("text").alias("whole"), F.explode(F.array(*[F.lit(k) for k in range(1, ORDER + 1)])).alias("k"))
    end = F.substring("whole", ORDER + 1 - F.col("k"), F.col("k") + 1)
    return each.select(*keep, "k", end.alias("text")).withColumn("context", F.substring("text", F.lit(1), F.col("k")))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(row, score) of rows (row, u): mean log-likelihood difference of the URL's characters (with its end). row is unique."""
    if model.ratios is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    places = _places(rows, "row")
    texts = stored(places.groupBy("text").agg(F.count("*").alias("n")), "texts")
    ends = _orders(texts.withColumn("place", F.col("text")), "place")
    hot = lambda c: hot_keys(ends.groupBy(c).agg(F.count("*").alias("n")), c, "n")
    seen = spread_join(ends, model.contexts, ["context"], "context", hot("context"), ["place"])
    seen = spread_join(seen, model.ratios, ["text"], "text", hot("text"), ["place"], "left")
    best = seen.groupBy("place").agg(F.max_by(F.coalesce("ratio", "other"), "k").alias("ratio"))
    each = stored(best.select(F.col("place").alias("text"), "ratio"), "ratios")
    joined = spread_join(places, each, ["text"], "text", hot_keys(texts, "text", "n"), ["row"], "left")
    return joined.groupBy("row").agg((F.sum(F.coalesce("ratio", F.lit(0))) / SCALE / F.count("*")).alias("score"))


def _model(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts, ratios) from (v, u)."""
    num = lambda c, v: F.sum(F.when(F.col("v") == v, F.col("n")).otherwise(0)).alias(c)
    texts = stored(_places(counted, "v").groupBy("v", "text").agg(F.count("*").alias("n")), "texts")
    pairs = stored(_orders(texts, "v", "n").groupBy("context", "text").agg(num("a", "allow"), num("b", "block")), "pairs")
    size = SMOOTHING * (1 + pairs.filter(F.length("text") == 2).select(F.substring("text", 2, 1)).distinct().count())
    whole = pairs.groupBy("context").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).filter(F.col("na") + F.col("nb") >= LEAST)
    whole = stored(whole, "contexts")
    difference = lambda a, b: F.round((F.log((a + SMOOTHING) / (F.col("na") + size)) - F.log((b + SMOOTHING) / (F.col("nb") + size))) * SCALE).cast("long")
    none = F.lit(0)
    ratios = pairs.join(whole, "context").select("text", difference(F.col("a"), F.col("b")).alias("ratio"))
    return stored(whole.select("context", difference(none, none).alias("other")), "others"), stored(ratios, "known")


def fit(pages: DataFrame, url_col: str = "url", rules=RULES) -> Model:
    """Counts of four fifths of the rule-decided URLs, the cut from the rest. Without URLs of both verdicts all are accepted."""
    url = F.col(f"`{url_col}`")
    verdict = match(*split_url(url), rules)[1]
    own = pages.select(url.alias("u"), verdict.alias("v")).filter("v is not null")
    own = own.withColumn("held", F.pmod(F.xxhash64("u"), F.lit(HELD)) == 0)
    if own.filter("not held").select("v").distinct().count() < 2:
        return Model(None, None, -math.inf)
    model = Model(*_model(own.filter("not held")), -math.inf)
    held = stored(own.filter("held").select("v", "u", F.monotonically_increasing_id().alias("row")), "held")
    b = F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(BINS)), F.lit(-BINS))
    hist = {(r.v, r.b): r.n for r in held.select("v", "row").join(score(held, model), "row").select("v", b.alias("b")).groupBy("v", "b").agg(F.count("*").alias("n")).collect()}
    good, bad = (max(1, sum(n for (v, _), n in hist.items() if v == w)) for w in ("allow", "block"))
    best, first, last, lost, stopped = -1.0, 0, 0, 0, 0
    for x in range(-BINS, BINS + 1):  # accept from bin x on; the middle of the best cuts
        gain = 1 - lost / good + stopped / bad
        if gain > best:
            best, first = gain, x
        if gain == best:
            last = x
        lost, stopped = lost + hist.get(("allow", x), 0), stopped + hist.get(("block", x), 0)
    model.cut = (first + last) / 2 * BIN
    return model


def judge(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id_col, host, path, rule (null if none fits), verdict (allow or block), score. A null URL has empty host and path and the
    score of the empty string. Rows are judged one by one: null or repeated ids and repeated rows don't matter, other columns aren't read."""
    url = F.col(f"`{url_col}`")
    host, path = split_url(url)
    rows = stored(pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("u"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    d = rows.join(score(rows.select("row", "u"), model), "row")
    d = d.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("_v"), "score")
    own = F.when(F.col("score") >= F.lit(model.cut), F.lit("allow")).otherwise(F.lit("block"))
    return d.select(id_col, "host", "path", "rule", F.coalesce("_v", own).alias("verdict"), "score")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(pages))
