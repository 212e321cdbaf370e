"""Retrieval: exact nearest neighbours, lexical search over postings, term pruning and reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import cosine_distance, dot_product, last_segment, lexical_terms, query_identifiers
from sedimenta.operators.texts import STOP_SQL, terms_sql
from sedimenta.plans.registry import query

c = F.col
TERM = r"[a-z0-9]+"


def nearest(vectors: DataFrame, question: list[float], k: int, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """The k rows of least cosine distance, by an exact scan; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in question])
    return vectors.select(id_col, cosine_distance(c(col), q).alias("distance")).orderBy("distance", id_col).limit(k)


def nearest_each(questions: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding", block: int = 2048, own: bool = False) -> DataFrame:
    """(qid, id_col, distance, rank): for each of questions (qid, q) the k rows of least cosine distance, without the one of its
    own id unless `own`, by an exact scan; ties by id, which is unique. Vectors come in blocks of about `block` rows, and a question takes k rows of each block
    at most before they are merged. Vectors without a length have no distance and are nobody's neighbour."""
    parts = max(1, -(-vectors.count() // block))
    # lengths are worked out once for each vector; a pair takes one product, with the arithmetic of cosine_distance()
    item = F.struct(c(id_col).alias("id"), c(col).alias("v"), c("length"))
    blocks = vectors.select(id_col, col, F.sqrt(dot_product(c(col), c(col))).alias("length")).groupBy(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("block")).agg(F.collect_list(item).alias("rows"))
    far = F.transform("rows", lambda x: F.struct((1 - dot_product(x["v"], c("q")) / F.nullif(x["length"] * c("q_length"), F.lit(0.0))).alias("distance"), x["id"].alias("id")))
    near = F.slice(F.array_sort(F.filter(far, lambda x: x["distance"].isNotNull() & (F.lit(own) | (x["id"] != c("qid"))))), 1, k)
    top = questions.withColumn("q_length", F.sqrt(dot_product(c("q"), c("q")))).crossJoin(blocks).select("qid", F.explode(near).alias("x")).select("qid", c("x.id").alias(id_col), "x.distance")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", id_col))).filter(c("rank") <= k)


#: Question terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, root, is_prefix) of questions (qid, question)."""
    each = questions.select("qid", F.explode(lexical_terms(c("question"))).alias("t"))
    return each.select("qid", c("t.term").alias("root"), c("t.is_prefix").alias("is_prefix"))


def postings(docs: DataFrame, id_col: str, text: Column, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word, n): how often each document has each word that matches one of terms (root, is_prefix); and (root, word), what
    matches what. One scan; other words go before anything is grouped. Persisted, as a search reads them again."""
    roots = terms.select("root", "is_prefix").distinct().withColumn("head", F.substring("root", 1, 4)).persist()
    if roots.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        roots = F.broadcast(roots)
    match = (c("w.head") == c("r.head")) & ((c("word") == c("root")) | (c("is_prefix") & F.startswith("word", "root")))
    words = docs.select(c(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("word")).withColumn("head", F.substring("word", 1, 4))
    post = words.alias("w").join(roots.alias("r"), match, "left_semi").groupBy("id", "word").agg(F.count("*").alias("n")).persist()
    known = post.select("word").distinct().withColumn("head", F.substring("word", 1, 4))
    return post, known.alias("w").join(roots.alias("r"), match).select("root", "word").persist()


def selective(terms: DataFrame, post: DataFrame, forms: DataFrame, n_docs: DataFrame, share: float = 0.25) -> DataFrame:
    """(qid, root) of question terms that at most `share` of the documents match; all of a question's if under two are left."""
    df = forms.join(post, "word").select("root", "id").distinct().groupBy("root").agg(F.count("*").alias("df"))
    q = terms.join(df, "root", "left").crossJoin(F.broadcast(n_docs.agg(F.count("*").alias("n"))))  # one row
    q = q.withColumn("rare", F.coalesce(c("df"), F.lit(0)) <= share * c("n"))
    few = q.groupBy("qid").agg(F.count_if("rare").alias("left"))
    return q.join(few, "qid").filter("rare or left < 2").select("qid", "root")


def lexical(kept: DataFrame, post: DataFrame, forms: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k documents with most places that match a question's terms (qid, root), which is the order that
    cover density gives to alternatives; a place counts once, however many terms match it; ties by id."""
    words = kept.join(forms, "root").select("qid", "word").distinct()
    s = words.join(post, "word").groupBy("qid", "id").agg(F.sum("n").alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(c("rank") <= k)


def keyword_hits(questions: DataFrame, docs: DataFrame, id_col: str, text: Column, k: int) -> DataFrame:
    """lexical() of questions (qid, question) against docs, without terms that most documents have."""
    terms = question_terms(questions)
    post, forms = postings(docs, id_col, text, terms)
    return lexical(selective(terms, post, forms, docs), post, forms, k)


def symbol_hits(questions: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, rank) of chunks whose symbol a question (qid, question) names, whole or by its last part: whole names first, then
    long ones; ties by id."""
    names = questions.select("qid", F.explode(query_identifiers(c("question"))).alias("name"))
    own = chunks.filter("source_type = 'code' and symbol_name is not null").select("id", F.lower("symbol_name").alias("full"), (c("end_line") - c("start_line")).alias("span"))
    forms = own.select("id", "span", F.explode(F.array_distinct(F.array(c("full"), last_segment(c("full"))))).alias("name"), "full")
    hit = forms.join(names, "name").groupBy("qid", "id").agg(F.max((c("name") == c("full")).cast("int")).alias("whole"), F.first("span").alias("span"))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("whole"), F.desc("span"), "id"))).filter(c("rank") <= k).select("qid", "id", "rank")


def pinned_chunks(questions: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, place): chunks that the selection (focus_path, focus_start, focus_end) of a question overlaps, shortest first."""
    q = questions.filter("focus_path is not null and focus_start is not null").select("qid", c("focus_path").alias("path"), "focus_start", F.coalesce("focus_end", "focus_start").alias("focus_end"))
    hit = chunks.join(q, "path").filter("start_line <= focus_end and end_line >= focus_start")
    w = Window.partitionBy("qid").orderBy(c("end_line") - c("start_line"), "id")
    return hit.withColumn("place", F.row_number().over(w)).filter(c("place") <= k).select("qid", "id", "place")


def hybrid_search(questions: DataFrame, chunks: DataFrame, limit: int = 12, candidates: int = 50, neighbours: DataFrame | None = None) -> DataFrame:
    """Hybrid search as one call: (qid, place, id, score, matched_by) for questions (qid, question, vector, focus_path, focus_start,
    focus_end) over chunks (id, source_type, path, symbol_name, start_line, end_line, content, embedding).

    Chunks under a question's selection are pinned: first, with score 1, whatever their rank. Then come `limit` others by reciprocal
    rank fusion of the semantic, keyword and symbol lists (weights 1, 1, 2); the list `neighbours` (qid, id, rank) of chunks one
    step away in the graph weighs 1.5. What lies in the selection's file counts half as much again. A chunk that overlaps a better
    one of its path by over 60 % of the shorter goes. Ties go by id."""
    pins = pinned_chunks(questions, chunks)
    names = pins.join(chunks.select("id", "symbol_name"), "id").groupBy("qid").agg(F.array_join(F.collect_list("symbol_name"), " ").alias("names"))
    asked = questions.join(names, "qid", "left").select("qid", F.concat_ws(" ", "question", "names").alias("question"))
    vectors = chunks.filter("embedding is not null").select("id", "embedding")
    near = nearest_each(questions.filter("vector is not null").select("qid", c("vector").alias("q")), vectors, candidates, "id", own=True)
    lists = [(near, "semantic", 1.0), (keyword_hits(asked, chunks, "id", c("content"), candidates), "keyword", 1.0), (symbol_hits(questions, chunks), "symbol", 2.0)]
    lists += [(neighbours, "graph", 1.5)] if neighbours is not None else []
    ranked = fuse(reduce(DataFrame.unionByName, [d.select("qid", "id", "rank", F.lit(n).alias("label"), F.lit(w).alias("weight")) for d, n, w in lists]))
    place = chunks.select("id", "path", c("start_line").alias("start"), c("end_line").alias("end"))
    own = questions.select("qid", "focus_path")
    ranked = ranked.join(pins.select("qid", "id"), ["qid", "id"], "left_anti").join(place, "id").join(own, "qid")
    same = F.coalesce(c("path") == c("focus_path"), F.lit(False))
    ranked = ranked.select("qid", "id", "path", "start", "end", F.when(same, c("score") * 1.5).otherwise(c("score")).alias("score"), F.when(same, F.concat("labels", F.lit(",same-file"))).otherwise(c("labels")).alias("labels"))
    fixed = pins.join(place, "id").select("qid", "id", "path", "start", "end", (F.lit(10.0) - c("place")).alias("score"), F.lit("focus").alias("labels"))
    count = pins.groupBy("qid").agg(F.count("*").cast("int").alias("pins"))
    kept = deduplicate(ranked.unionByName(fixed).join(count, "qid", "left"), limit=F.lit(limit) + F.coalesce(F.first("pins"), F.lit(0)), keep=("id", "labels"), pin="focus")
    return kept.select("qid", "place", "id", F.when(c("labels") == "focus", 1.0).otherwise(F.round("score", 5)).alias("score"), c("labels").alias("matched_by"))


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """(qid, id, score, labels) from ranked lists (qid, id, rank, label, weight): weight / (k + rank) adds up."""
    return lists.groupBy("qid", "id").agg(F.sum(c("weight") / (k + c("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def deduplicate(hits: DataFrame, share: float = 0.6, limit: int | Column = 12, keep: tuple[str, ...] = (), pin: str | None = None) -> DataFrame:
    """Greedy choice by score of (qid, path, start, end, score, *keep): a hit that overlaps a chosen one of its path by over `share` of
    the shorter span goes, unless its labels are `pin`. A question has at most a few hundred hits, so one fold per question is bounded."""
    item = F.struct((-c("score")).alias("k"), *keep, "path", "start", "end") if keep else F.struct((-c("score")).alias("k"), "path", "start", "end")
    most = limit if isinstance(limit, Column) else F.lit(limit)
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("h"), *([most.alias("most")] if isinstance(limit, Column) else []))
    if not isinstance(limit, Column):
        rows = rows.withColumn("most", most)
    zero = F.array().cast(rows.schema["h"].dataType)

    def step(acc, x):
        def clash(y):
            both = F.least(y["end"], x["end"]) - F.greatest(y["start"], x["start"]) + 1
            return (y["path"] == x["path"]) & (both > share * F.least(y["end"] - y["start"] + 1, x["end"] - x["start"] + 1))

        gone = F.exists(acc, clash) if pin is None else (x["labels"] != pin) & F.exists(acc, clash)
        return F.when((F.size(acc) >= c("most")) | gone, acc).otherwise(F.concat(acc, F.array(x)))

    out = rows.select("qid", F.posexplode(F.aggregate("h", zero, step)).alias("place", "x"))
    return out.select("qid", "place", "x.path", "x.start", "x.end", *[f"x.{k}" for k in keep], *([(-c("x.k")).alias("score")] if keep else []))


_TERMS_SQL = terms_sql("item_id", "benchmark", "text")
_POST = f"""post AS (SELECT doc_id AS id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2), {_TERMS_SQL},
v AS (SELECT DISTINCT term FROM post), m AS (SELECT DISTINCT qid, root, v.term FROM q JOIN v ON left(v.term, 4) = left(q.root, 4) WHERE v.term = q.root OR (q.is_prefix AND starts_with(v.term, q.root))),
d AS (SELECT root, count(DISTINCT id) AS df FROM (SELECT DISTINCT root, term FROM m) JOIN post USING (term) GROUP BY 1), r AS (SELECT qid, root, coalesce(df, 0) <= 0.25 * (SELECT count(*) FROM documents) AS rare FROM q LEFT JOIN d USING (root)),
l AS (SELECT qid, count(*) FILTER (WHERE rare) AS n FROM r GROUP BY 1), kept AS (SELECT qid, root FROM r JOIN l USING (qid) WHERE rare OR n < 2),
key AS (SELECT qid, id, sum(n) AS score, row_number() OVER (PARTITION BY qid ORDER BY sum(n) DESC, id) AS rank FROM (SELECT DISTINCT qid, m.term FROM m SEMI JOIN kept ON kept.qid = m.qid AND kept.root = m.root) JOIN post USING (term) GROUP BY 1, 2)"""


def _questions(t):
    return t.benchmark.select(c("item_id").alias("qid"), c("text").alias("question"))


_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DIST = "1 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))"


@query("r02_vector_knn", f"SELECT e.vec_id, row_number() OVER (ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, {_Q0} WHERE e.vec_id > 0 ORDER BY rank LIMIT 50")
def r02(t):
    q = t.embeddings.filter("vec_id = 0").select("embedding").first()[0]
    top = nearest(t.embeddings.filter("vec_id > 0"), q, 50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "vec_id"))).select("vec_id", "rank")  # 50 rows


@query("r02_vector_knn_all", f"SELECT qid, vec_id, rank FROM (SELECT qid, e.vec_id, row_number() OVER (PARTITION BY qid ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0) WHERE e.vec_id <> qid) WHERE rank <= 50")
def r02_all(t):
    """All rows whose id is divisible by 50 as questions; r02_vector_knn has the first of them alone."""
    q = t.embeddings.filter("vec_id % 50 = 0").select(c("vec_id").alias("qid"), c("embedding").alias("q"))
    return nearest_each(q, t.embeddings, 50).select("qid", "vec_id", "rank")


@query("r04_common_term_pruning", f"WITH {_POST} SELECT qid, root FROM kept")
def r04(t):
    terms = question_terms(_questions(t))
    return selective(terms, *postings(t.documents, "doc_id", c("text"), terms), t.documents)


@query("r03_lexical_search", f"WITH {_POST} SELECT qid, id, score, rank FROM key WHERE rank <= 20")
def r03(t):
    r = keyword_hits(_questions(t), t.documents, "doc_id", c("text"), 20)
    return r.select("qid", "id", c("score").cast("decimal(38,0)").alias("score"), c("rank").cast("long").alias("rank"))


_NEAR = f"near AS (SELECT qid, id, rank FROM (SELECT qid, e.vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings SEMI JOIN benchmark ON item_id = vec_id)) WHERE rank <= 50)"


def _vectors(t):
    return t.embeddings.join(t.benchmark.select(c("item_id").alias("vec_id")), "vec_id", "left_semi").select(c("vec_id").alias("qid"), c("embedding").alias("vector"))


@query("r06_rank_fusion", f"""WITH {_POST}, {_NEAR}, u AS (SELECT qid, id, rank, 'keyword' AS label FROM key WHERE rank <= 50 UNION ALL SELECT qid, id, rank, 'semantic' FROM near)
SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(label, ',' ORDER BY label) AS labels FROM u GROUP BY 1, 2""")
def r06(t):
    """The vector whose id is a question's stands for it; documents and vectors of one id are one chunk."""
    a = keyword_hits(_questions(t), t.documents, "doc_id", c("text"), 50).select("qid", "id", "rank", F.lit("keyword").alias("label"), F.lit(1.0).alias("weight"))
    b = nearest_each(_vectors(t).select("qid", c("vector").alias("q")), t.embeddings.select(c("vec_id").alias("id"), "embedding"), 50, "id", own=True)
    return fuse(a.unionByName(b.select("qid", "id", "rank", F.lit("semantic").alias("label"), F.lit(1.0).alias("weight")))).withColumn("score", F.round("score", 9))


_NAME = "regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*')"


@query("r01_hybrid_search", f"""WITH {_POST.replace("FROM benchmark)", "FROM asked)", 1).replace("post AS", f"asked AS (SELECT item_id, b.text || CASE WHEN item_id % 2 = 0 THEN coalesce(' pkg.' || regexp_extract(d.text, '[A-Za-z_][A-Za-z0-9_]*'), '') ELSE '' END AS text FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id), post AS", 1)}, {_NEAR.replace("FROM embeddings e,", "FROM (SELECT * FROM embeddings SEMI JOIN documents ON doc_id = vec_id) e,")},
ids AS (SELECT DISTINCT item_id AS qid, lower(x) AS name FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:(?:\\.|::)[A-Za-z_][A-Za-z0-9_]*)*')) AS x FROM benchmark) WHERE length(x) > 2 AND lower(x) NOT IN ({STOP_SQL})),
sym AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY whole DESC, id) AS rank FROM (SELECT qid, doc_id AS id, max(CASE WHEN name = 'pkg.' || s THEN 1 ELSE 0 END) AS whole FROM (SELECT doc_id, lower({_NAME}) AS s FROM documents) JOIN ids ON name = s OR name = 'pkg.' || s GROUP BY 1, 2)),
pin AS (SELECT item_id AS qid, doc_id AS id FROM benchmark JOIN documents ON doc_id = item_id WHERE item_id % 2 = 0),
u AS (SELECT qid, id, rank, 'keyword' AS label, 1.0::DOUBLE AS w FROM key WHERE rank <= 50 UNION ALL SELECT qid, id, rank, 'semantic', 1.0 FROM near UNION ALL SELECT qid, id, rank, 'symbol', 2.0 FROM sym WHERE rank <= 10),
f AS (SELECT qid, id, sum(w / (60 + rank)) AS score, string_agg(label, ',' ORDER BY label) AS labels FROM u GROUP BY 1, 2),
b AS (SELECT f.qid, f.id, CASE WHEN same THEN score * 1.5 ELSE score END AS score, CASE WHEN same THEN labels || ',same-file' ELSE labels END AS labels
 FROM (SELECT f.*, f.qid % 2 = 0 AND coalesce(d.source = p.source, false) AS same FROM f JOIN documents d ON d.doc_id = f.id LEFT JOIN documents p ON p.doc_id = f.qid) f ANTI JOIN pin ON pin.qid = f.qid AND pin.id = f.id),
o AS (SELECT qid, id, 1.0::DOUBLE AS score, 'focus' AS matched_by, 0 AS k FROM pin UNION ALL SELECT qid, id, round(score, 5), labels, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 12)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY k) - 1 AS INTEGER) AS place, id, score, matched_by FROM o""")
def r01(t):
    """Documents are chunks (one symbol each, all of a source in one file); questions with an even id have a selection."""
    name = F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0)
    d = t.documents.join(t.embeddings.select(c("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    chunks = d.select(c("doc_id").alias("id"), F.lit("code").alias("source_type"), c("source").alias("path"), F.concat(F.lit("pkg."), name).alias("symbol_name"), (c("doc_id") * 100).alias("start_line"), (c("doc_id") * 100 + 50).alias("end_line"), c("text").alias("content"), "embedding")
    even = c("qid") % 2 == 0
    q = _questions(t).join(_vectors(t), "qid", "left").join(t.documents.select(c("doc_id").alias("qid"), "source"), "qid", "left")
    q = q.select("qid", "question", "vector", F.when(even, c("source")).alias("focus_path"), F.when(even, c("qid") * 100).alias("focus_start"), F.when(even, c("qid") * 100 + 10).alias("focus_end"))
    return hybrid_search(q, chunks)


@query("r16_link_expansion", """WITH hit AS (SELECT o_orderkey, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20), l AS (SELECT o_orderkey, l_partkey, score, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM hit JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') SELECT o_orderkey, l_partkey, score, rn FROM l WHERE rn <= 4""")
def r16(t):
    hit = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", c("o_totalprice").alias("score"))
    link = t.lineitem.filter("l_returnflag = 'R'").join(F.broadcast(hit), c("l_orderkey") == c("o_orderkey"))  # 20 rows
    w = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return link.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("o_orderkey", "l_partkey", "score", "rn")


@query("r14_overlap_dedup")
def r14(t):
    h = t.orders.select(c("o_custkey").alias("qid"), c("o_orderpriority").alias("path"), (c("o_orderkey") % 200).alias("start"), (c("o_orderkey") % 200 + 10 + c("o_orderkey") % 23).alias("end"), c("o_totalprice").alias("score"))
    return deduplicate(h)
