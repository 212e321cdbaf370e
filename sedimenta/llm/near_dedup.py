"""Near-duplicate documents: fast similarity sketching, banding, exact verification, connected components.

Sketch (COORDS coordinates): in round i each shingle is hashed anew to a bin and a value; a bin keeps the least
value of the earliest round that reached it. In the first COORDS rounds the bin is random, in the next COORDS
rounds round i fills bin i - COORDS from all shingles, so every coordinate is filled; a document stops as soon as it
has no empty bin. The share of equal coordinates estimates the Jaccard similarity with MinHash's concentration.

Texts with equal shingle sets form a class first, so thousands of copies cost one row from then on. Bands of
ROWS coordinates put classes in buckets. A bucket of up to SMALL classes compares them pairwise; a larger one goes by
pivots: each class is compared with one class of the bucket, then those outside the main component with a class
of it, and what is still outside with all others, in blocks. So a pair of a bucket is left out only where both
are known to be in one component, and no group emits all its pairs. Links are confirmed on whole shingle sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bytetext import SPACES, U, Words, chunks, column, gram_hash, mix
from sedimenta.llm.common import Steps, hot_keys, keyed, mapped, spread_join, stored, table, text_of

COORDS, ROWS = 256, 8
#: Threshold of the pipeline's stage in hundredths, and its coordinates of a band.
STAGE_NUM, STAGE_ROWS = 80, 6
SHINGLE = 5
#: Largest bucket whose classes are compared pairwise.
SMALL = 8
#: Rounds of pivots in larger buckets, and sizes of the blocks in the comparison of what is left.
PIVOTS, MEMBERS, STRAYS = 1, 64, 256
#: Bytes of shingle sets that a block has on average at most, and tasks over which the blocks of one bucket are dealt.
BLOCK_BYTES, DEAL = 8 << 20, 16
#: Pairs that one copy of a sketch or shingle set serves.
PER_COPY = 256


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text of a chunk, in that order."""
    w = Words(data, offs, SPACES)
    n = np.diff(w.of)
    k = max(0, len(w.doc) - size + 1)
    h = gram_hash(w.hash, k, size)
    full = w.doc[:k] == w.doc[size - 1 : size - 1 + k]
    doc, h = w.doc[:k][full], h[full]
    for m in range(1, size):  # shorter texts: the whole sequence
        d = np.flatnonzero(n == m)
        if len(d):
            v = np.full(len(d), U(m), dtype=U)
            for j in range(m):
                v = mix(v * U(0x9E3779B97F4A7C15) + w.hash[w.of[d] + j])
            doc, h = np.append(doc, d), np.append(h, v)
    o = np.lexsort((h, doc))
    doc, h = doc[o], h[o]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def sketch(doc: np.ndarray, h: np.ndarray, n: int, t: int = COORDS) -> np.ndarray:
    """n x t sketches of texts 0 .. n - 1 from their distinct shingle hashes; texts without any stay at the maximum."""
    s = np.full(n * t, np.iinfo(np.uint64).max, dtype=U)
    bits = U(64 - int(t).bit_length() + 1)
    has = np.zeros(n, bool)
    has[doc] = True
    for i in range(2 * t):
        if not len(doc):
            break
        x = mix(h + U((i * 0xA0761D6478BD642F + 0x1D8E4E27C47D124F) & ((1 << 64) - 1)))
        b = (x >> bits).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(s, doc * t + b, (U(i) << U(54)) | (x & U((1 << 54) - 1)))
        if i < 8 or i % 8 == 7:
            open_ = (s.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
            go = open_[doc]
            doc, h = doc[go], h[go]
    return s.reshape(n, t)


def _class(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x 2 fingerprints of whole sets, whatever their order."""
    out = np.zeros((n, 2), U)
    np.add.at(out[:, 0], doc, mix(h))
    np.add.at(out[:, 1], doc, mix(h ^ U(0x5851F42D4C957F2D)))
    return out


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row of x as bytes."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _signatures(rows: int, t: int):
    def run(batches):
        for batch in batches:
            data, offs = column(batch, "text")
            for x, y, d, o in chunks(data, offs):
                n = y - x
                doc, h = shingles(d, o)
                count = np.bincount(doc, minlength=n)
                s = sketch(doc, h, n, t)
                bands = np.zeros((n, t // rows), U)
                for k in range(t // rows):
                    v = np.full(n, U(k + 1))
                    for j in range(rows):
                        v = mix(v * U(0x9E3779B97F4A7C15) + s[:, k * rows + j])
                    bands[:, k] = v
                cls = pa.array([c.tobytes() if k else None for c, k in zip(_class(doc, h, n), count, strict=True)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(x, n), pa.array(count.astype(np.int64)), cls, lists, _bytes(s.astype(np.uint8))], ["id", "n", "cls", "bands", "low"])

    return run


def _sets(batches):
    """(cls, set): sorted shingle hashes of texts, as bytes."""
    for batch in batches:
        data, offs = column(batch, "text")
        for x, y, d, o in chunks(data, offs):
            doc, h = shingles(d, o)
            at = np.searchsorted(doc, np.arange(y - x + 1)) * 8
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([_bytes(_class(doc, h, y - x)), pa.array([raw[at[i] : at[i + 1]] for i in range(y - x)], pa.binary())], ["cls", "set"])


def _confirm(num: int, den: int):
    """Keeps pairs whose sets a and b have den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U), num, den) for a, b in zip(batch.column("va"), batch.column("vb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _side_by_side(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, va, vb) of pairs (a, b), from values (cls, v). The value of a b that many pairs need is copied once for
    each PER_COPY of them, so the pairs of one b never meet in one task."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies"))
    copies = many.join(values.select(F.col("cls").alias("b"), F.col("v").alias("vb")), "b").select("b", "vb", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"))
    half = dealt.join(values.select(F.col("cls").alias("a"), F.col("v").alias("va")), "a")
    return half.join(copies, ["b", "copy"]).select("a", "b", "va", "vb")


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """(v, root): the least vertex that each vertex of the links (a, b) reaches, by alternating large-star and
    small-star steps; each is one pre-aggregated minimum and one join, whose stars' centres are dealt out, kept in the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = steps.keep(near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).select("a", F.least("a", "m").alias("m"), "c"), "least")
        joined = spread_join(near, least.drop("c"), ["a"], "a", hot_keys(least, "a", "c"), ["b"])
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    edges, k = steps.keep(links.select("a", "b").filter("a <> b").distinct(), "edges"), 0
    while True:
        large, k = steps.keep(star(edges, True), "large"), k + 1
        edges = steps.keep(star(large, False), f"edges{k}")
        steps.drop("least", "large", f"edges{k - 1 or ''}")
        # done when all are stars: no vertex has two parents, and no parent has one
        twice = edges.groupBy("a").count().filter("count > 1").select("a")
        chained = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
        if not twice.unionByName(chained).limit(1).count():
            break
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def _near(least: int):
    """Pairs whose sketches agree in at least that many coordinates (lowest bytes; equal coordinates always agree)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("va", "vb"))
                ok = pa.array((a == b).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(ok)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, coords: int = COORDS, rows: int = ROWS) -> DataFrame:
    """Groups texts whose sets of 5-word shingles have den * |intersection| >= num * |union|, directly or by a chain.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Returns a row for each row: id_col, n_shingles,
    component_id (smallest id of the group), kept (the row's id is component_id). A text of under 5 words has one
    shingle, all of it; null texts and texts without words have none and are linked with nothing. Rows that repeat an id
    are documents of their own; if such an id leads its group, all its rows are kept. A null id takes part in links but is never a
    component_id unless the group has no other id; such rows have a null component_id and are kept.
    Other columns aren't read. An empty table gives an empty result.

    Misses: a pair at the threshold s shares no band with probability (1 - s**rows)**(coords / rows), 4e-5 at 0.85, and its sketches
    agree in fewer coordinates than four standard deviations below s with probability 4e-5 at most; either loses that link.
    All that a link needs is compared; classes that share a large bucket without being links of its main component are compared
    with all of it, which is quadratic in their number.
    """
    steps = Steps(docs.sparkSession, "near")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    sig = steps.keep(mapped(src, _signatures(rows, coords), f"id {kind}, n long, cls binary, bands array<long>, low binary"), "signatures")
    full = sig.filter("cls is not null")
    first = [F.first(c).alias(c) for c in ("n", "bands", "low")]
    classes = steps.keep(full.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *first), "classes")
    spread = classes.select("cls", "n", F.explode("bands").alias("band"))
    pivot = F.max(F.struct(F.xxhash64("band", "cls").alias("h"), "cls"))
    size = spread.groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("total"), pivot.alias("p")).filter("c > 1")
    size = steps.keep(size.select("band", "c", "total", F.col("p.cls").alias("pivot")), "buckets")
    members = steps.keep(spread_join(spread.drop("n"), size, ["band"], "band", hot_keys(size, "band", "c"), ["cls"]), "members")
    small = members.filter(F.col("c") <= SMALL)
    pairs = small.groupBy("band").agg(F.sort_array(F.collect_list("cls")).alias("m"))
    pairs = pairs.select(F.posexplode("m").alias("i", "b"), "m").select(F.explode(F.expr("slice(m, i + 2, size(m))")).alias("a"), "b")
    low = classes.select("cls", "low")

    least = int(coords * (num / den - 4 * (num / den * (1 - num / den) / coords) ** 0.5))

    def compare(pairs: DataFrame) -> DataFrame:
        """Sketches first (four standard deviations below the threshold), then whole sets."""
        p = _side_by_side(pairs.distinct(), low.withColumnRenamed("low", "v"))
        return confirm(steps.keep(mapped(p, _near(least), "a binary, b binary"), "near"))

    def sets_of(need: DataFrame) -> DataFrame:
        """(cls, v): whole shingle sets of the classes in need, from the text of one document of each."""
        reps = need.join(classes.select("cls", "rep"), "cls").select("rep")
        text = src.join(reps, src.id.eqNullSafe(reps.rep), "left_semi")
        return steps.keep(mapped(text.select("text"), _sets, "cls binary, v binary").dropDuplicates(["cls"]), "sets")

    def confirm(p: DataFrame) -> DataFrame:
        sets = sets_of(p.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        return steps.keep(mapped(_side_by_side(p, sets), _confirm(num, den), "a binary, b binary"), "links")

    found = [compare(pairs)]
    large = members.filter(F.col("c") > SMALL)
    if large.limit(1).count():
        found += _large_buckets(large, classes, compare, sets_of, least, num, den, found, steps)
    steps.drop("sets", "near")
    roots = components(reduce(DataFrame.unionByName, found), steps)
    top = steps.keep(classes.select("cls", "rep").join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")), "top")
    lead = steps.keep(top.groupBy("root").agg(F.min("rep").alias("lead"), F.count("*").alias("c")), "lead")
    named = spread_join(top, lead.drop("c"), ["root"], "root", hot_keys(lead, "root", "c"), ["cls"]).select("cls", "lead")
    named = spread_join(full.select("id", "n", "cls"), named, ["cls"], "cls", hot_keys(classes, "cls", "copies"), ["id"])
    out = named.unionByName(sig.filter("cls is null").select("cls", "id", "n", F.col("id").alias("lead")))
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("lead").alias("component_id"), F.col("id").eqNullSafe(F.col("lead")).alias("kept")), "near")
    steps.drop()
    return out


def _blocks(least: int, num: int, den: int):
    """Links between a block of stragglers and a block of members, one for each straggler and component. A pair is
    looked at in the first band that both share, sketches first, then whole sets."""

    def run(batches):
        for batch in batches:
            links = []
            for band, s, m in zip(*(batch.column(c).to_pylist() for c in ("k", "s", "m")), strict=True):
                (la, ba), (lb, bb) = ((np.frombuffer(b"".join(x["low"] for x in v), np.uint8).reshape(len(v), -1), np.array([x["bands"] for x in v])) for v in (s, m))
                for i, x in enumerate(s):
                    near = (lb == la[i]).sum(axis=1) >= least
                    done = {x["root"]}
                    for j in np.flatnonzero(near & ((bb == ba[i]).argmax(axis=1) == band)):
                        if m[j]["root"] not in done and _linked(np.frombuffer(x["v"], U), np.frombuffer(m[j]["v"], U), num, den):
                            links.append((x["cls"], m[j]["cls"]))
                            done.add(m[j]["root"])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have den * intersection >= num * union."""
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _large_buckets(large: DataFrame, signs: DataFrame, compare, sets_of, least: int, num: int, den: int, found: list[DataFrame], steps: Steps) -> list[DataFrame]:
    """Links of large buckets. PIVOTS rounds compare each class outside its bucket's main component with one pivot of it (at
    first with any pivot). Then the stragglers, classes that are still outside, are compared with all classes of the
    bucket that aren't in their component, in blocks whose number follows the bucket's members and bytes; the blocks of one
    bucket are dealt over DEAL tasks."""
    out: list[DataFrame] = []
    at = large.select("band", "cls", "pivot", F.col("cls").alias("root"), F.col("pivot").alias("main"))
    for k in range(PIVOTS + 1):
        if k:
            roots = components(reduce(DataFrame.unionByName, [*found, *out]), steps)
            at = steps.keep(large.select("band", "cls", "c", "total").join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("band", "cls", "c", "total", F.coalesce("root", "cls").alias("root")), "at")
            sizes = at.groupBy("band", "root").agg(F.count("*").alias("n"), F.max(F.struct(F.xxhash64(F.lit(k), "band", "cls").alias("h"), F.col("cls").alias("pivot"))).alias("p"))
            main = sizes.groupBy("band").agg(F.max(F.struct("n", "root", "p.pivot")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts"))
            main = steps.keep(main.filter("parts > 1").select("band", F.col("m.root").alias("main"), F.col("m.pivot").alias("pivot"), "n"), "main")
            at = steps.keep(spread_join(at, main.drop("n"), ["band"], "band", hot_keys(main, "band", "n"), ["cls"]), "open")
        if k < PIVOTS:
            out.append(compare(at.filter("root <> main and cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))))
    full = at.join(signs.select("cls", "bands", "low"), "cls").join(sets_of(at.select("cls").distinct()), "cls")
    count = lambda size: F.ceil(F.greatest(F.col("c") / size, F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    block = lambda size: F.pmod(F.xxhash64("cls"), count(size)).cast("int").alias("block")
    item = F.collect_list(F.struct("cls", "root", "bands", "low", "v"))
    members = full.groupBy("band", block(MEMBERS)).agg(item.alias("m"), F.min(F.array_position("bands", F.col("band")) - 1).alias("k"))
    members = members.withColumn("part", F.pmod("block", F.lit(DEAL)))
    strays = full.filter("root <> main").groupBy("band", block(STRAYS)).agg(item.alias("s"), F.max(F.least(count(MEMBERS), F.lit(DEAL))).alias("parts"))
    strays = strays.select("band", "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = members.join(strays, ["band", "part"]).select(F.col("k").cast("int").alias("k"), "s", "m")
    out.append(steps.keep(mapped(both, _blocks(least, num, den), "a binary, b binary", 1), "links"))
    return out


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole documents, 5-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), num=85)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, the first by doc_id (null first), then text; groups are linked at similarity
    0.8, where a pair shares no band of STAGE_ROWS with probability 3e-6. Rows are chosen one by one, whatever their ids."""
    rows = keyed(docs, "doc_id", "text", carry=True)
    kept = near_duplicates(rows, "key", num=STAGE_NUM, rows=STAGE_ROWS).filter("kept").select("key")
    own = {"doc_id": F.col("id"), "text": F.col("text")}
    return rows.join(kept, "key", "left_semi").select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


#: Sets of word strings, compared in all pairs that share one; components by a recursive closure.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
c AS (SELECT r AS v, r AS root FROM d UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.v),
m AS (SELECT v, min(root) AS root FROM c GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, e.doc_id AS component_id, d.doc_id IS NOT DISTINCT FROM e.doc_id AS kept
FROM d JOIN m ON m.v = d.r JOIN d e ON e.r = m.root LEFT JOIN n ON n.r = d.r
"""
