"""Near-duplicate vectors by collision-counting projections.

Equal vectors form a class first. A class's unit vector is projected on many random lines. The signs on `bits` lines make a cell of
a table; TABLES such tables, as many as the threshold needs, bring near classes together. Within a cell the classes are sorted by one more
line, and each looks at the window of that line in which near ones lie; on COUNTED further lines it counts how often the other
falls in the window centred on it. Pairs whose count reaches a bound that a pair at the threshold reaches almost surely are
compared by their cosine in double precision. The probabilities are those of Gaussian lines, whatever the data.

Cells with more than HOT classes don't hand out pairs. Their classes first join balls: all whose angle to a pivot is at most half the
threshold's, so that all in a ball are linked, and counted, without being compared. The others are compared in blocks, which
hand out sums of links and a star for each connected part of a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sedimenta.llm.common import Steps, hot_keys, mapped, spread_join, stored, table
from sedimenta.llm.near_dedup import _side_by_side, components

#: Chance that a pair at the threshold shares no cell, and that it shares one but fails the count.
MISS_CELLS, MISS_COUNT = 1e-3, 1e-4
#: Classes that a cell has on average, and above which it is compared in blocks; classes and bytes of vectors of a block.
CELL, HOT, BLOCK, BLOCK_BYTES = 128, 512, 1024, 16 << 20
#: Lines on which collisions are counted, half the width of their windows, and steps of a projection of standard deviation 1.
COUNTED, WINDOW, STEPS = 32, 0.75, 15
_CODE = 44  # bits of a cell's number below the table's


class Plan:
    """What a threshold and a number of classes ask for: bits, tables, and the least count."""

    def __init__(self, cosine: float, classes: int):
        angle = math.acos(cosine)
        self.cosine, self.half = cosine, math.cos(angle / 2)
        self.bits = min(_CODE, max(2, math.ceil(math.log2(max(classes, 1) / CELL)) if classes > CELL else 2))
        self.tables = math.ceil(math.log(MISS_CELLS) / math.log1p(-((1 - angle / math.pi) ** self.bits)))
        self.apart = math.sqrt(2 - 2 * cosine)  # distance of two unit vectors at the threshold
        p = math.erf(WINDOW / self.apart / math.sqrt(2))
        chance, self.least = 0.0, 0
        while True:  # the greatest count that a pair at the threshold fails with MISS_COUNT at most
            chance += math.comb(COUNTED, self.least) * p**self.least * (1 - p) ** (COUNTED - self.least)
            if chance > MISS_COUNT:
                break
            self.least += 1
        self.width = math.ceil(WINDOW * STEPS) + 1  # rounding moves each end by half a step
        self.reach = math.ceil(4 * self.apart * STEPS) + 1  # of the line that cells are sorted by


_lines: dict[tuple, np.ndarray] = {}


def lines(dim: int, many: int) -> np.ndarray:
    """dim x many Gaussian coordinates, the same on every worker."""
    if (dim, many) not in _lines:
        _lines.clear()
        _lines[dim, many] = np.random.default_rng((20_240_617, dim)).standard_normal((many, dim)).T.copy()
    return _lines[dim, many]


def units(raw: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(kind: str):
    """(id, vec): a vector's bytes; null if the vector is null or empty, zero, or holds null or a number that isn't finite."""

    def run(batches):
        for batch in batches:
            arr = batch.column("v")
            flat = arr.flatten()
            of = np.append(0, np.cumsum([0 if x is None else x for x in pa.compute.list_value_length(arr).to_pylist()])).astype(np.int64)
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0.0 becomes 0.0
            bad = np.append(0, np.cumsum(~np.isfinite(x)))
            some = np.append(0, np.cumsum(x != 0))
            ok = (bad[of[1:]] == bad[of[:-1]]) & (some[of[1:]] > some[of[:-1]])
            out = [x[of[i] : of[i + 1]].tobytes() if ok[i] else None for i in range(len(arr))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vec"])

    return run


def _sketches(plan: Plan, kind: str):
    """(key, dim, signs, sketch, cells) of classes: packed signs of all tables, and places on the counted lines in steps."""
    cut = plan.tables * plan.bits

    def run(batches):
        for batch in batches:
            raw, keys = batch.column("vec").to_pylist(), batch.column("key").to_pylist()
            for dim in sorted({len(r) for r in raw}):
                own = [i for i, r in enumerate(raw) if len(r) == dim]
                u = units([raw[i] for i in own], kind)
                x = u @ lines(u.shape[1], cut + COUNTED + 1)
                signs = x[:, :cut] > 0
                code = signs.reshape(len(own), plan.tables, plan.bits) @ (np.int64(1) << np.arange(plan.bits, dtype=np.int64))
                cells = code + (np.arange(plan.tables, dtype=np.int64) << _CODE)
                places = np.clip(np.rint(x[:, cut:] * STEPS), -60, 60).astype(np.int8)
                of = pa.array(np.arange(len(own) + 1, dtype=np.int32) * plan.tables)
                binary = lambda m: pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.binary()), pa.array(np.full(len(own), u.shape[1], np.int32)), binary(np.packbits(signs, axis=1)), binary(places), pa.ListArray.from_arrays(of, pa.array(cells.ravel()))], ["key", "dim", "signs", "sketch", "cells"])

    return run


def colliding(a: np.ndarray, b: np.ndarray, plan: Plan, part: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that collide on plan.least counted lines at least. Rows of b are sorted by the last line; each part of a
    takes the run of them that its windows on that line cover."""
    by_a, by_b = np.argsort(a[:, -1], kind="stable"), np.argsort(b[:, -1], kind="stable")
    on = b[by_b, -1].astype(np.int64)
    rows, cols = [], []
    for x in range(0, len(a), part):
        own = by_a[x : x + part]
        edge = a[own, -1].astype(np.int64)
        lo, hi = np.searchsorted(on, edge[0] - plan.reach), np.searchsorted(on, edge[-1] + plan.reach, side="right")
        far = by_b[lo:hi]
        count = np.zeros((len(own), len(far)), np.uint8)
        for k in range(COUNTED):
            count += np.abs(a[own, k][:, None] - b[far, k][None, :]) <= plan.width
        i, j = np.nonzero(count >= plan.least)
        rows.append(own[i]), cols.append(far[j])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _places(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["sketch"] for r in rows), np.int8).reshape(len(rows), -1)


def _first(rows: list[dict], plan: Plan) -> np.ndarray:
    """Signs by table, for the first table in which two classes share a cell: only there their pair counts."""
    raw = np.frombuffer(b"".join(r["signs"] for r in rows), np.uint8).reshape(len(rows), -1)
    return np.unpackbits(raw, axis=1, count=plan.tables * plan.bits).reshape(len(rows), plan.tables, plan.bits)


def _own(i, j, sa, sb, ba, bb, at: int) -> np.ndarray:
    """Which pairs count in table `at`: they share no earlier cell and no ball."""
    return ((sa[i] == sb[j]).all(axis=2).argmax(axis=1) == at) & ((ba[i] != bb[j]) | (ba[i] < 0))


def _balls(rows: list[dict], names: dict) -> np.ndarray:
    return np.array([-1 if r["ball"] is None else names.setdefault(r["ball"], len(names)) for r in rows])


def _pairs(plan: Plan):
    """Candidate pairs (a, b) of cells."""

    def run(batches):
        for batch in batches:
            out = []
            for cell, rows in zip(batch.column("cell").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                p, s, g = _places(rows), _first(rows, plan), _balls(rows, {})
                i, j = colliding(p, p, plan)
                i, j = i[i < j], j[i < j]
                good = _own(i, j, s, s, g, g, cell >> _CODE)
                out += [(rows[x]["key"], rows[y]["key"]) for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _cosines(least: float, kind: str):
    """Keeps pairs (a, b) whose vectors va and vb have that cosine at least."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).to_pylist() for c in ("va", "vb"))
                keep = np.zeros(len(a), bool)
                for dim in {len(x) for x in a}:
                    own = [k for k, x in enumerate(a) if len(x) == dim == len(b[k])]
                    if own:
                        keep[own] = (units([a[k] for k in own], kind) * units([b[k] for k in own], kind)).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def copies_of(key: bytes) -> int:
    return int.from_bytes(key[16:24], "big")


def _blocks(plan: Plan, kind: str):
    """For two blocks of a hot cell: (a, b, n) with class a's links to rows of the other (n) and a class b of its connected part."""

    def run(batches):
        for batch in batches:
            out = []
            for cell, lo, hi, rows in zip(*(batch.column(c).to_pylist() for c in ("cell", "lo", "hi", "rows")), strict=True):
                x, y = [r for r in rows if r["block"] == lo], [r for r in rows if r["block"] == hi]
                if not x or not y:
                    continue
                names: dict = {}
                i, j = colliding(_places(x), _places(y), plan)
                if lo == hi:
                    i, j = i[i < j], j[i < j]
                good = _own(i, j, _first(x, plan), _first(y, plan), _balls(x, names), _balls(y, names), cell >> _CODE)
                i, j = i[good], j[good]
                ux, uy = units([r["vec"] for r in x], kind), units([r["vec"] for r in y], kind)
                near = np.concatenate([np.zeros(0, bool), *((ux[i[k : k + 65536]] * uy[j[k : k + 65536]]).sum(axis=1) >= plan.cosine for k in range(0, len(i), 65536))])
                i, j = i[near], j[near] + (0 if lo == hi else len(x))
                both = x if lo == hi else x + y
                weight = np.array([copies_of(r["key"]) for r in both], np.int64)
                n, part = np.zeros(len(both), np.int64), np.arange(len(both))
                np.add.at(n, i, weight[j]), np.add.at(n, j, weight[i])
                while True:
                    before = part.copy()
                    least = np.minimum(part[i], part[j])
                    np.minimum.at(part, i, least), np.minimum.at(part, j, least)
                    part = part[part]
                    if (part == before).all():
                        break
                out += [(both[k]["key"], both[part[k]]["key"], int(n[k])) for k in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())], ["a", "b", "n"])

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Links vectors whose cosine is `cosine` or more, and groups them.

    Returns a row for each row: id_col, n_links (other rows linked directly), component_id (least id of the group), kept (the id is
    component_id). Vectors that are null, empty, zero or hold null or a number that isn't finite link with nothing; vectors of
    different lengths aren't linked. Repeated rows and ids are rows of their own; a null id is no component_id unless the group
    has no other. Other columns aren't read. An empty table gives an empty result.

    Found links are exact. A link at the very threshold is missed with probability MISS_CELLS + MISS_COUNT, nearer ones far less
    often. The cells' bits grow with the logarithm of the number of classes, so that cells stay the same size.
    """
    spark = rows.sparkSession
    steps = Steps(spark, "vectors")
    deep = rows.schema[vec_col].dataType
    kind = "<f4" if isinstance(deep, ArrayType) and isinstance(deep.elementType, FloatType) else "<f8"
    src = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    flat = steps.keep(mapped(src, _packed(kind), f"id {src.schema['id'].dataType.simpleString()}, vec binary"), "flat")
    count = F.lpad(F.hex("copies"), 16, "0")
    classes = flat.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = steps.keep(classes.select("vec", "rep", "copies", F.concat(F.unhex(F.md5("vec")), F.unhex(count)).alias("key")), "classes")
    plan = Plan(cosine, classes.count())
    signs = steps.keep(mapped(classes.select("key", "vec"), _sketches(plan, kind), "key binary, dim int, signs binary, sketch binary, cells array<long>"), "sketches")
    spread = signs.select("dim", "key", F.explode("cells").alias("cell"))
    pivot = F.max(F.struct(F.xxhash64("key").alias("h"), "key")).alias("p")
    cells = spread.groupBy("dim", "cell").agg(F.count("*").alias("c"), pivot).filter("c > 1")
    cells = steps.keep(cells.select("dim", "cell", "c", F.col("p.key").alias("pivot")), "cells")
    large = cells.filter(F.col("c") > hot)
    any_hot = large.limit(1).count() > 0
    vecs = classes.select(F.col("key").alias("cls"), F.col("vec").alias("v"))
    hot_cells = hot_keys(large, "cell", "c") if any_hot else []
    parts, balls = [], None
    if any_hot:
        ask = spread_join(spread, large.drop("c"), ["dim", "cell"], "cell", hot_cells, ["key"]).select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
        inside = mapped(_side_by_side(steps.keep(ask, "asked"), vecs), _cosines(plan.half + 1e-9, kind), "a binary, b binary")
        chosen = inside.groupBy("a").agg(F.max(F.struct(F.xxhash64("b").alias("h"), "b")).alias("p")).select(F.col("a").alias("key"), F.col("p.b").alias("ball"))
        chosen = steps.keep(chosen, "chosen")
        copies = F.conv(F.hex(F.substring("key", 17, 8)), 16, 10).cast("long")
        full = steps.keep(chosen.groupBy("ball").agg(F.count("*").alias("members"), F.sum(copies).alias("all"), F.min("key").alias("head")).filter("members > 1"), "full")
        balls = steps.keep(spread_join(chosen, full, ["ball"], "ball", hot_keys(full, "ball", "members"), ["key"]), "balls")
        signs = signs.join(balls.select("key", "ball"), "key", "left")
    else:
        signs = signs.withColumn("ball", F.lit(None).cast("binary"))
    item = signs.select("dim", "key", "signs", "sketch", "ball", F.explode("cells").alias("cell"))
    small = item.join(cells.filter(F.col("c") <= hot).select("dim", "cell"), ["dim", "cell"]).groupBy("dim", "cell").agg(F.collect_list(F.struct("key", "signs", "sketch", "ball")).alias("rows"))
    found = steps.keep(mapped(small, _pairs(plan), "a binary, b binary", 32), "found")
    links = steps.keep(mapped(_side_by_side(found, vecs), _cosines(cosine, kind), "a binary, b binary"), "links")
    copies_b = F.conv(F.hex(F.substring("b", 17, 8)), 16, 10).cast("long")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parts.append(both.select(F.col("a").alias("key"), copies_b.alias("n")))
    edges = links
    if any_hot:
        sums = steps.keep(mapped(_tiles(item, large, hot_cells, vecs, kind, block, steps), _blocks(plan, kind), "a binary, b binary, n long", 1), "sums")
        parts.append(sums.select(F.col("a").alias("key"), "n"))
        parts.append(balls.select("key", (F.col("all") - F.conv(F.hex(F.substring("key", 17, 8)), 16, 10).cast("long")).alias("n")))
        edges = edges.unionByName(sums.select("a", "b")).unionByName(balls.select(F.col("key").alias("a"), F.col("head").alias("b")))
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionByName(p)
    counted = counted.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(edges, steps)
    top = classes.select("key", "vec", "rep", "copies").join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    top = steps.keep(top.join(counted, "key", "left").select("key", "vec", "rep", "copies", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "top")
    lead = steps.keep(top.groupBy("root").agg(F.min("rep").alias("lead"), F.count("*").alias("c")), "lead")
    named = steps.keep(spread_join(top.select("vec", "root", "n_links", "copies"), lead.drop("c"), ["root"], "root", hot_keys(lead, "root", "c"), ["vec"]).select("vec", "lead", "n_links", "copies"), "named")
    out = spread_join(flat.filter("vec is not null"), named.drop("copies"), ["vec"], "vec", hot_keys(named, "vec", "copies"), ["id"])
    out = out.select("id", "n_links", "lead").unionByName(flat.filter("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("lead")))
    out = stored(out.select(F.col("id").alias(id_col), "n_links", F.col("lead").alias("component_id"), F.col("id").eqNullSafe(F.col("lead")).alias("kept")), "vectors")
    steps.drop()
    return out


def _tiles(item: DataFrame, large: DataFrame, hot_cells: list, vecs: DataFrame, kind: str, block: int, steps: Steps) -> DataFrame:
    """(cell, lo, hi, rows): the blocks of hot cells by twos. A ball that fills half a block or more in a cell has blocks of its own, which
    aren't paired with each other; all other classes of the cell are dealt together."""
    own = spread_join(item, large.select("dim", "cell"), ["dim", "cell"], "cell", hot_cells, ["key"])
    sizes = own.groupBy("dim", "cell", "ball").agg(F.count("*").alias("n"))
    wide = F.lit(4 if kind == "<f4" else 8) * F.col("dim")
    per = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / wide)))
    big = F.when(F.col("n") * 2 >= per, F.col("ball"))
    groups = sizes.withColumn("grp", big).groupBy("dim", "cell", "grp").agg(F.sum("n").alias("n"))
    groups = groups.withColumn("nb", F.ceil(F.col("n") / per).cast("int"))
    w = Window.partitionBy("dim", "cell")
    groups = steps.keep(groups.select("dim", "cell", "grp", "nb", (F.sum("nb").over(w.orderBy(F.col("grp").asc_nulls_first())) - F.col("nb")).cast("int").alias("at"), F.sum("nb").over(w).cast("int").alias("total")), "groups")
    named = groups.filter("grp is not null").select("dim", "cell", F.col("grp").alias("ball"), F.lit(True).alias("named"))
    tagged = own.join(F.broadcast(named) if named.count() < 10_000 else named, ["dim", "cell", "ball"], "left").withColumn("grp", F.when(F.col("named"), F.col("ball")))
    tagged = tagged.withColumn("g", F.coalesce("grp", F.lit(b"")))
    placed = spread_join(tagged.drop("grp", "named"), groups.withColumn("g", F.coalesce("grp", F.lit(b""))), ["dim", "cell", "g"], "cell", hot_cells, ["key"])
    placed = placed.withColumn("block", F.col("at") + F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    placed = placed.filter(F.col("grp").isNull() | (F.col("other") < F.col("at")) | (F.col("other") >= F.col("at") + F.col("nb")))
    placed = placed.join(vecs.select(F.col("cls").alias("key"), F.col("v").alias("vec")), "key")
    return placed.groupBy("dim", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(F.struct("key", "signs", "sketch", "ball", "vec", "block")).alias("rows"))


def op13_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT r, vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
c AS (SELECT r AS v, r AS root FROM e UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.v),
m AS (SELECT v, min(root) AS root FROM c GROUP BY v),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, f.vec_id AS component_id, e.vec_id IS NOT DISTINCT FROM f.vec_id AS kept
FROM e JOIN m ON m.v = e.r JOIN e f ON f.r = m.root LEFT JOIN k ON k.x = e.r
"""
