"""Links of vectors against all cosines, with groups of copies, hot cells, and odd vectors."""

import math

import numpy as np
import pytest

from sedimenta.llm import vector_dedup as V

RNG = np.random.default_rng(3)


def turned(v: np.ndarray, cosine: float) -> np.ndarray:
    """A vector with that cosine to v."""
    x = RNG.standard_normal(len(v))
    x -= x @ v * v
    return cosine * v + math.sqrt(1 - cosine**2) * x / np.linalg.norm(x)


def unit(dim: int = 64) -> np.ndarray:
    v = RNG.standard_normal(dim)
    return v / np.linalg.norm(v)


def rows_of() -> list:
    """Plain vectors, pairs and chains near the threshold, a group of 400 near copies, one of 200 that balls can't hold, 150 equal ones."""
    out = [unit() for _ in range(500)]
    out += [turned(out[k], c) for k, c in enumerate(np.linspace(0.86, 0.94, 200))]
    base = unit()
    out += [turned(base, 0.99) for _ in range(400)]
    wide = unit()
    out += [turned(wide, 0.955) for _ in range(200)]
    out += [out[7]] * 150 + [3 * out[9], -out[11], out[7] * 2]
    out += [unit(16) for _ in range(20)]
    out.append(out[-1])
    return [[float(np.float32(x)) for x in v] for v in out]


def brute(rows: list, cosine: float) -> dict:
    """id -> (links, component) by all cosines."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, lead = {k: set() for k in range(len(rows))}, list(range(len(rows)))

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for dim in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == dim]
        m = np.array([rows[k][1] for k in own], float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        for i, j in np.argwhere(m @ m.T >= cosine):
            if i != j:
                links[own[i]].add(own[j])
                a, b = sorted((root(own[i]), root(own[j])))
                lead[b] = a
    return {rows[k][0]: (len(links[k]), rows[root(k)][0]) for k in range(len(rows))}


@pytest.mark.parametrize("hot, block", [(100_000, 1024), (40, 32)])
def test_against_all_cosines(spark, hot, block):
    rows = list(enumerate(rows_of()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = V.near_vectors(df, hot=hot, block=block).collect()
    want = brute(rows, 0.9)
    assert len(got) == len(rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in got), "a link below the threshold"
    found, all_links = sum(r.n_links for r in got), sum(n for n, _ in want.values())
    assert found >= 0.998 * all_links, (found, all_links)
    assert sum(r.component_id == want[r.vec_id][1] for r in got) >= 0.998 * len(rows)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1e300, 1e300], 0), (8, [2.0, 2.0], 0), (None, [1.0, 1.0], 0), (9, [1.0, 1.0], 0), (9, [1.0, 1.0], 0), (10, [1.0, 1.0, 1.0], 0), (11, [0.0, 1.0], 0), (12, [-0.0, 1.0], 0), (None, [5.0, -5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in V.near_vectors(df).collect()), key=str)
    want = [(0, 0, None), (0, 4, 7), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 4, 7), (8, 4, 7), (9, 4, 7), (9, 4, 7), (10, 0, 10), (11, 1, 11), (12, 1, 11)]
    assert got == sorted(want, key=str)
    assert V.near_vectors(df.limit(0)).collect() == []


def test_count_is_calibrated():
    """Pairs at the threshold share a cell and reach the count as often as the plan says."""
    plan = V.Plan(0.9, 50_000)
    a = np.array([unit() for _ in range(4000)])
    b = np.array([turned(v, 0.9) for v in a])
    cut = plan.tables * plan.bits
    x, y = (v @ V.lines(64, cut + V.COUNTED + 1) for v in (a, b))
    cell = ((x[:, :cut] > 0) == (y[:, :cut] > 0)).reshape(len(a), plan.tables, plan.bits).all(axis=2).any(axis=1)
    place = [np.clip(np.rint(v[:, cut:] * V.STEPS), -60, 60) for v in (x, y)]
    count = (np.abs(place[0] - place[1])[:, : V.COUNTED] <= plan.width).sum(axis=1)
    assert (~cell).mean() <= 5 * V.MISS_CELLS + 0.003
    assert (count < plan.least).mean() <= 0.003
    assert (np.abs(place[0] - place[1])[:, -1] <= plan.reach).mean() >= 0.998


def test_collisions_are_those_of_all_pairs():
    plan = V.Plan(0.9, 1000)
    a, b = (np.clip(np.rint(RNG.standard_normal((n, V.COUNTED + 1)) * 6), -60, 60).astype(np.int8) for n in (300, 170))
    i, j = V.colliding(a, b, plan, part=32)
    d = np.abs(a[:, None, :].astype(int) - b[None].astype(int))
    want = (d[:, :, : V.COUNTED] <= plan.width).sum(axis=2) >= plan.least
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    must = {(x, y) for x, y in np.argwhere(want & (d[:, :, -1] <= plan.reach)).tolist()}
    assert must <= got <= {(x, y) for x, y in np.argwhere(want).tolist()}
