"""Links against the matrix of all cosines."""

import math

import numpy as np
import pytest

from lotsift.llm import embedding_dedup as E


def exact(rows):
    """{id: (links, component)} of rows (id, vector)."""
    good = {}
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.array(v, dtype=np.float32).astype(np.float64)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    parent, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= 0.95:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, _ in rows}


def found(spark, rows):
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    return {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}


def noisy(r, n, spread):
    base = r.normal(size=64)
    return [(base + spread * r.normal(size=64) * np.linalg.norm(base) / 8).tolist() for _ in range(n)]


def test_clusters_copies_and_strangers(spark):
    r = np.random.default_rng(4)
    vectors = [v for k in range(30) for v in noisy(r, 6, 0.2)] + [r.normal(size=64).tolist() for _ in range(300)]
    vectors += [vectors[0]] * 3 + [vectors[7], (np.array(vectors[9]) * 3).tolist()]
    rows = list(enumerate(vectors))
    want, got = exact(rows), found(spark, rows)
    total = sum(w[0] for w in want.values())
    assert total > 300
    assert all(got[i][0] <= want[i][0] for i in want), "no link below the threshold"
    assert sum(g[0] for g in got.values()) >= 0.99 * total


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 4)
    monkeypatch.setattr(E, "GROUP", 16)
    r = np.random.default_rng(6)
    rows = list(enumerate([v for k in range(60) for v in noisy(r, 5, 0.22)]))
    want, got = exact(rows), found(spark, rows)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 20)
    r = np.random.default_rng(8)
    rows = list(enumerate(noisy(r, 90, 0.1) + [r.normal(size=64).tolist() for _ in range(20)]))
    assert found(spark, rows) == exact(rows)


def test_odd_vectors(spark):
    v = [1.0] + [0.0] * 63
    rows = [(1, v), (2, [0.0] * 64), (3, None), (4, []), (5, [float("nan")] + v[1:]), (6, [None] + v[1:]), (7, [float("inf")] + v[1:]), (8, v), (9, v[:10]), (10, [-0.0 if x == 0 else x for x in v])]
    got = found(spark, rows)
    assert got == {1: (2, 1), 8: (2, 1), 10: (2, 1), 9: (0, 9)} | {i: (0, i) for i in (2, 3, 4, 5, 6, 7)}


def test_empty_and_clashing_columns(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0], 3, 4, 5)], "vec_id long, embedding array<double>, rep int, t int, weight int")
    assert [tuple(x) for x in E.near_vectors(odd).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("n", [1, 100, 10**4, 10**6, 10**9])
def test_plan_keeps_the_recall(n):
    bits, m, least = E.plan(n)
    p = (1 - math.acos(0.95) / math.pi) ** bits * math.erf(E.WINDOW / math.sqrt(2 * 0.1))
    miss = sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(least))
    assert miss <= 1 - E.RECALL


@pytest.mark.parametrize("scale", [1e200, 1e-200, 5e-324, 1e308])
def test_numbers_of_any_size(spark, scale):
    rows = [(1, [scale, scale]), (2, [scale, scale * 1.0]), (3, [scale, 0.0]), (4, [0.0, -scale])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_shared_signs_keep_the_recall():
    """Simulated pairs at just the threshold, with the tables' shared signs, against the plan's promise."""
    r = np.random.default_rng(12)
    for n in (50_000, 10**6):
        bits, m, least = E.plan(n)
        shared, tables = E.shared_bits(n, bits), m // E.PER_TABLE
        a = E._units(r.normal(size=(4000, 64)))
        w = r.normal(size=a.shape)
        w = E._units(w - (w * a).sum(axis=1, keepdims=True) * a)
        b = 0.95 * a + math.sqrt(1 - 0.95**2) * w
        (ca, pa), (cb, pb) = (E.codes(x, shared, bits - shared, tables) for x in (a, b))
        hits = ((ca == cb) & (np.abs(pa - pb) <= E.WINDOW)).sum(axis=1)
        assert (hits < least).mean() <= 0.004
        met = (E.groups(a, shared, bits - shared, tables) == E.groups(b, shared, bits - shared, tables)).any(axis=1)
        assert (met | (hits == 0)).all()


def test_long_vectors(spark):
    r = np.random.default_rng(3)
    rows = list(enumerate([r.normal(size=3000).tolist() for _ in range(20)]))
    rows += [(100 + i, v) for i, v in rows[:5]]
    assert found(spark, rows) == exact(rows)


def test_an_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 0.0, 1.0])]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
