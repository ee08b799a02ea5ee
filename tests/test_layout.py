"""Embeddings by rounds: the graph against a plain restatement, places against the dense kernel's."""

import math

import numpy as np
import pytest

from clademill.operators import kernels as K
from clademill.operators import layout
from clademill.operators.metric import nearest_vectors


def _clouds(n, dim=16, seed=1, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    own = rng.integers(0, groups, n)
    return centres[own] + rng.normal(size=(n, dim)), own


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, vector array<double>").repartition(3)


def _plain_graph(x, k):
    """Memberships and their union, row by row."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).round(9)
    near = {i: sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))}
    mean = np.mean([g for r in near.values() for g, _ in r])
    p = {}
    for i, row in near.items():
        rho = min((g for g, _ in row if g > 0), default=0.0)
        low, high, sigma = 0.0, math.inf, 1.0
        for _ in range(64):
            if sum(math.exp(-max(g - rho, 0) / sigma) for g, _ in row) > math.log2(k):
                high = sigma
            else:
                low = sigma
            sigma = sigma * 2 if math.isinf(high) else (low + high) / 2
        sigma = max(sigma, 1e-3 * mean)
        p |= {(i, j): math.exp(-max(g - rho, 0) / sigma) for g, j in row}
    return {(i, j): p.get((i, j), 0) + p.get((j, i), 0) - p.get((i, j), 0) * p.get((j, i), 0) for i, j in {(min(e), max(e)) for e in p}}


def test_the_graph_is_the_fuzzy_union(spark):
    x, _ = _clouds(90)
    x[:5] = x[5]  # rows whose neighbours are at distance 0
    points = _frame(spark, x)
    got = {(r.src, r.dst): r.w for r in layout.fuzzy_graph(nearest_vectors(points, points, 8)).collect()}
    want = {e: w for e, w in _plain_graph(x, 8).items() if w > 0}
    assert got.keys() == want.keys()
    assert all(got[e] == pytest.approx(want[e], abs=1e-9) for e in want)


def test_places_are_as_trustworthy_as_the_dense_kernels(spark):
    x, own = _clouds(900)
    got = layout.embed(_frame(spark, x), 12, 0.1, landmarks=150, block=200).toPandas().set_index("id").loc[range(900)].to_numpy()
    dense = K.umap(x, 12, 0.1)
    assert np.isfinite(got).all()
    assert K.trustworthiness(x, got, 12) >= K.trustworthiness(x, dense, 12) - 0.02
    d = np.sqrt(((got[:, None] - got[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert (own[d.argmin(1)] == own).mean() > 0.97
    gaps = np.sqrt(((dense[:, None] - dense[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    near = lambda m: np.median(np.sort(m, axis=1)[:, :10])
    assert near(gaps) / 2 < near(d) < 2 * near(gaps)  # points do not fall into clumps


def test_same_seed_same_places(spark):
    x, _ = _clouds(120)
    one, two = (layout.embed(_frame(spark, x), 8, 0.1, landmarks=50, block=40).toPandas().set_index("id").sort_index() for _ in range(2))
    assert np.allclose(one, two, atol=1e-9)


def test_copies_missing_vectors_and_few_rows(spark):
    x, _ = _clouds(60)
    x[20:] = x[0]  # two thirds of all rows are one point
    rows = _frame(spark, x).unionByName(spark.createDataFrame([(900, None)], "id bigint, vector array<double>"))
    got = {r.id: (r.x, r.y) for r in layout.embed(rows, 5, 0.1).collect()}
    assert len(got) == 61 and got[900] == (None, None)
    assert {got[i] for i in range(20, 60)} == {got[0]} and len({got[i] for i in range(20)}) == 20
    for few in (0, 1, 2):
        assert layout.embed(_frame(spark, x[:few]), 5, 0.1).count() == few


def test_blocks_hold_about_their_share(spark):
    rng = np.random.default_rng(3)
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)) ** 3)], "id bigint, x double, y double")
    for flip in (False, True):
        sizes = [r["count"] for r in layout._blocks(places, 3000, 100, flip).groupBy("block").count().collect()]
        assert sum(sizes) == 3000 and max(sizes) <= 150
