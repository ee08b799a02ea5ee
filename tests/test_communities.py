"""Communities by rounds over edges against the kernel, plain modularity and planted groups."""

import numpy as np
import pytest

from clademill.operators import kernels as K
from clademill.operators.communities import leiden, modularity

SCHEMA = "src bigint, dst bigint, w double"


def _quality(src, dst, w, member, resolution=1.0):
    total, degree = w.sum(), np.bincount(src, w, len(member)) + np.bincount(dst, w, len(member))
    t = np.bincount(member, degree)
    return w[member[src] == member[dst]].sum() / total - resolution * ((t / (2 * total)) ** 2).sum()


def _parts(n, src, dst, member):
    """Number of connected parts of the communities."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if member[a] == member[b]:
            up[root(a)] = root(b)
    return len({root(x) for x in range(n)})


def _run(spark, n, src, dst, w, resolution=1.0):
    edges = spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True)), SCHEMA)
    found = leiden(spark.range(n), edges, resolution)
    rows = sorted((r.id, r.cluster) for r in found.collect())
    assert [i for i, _ in rows] == list(range(n))
    member = np.array([c for _, c in rows])
    for c in np.unique(member):
        assert np.nonzero(member == c)[0][0] == c  # named by the smallest id
    assert _parts(n, src, dst, member) == len(np.unique(member))
    got = modularity(edges, found, resolution).first().modularity
    assert got == pytest.approx(_quality(src, dst, w, member, resolution), abs=1e-9)
    return member, got


def _near(rng, n, groups, k=8):
    x = rng.normal(size=(groups, 2))[rng.integers(0, groups, n)] * 4 + rng.normal(size=(n, 2))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    pairs = sorted({(min(i, int(j)), max(i, int(j))) for i in range(n) for j in np.argsort(d[i])[1 : k + 1]})
    src, dst = np.array(pairs).T
    return src, dst, np.exp(-d[src, dst]) + 0.01


def test_as_good_as_the_kernel(spark):
    n, resolution = 400, 1.0
    src, dst, w = _near(np.random.default_rng(3), n, 9)
    _, got = _run(spark, n, src, dst, w, resolution)
    assert got >= _quality(src, dst, w, K.leiden(n, src, dst, w, resolution), resolution) - 0.003


def test_ring_of_many_cliques(spark):
    cliques, m = 1500, 7
    inner = [(a, b) for a in range(m) for b in range(a)]
    src = np.array([c * m + a for c in range(cliques) for a, _ in inner] + [c * m for c in range(cliques)])
    dst = np.array([c * m + b for c in range(cliques) for _, b in inner] + [(c + 1) % cliques * m + 1 for c in range(cliques)])
    member, got = _run(spark, cliques * m, src, dst, np.ones(len(src)), 40.0)
    assert (member == np.arange(cliques * m) // m * m).all()


def test_unusual_graphs(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    of = lambda n, e: {r.id: r.cluster for r in leiden(spark.range(n), e).collect()}
    assert of(0, frame((0, 1, 1.0))) == {}
    assert of(3, frame((0, 0, 1.0), (1, 2, -1.0), (1, 2, None), (None, 2, 1.0), (1, 9, 1.0))) == {0: 0, 1: 1, 2: 2}
    # both directions and repeated rows are one edge; a node without edges is alone
    assert of(6, frame((0, 1, 1.0), (1, 0, 1.0), (0, 1, 1.0), (3, 4, 2.0), (4, 5, 2.0), (5, 3, 2.0))) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3}
