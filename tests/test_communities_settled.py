"""Levels of few edges are settled in one task, at first or after rounds."""

import numpy as np
import pytest
from test_communities import SCHEMA, _near, _quality, _run

from clademill.operators import communities as D
from clademill.operators import kernels as K


def test_a_graph_of_few_edges_takes_no_rounds(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rounds over 3,000 edges")

    monkeypatch.setattr(D, "_moved", refused)
    n = 400
    src, dst, w = _near(np.random.default_rng(3), n, 9)
    _, got = _run(spark, n, src, dst, w)
    assert got == pytest.approx(_quality(src, dst, w, K.leiden(n, src, dst, w)), abs=1e-9)


def test_a_level_of_joined_nodes_is_settled_with_what_lies_inside_them(spark):
    """Nodes with weight inside, and communities that are better than what the kernel finds, which stay."""
    rng = np.random.default_rng(5)
    n = 60
    src, dst, w = _near(rng, n, 4, 5)
    node = np.arange(n) // 2 * 2  # pairs of points are nodes
    a, b = node[src], node[dst]
    out = a != b
    k = np.bincount(node, np.bincount(src, w, n) + np.bincount(dst, w, n), n)
    links = [(int(x), int(y), float(z)) for x, y, z in [*zip(a[out], b[out], w[out], strict=True), *zip(b[out], a[out], w[out], strict=True)]]
    links = spark.createDataFrame(links, SCHEMA).groupBy("src", "dst").agg(D.F.sum("w").alias("w"))
    for start in (node, np.zeros(n, int)):
        state = spark.createDataFrame([(int(i), int(start[i]), float(k[i])) for i in np.unique(node)], "id bigint, c bigint, k double")
        found = {r.id: r.c for r in D._settled(links, state, 1.0, 42).collect()}
        assert sorted(found) == np.unique(node).tolist()
        quality = _quality(src, dst, w, np.unique([found[i] for i in node], return_inverse=True)[1])
        assert quality >= _quality(src, dst, w, np.unique(start, return_inverse=True)[1]) - 1e-9 and quality > 0.3


def test_rounds_come_first_where_edges_are_many(spark, monkeypatch):
    monkeypatch.setattr(D, "LOCAL_EDGES", 60)
    moved, ran = D._moved, []
    monkeypatch.setattr(D, "_moved", lambda *a: (ran.append(1), moved(*a))[1])
    n = 48
    src, dst, w = _near(np.random.default_rng(3), n, 3, 4)
    assert len(src) > 60
    _, got = _run(spark, n, src, dst, w)
    assert ran and got >= _quality(src, dst, w, K.leiden(n, src, dst, w)) - 0.02
