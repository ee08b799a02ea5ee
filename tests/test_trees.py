"""Neighbour joining against its definition, and the lines of drawn trees."""

import time

import numpy as np
import pandas as pd
import pytest

from clademill.operators import kernels as K
from clademill.operators import trees
from clademill.plans import catalog

SF = "/root/testdata/sf0.001"


def _plainly(distance):
    """The whole criterion at every step."""
    d = np.maximum(np.array(distance, float), 0)
    nodes, edges, new = list(range(len(d))), [], len(d)
    while len(nodes) > 2:
        m, total = len(nodes), d.sum(1)
        q = (m - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(m)] = np.inf
        i, j = divmod(int(np.argmax(q <= q.min() + 1e-11 * (1 + abs(q.min()) + total.max()))), m)  # the first pair, but for rounding
        length = d[i, j] / 2 + (total[i] - total[j]) / (2 * (m - 2))
        edges += [(new, nodes[i], length), (new, nodes[j], d[i, j] - length)]
        keep = [k for k in range(m) if k not in (i, j)]
        row = (d[i, keep] + d[j, keep] - d[i, j]) / 2
        d = np.block([[d[np.ix_(keep, keep)], row[:, None]], [row[None, :], np.zeros((1, 1))]])
        nodes, new = [nodes[k] for k in keep] + [new], new + 1
    return edges + ([(nodes[1], nodes[0], d[0, 1])] if len(distance) > 2 else [(new, nodes[0], d[0, 1] / 2), (new, nodes[1], d[0, 1] / 2)])


@pytest.mark.parametrize("kind", ["points", "ties", "far one", "equal"])
@pytest.mark.parametrize("n", [2, 3, 4, 40])
def test_the_bounded_search_gives_the_same_tree(kind, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 5))
    if kind == "ties":
        x = rng.integers(0, 2, (n, 3)).astype(float)
    if kind == "far one":
        x[0] += 1000
    d = np.zeros((n, n)) if kind == "equal" else np.abs(x[:, None] - x[None]).sum(-1)
    got, want = K.neighbor_joining(d), _plainly(d)
    assert [e[:2] for e in got] == [e[:2] for e in want]
    assert np.allclose([e[2] for e in got], [e[2] for e in want])


def test_500_tips_in_less_than_half_of_the_time():
    x = np.random.default_rng(0).normal(size=(500, 8))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    t = time.process_time()
    want = _plainly(d)
    plain, t = time.process_time() - t, time.process_time()
    got = K.neighbor_joining(d)
    assert time.process_time() - t < plain / 2  # between a quarter and a third where it was measured
    assert [e[:2] for e in got] == [e[:2] for e in want]


def test_lines_of_a_tree_worked_by_hand():
    # ((0:1, 1:2):1, 2:3), with a negative length that counts as none
    nodes = K.tree_nodes([(3, 0, 1.0), (3, 1, -2.0), (4, 3, 1.0), (4, 2, 3.0)], 3)
    lines = {(r[0], r[1], r[2]): r[3:] for r in K.tree_segments(nodes)}
    assert lines == {
        ("branch", 3, 0): (1.0, 0.0, 2.0, 0.0, 1.0, 2.0), ("branch", 3, 1): (1.0, 1.0, 1.0, 1.0, 0.0, 1.0), ("branch", 4, 3): (0.0, 0.5, 1.0, 0.5, 1.0, 1.0),
        ("branch", 4, 2): (0.0, 2.0, 3.0, 2.0, 3.0, 3.0), ("connector", 3, None): (1.0, 0.0, 1.0, 1.0, 0.0, 1.0), ("connector", 4, None): (0.0, 0.5, 0.0, 2.0, 0.0, 0.0),
    }


def test_panel_trees(spark):
    lines = catalog.QUERIES["panel_trees"](spark, SF).toPandas()
    e = pd.read_parquet(f"{SF}/embeddings.parquet").set_index("vec_id").embedding
    for _, own in lines.groupby("cluster"):
        leaves = own[own.id.notna()].sort_values("id")
        x = np.vstack(e.loc[leaves.id.astype(int)]).astype(float)
        want = K.tree_nodes(_plainly(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))), len(x))
        branches = own[own.kind == "branch"]
        assert len(branches) == len(want) - 1 and len(own) - len(branches) == len(want) - len(x)
        got = {int(c): (p, b, y) for c, p, b, y in zip(branches.child, branches.parent, branches.branch_length, branches.y2, strict=True)}
        for node, v in want.items():
            if v["parent"] is not None:
                assert got[node] == (v["parent"], pytest.approx(max(0.0, v["length"]), abs=1e-7), v["y"])


def test_small_and_too_large_clusters(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, [0.0]), ("b", 2, [1.0]), ("b", 3, [5.0])], "cluster string, id int, vector array<double>")
    got = trees.group_trees(rows).collect()
    assert {r.cluster for r in got} == {"b"} and sorted(r.branch_length for r in got if r.kind == "branch") == [2.0, 2.0]
    assert trees.group_trees(rows.where("false")).count() == 0
    monkeypatch.setattr(trees, "MOST", 1)
    with pytest.raises(ValueError):
        trees.group_trees(rows)
