"""Hand-made fixtures and properties of the matrix and graph kernels."""

import numpy as np
import pytest

from clademill.operators import kernels as K
from clademill.operators.clusters import pearson_p

TREE = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)


def test_alignment_identity():
    a, b = "AAAAACCCCCAAAAACCCCCAAAA", "AAAAACCCCCAAAATCCCCCAAAA"
    assert K.align_identity(a, a) == 100
    assert K.align_identity(a, b) == pytest.approx(95.833333, abs=1e-6)
    assert K.align_identity("AAACCC", "AAACC") == 100  # one end gap
    assert K.align_identity("", "A") == 0 and K.align_identity("AAAA", "TTTT") == 0


def test_neighbor_joining_recovers_an_additive_tree():
    edges = K.neighbor_joining(TREE)
    assert np.allclose(K.patristic(edges, 5), TREE)
    text = K.newick(edges, list("abcde"))
    assert text.endswith(";") and all(f"{c}:" in text for c in "abcde")
    nodes = K.tree_nodes(edges, 5)
    assert sum(v["leaf"] for v in nodes.values()) == 5
    assert sorted(v["y"] for v in nodes.values() if v["leaf"]) == [0, 1, 2, 3, 4]


def test_linkage_and_cuts():
    tree = K.complete_linkage(TREE)
    assert tree[:, 2].tolist() == [3, 5, 8, 10]
    assert K.cut_tree(tree, 5, 3).tolist() == [0, 1, 2, 3, 4]  # a merge at the threshold is not made
    assert K.cut_tree(tree, 5, 6).tolist() == [0, 0, 1, 2, 2]
    assert len(set(K.cut_tree(tree, 5, 99))) == 1


def test_linkage_against_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.normal(size=(9, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        groups, heights = [{i} for i in range(9)], []
        while len(groups) > 1:
            h, i, j = min((max(d[a, b] for a in groups[i] for b in groups[j]), i, j) for i in range(len(groups)) for j in range(i))
            heights.append(h)
            groups[j] |= groups.pop(i)
        assert np.allclose(K.complete_linkage(d)[:, 2], heights)


def test_pcoa_keeps_distances_and_signs():
    x = np.random.default_rng(0).normal(size=(12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    xy, values = K.pcoa(d)
    again = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    assert np.allclose(d, again) and len(values) == 3
    assert K.variance_explained(values).sum() == pytest.approx(100)


def test_hull_farthest_trust_leiden_umap():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float)
    assert len(K.hull(square)) == 4 and len(K.hull(square[:2])) == 0
    order, _ = K.farthest_points(np.array([[0, 0], [10, 0], [5, 0.1], [5, 9]]), 3)
    assert len(set(order.tolist())) == 3
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, (30, 4)) for c in (0, 5, 10)])
    y = K.umap(x, 10, 0.1)
    assert np.array_equal(y, K.umap(x, 10, 0.1))
    assert K.trustworthiness(x, x, 5) == pytest.approx(1) and K.trustworthiness(x, y, 10) > 0.9
    src = [(i, j) for c in range(3) for i in range(30 * c, 30 * c + 30) for j in range(i + 1, 30 * c + 30)]
    a, b = np.array(src).T
    found = K.leiden(90, np.append(a, 0), np.append(b, 89), np.append(np.ones(len(a)), 0.01), 1.0)
    assert len(set(found)) == 3 and len(set(found[:30])) == 1


def test_pearson_p():
    assert pearson_p(0.5, 2) == 1 and pearson_p(1.0, 5) == 0
    assert pearson_p(0.5, 10) == pytest.approx(0.1411, abs=1e-3)
