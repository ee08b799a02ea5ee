"""Registered queries that SQL does not express, against plain restatements over the same tables."""

import numpy as np
import pandas as pd
import pytest

from clademill.plans import catalog

SF = "/root/testdata/sf0.001"


def _means():
    """Label names, their mean vectors' cosine distances, and how many vectors each has."""
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    v = np.vstack(e.embedding).astype(float)
    names = sorted({f"L{x}" for x in e.label})
    mean = np.array([v[[f"L{x}" == n for x in e.label]].mean(0) for n in names])
    unit = mean / np.linalg.norm(mean, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, 0)
    return names, d, {n: sum(f"L{x}" == n for x in e.label) for n in names}


def test_pcoa_coords(spark):
    names, d, _ = _means()
    n = len(names)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    order = np.argsort(-values)
    positive = values[values > 1e-12].sum()
    got = catalog.QUERIES["pcoa_coords"](spark, SF).toPandas().set_index("id").loc[names]
    for k, c in enumerate(("pcoa1", "pcoa2")):
        want = vectors[:, order[k]] * np.sqrt(values[order[k]])
        assert min(np.abs(got[c] - want).max(), np.abs(got[c] + want).max()) < 1e-8
        assert got[f"pct{k + 1}"].tolist() == pytest.approx([100 * values[order[k]] / positive] * n)


def _cut(d, t):
    """Complete-linkage groups below a threshold, by the definition."""
    groups = [{i} for i in range(len(d))]
    while len(groups) > 1:
        h, i, j = min((max(d[a, b] for a in groups[i] for b in groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        if h >= t:
            break
        groups[j] |= groups.pop(i)
    return groups


def test_threshold_summary_and_the_closest(spark):
    names, d, sizes = _means()
    want = {}
    for t in (0.2, 0.5, 0.8, 0.9, 1.0, 1.1):
        groups = _cut(d, t)
        want[t] = (len(groups), max(sum(sizes[names[i]] for i in g) for g in groups))
    got = {r.threshold: (r.cluster_count, r.largest_genome_cluster) for r in catalog.QUERIES["threshold_summary"](spark, SF).collect()}
    assert got == want
    closest = min(want, key=lambda t: (abs(want[t][0] - 4), t))
    assert [r.threshold for r in catalog.QUERIES["closest_threshold"](spark, SF).collect()] == [closest]


def _joined(d):
    """Leaf distances on the neighbour-joining tree, by the textbook's loop."""
    n = len(d)
    nodes, dist, edges, new = list(range(n)), {(i, j): d[i, j] for i in range(n) for j in range(n)}, [], n
    while len(nodes) > 2:
        total = {i: sum(dist[i, k] for k in nodes) for i in nodes}
        _, a, b = min(((len(nodes) - 2) * dist[i, j] - total[i] - total[j], i, j) for i in nodes for j in nodes if i < j)
        length = 0.5 * dist[a, b] + (total[a] - total[b]) / (2 * (len(nodes) - 2))
        edges += [(a, new, length), (b, new, dist[a, b] - length)]
        for k in nodes:
            if k not in (a, b):
                dist[new, k] = dist[k, new] = 0.5 * (dist[a, k] + dist[b, k] - dist[a, b])
        dist[new, new] = 0.0
        nodes = [k for k in nodes if k not in (a, b)] + [new]
        new += 1
    edges.append((nodes[0], nodes[1], dist[nodes[0], nodes[1]]))
    return edges


def _paths(edges, leaves):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    out = {}
    for leaf in leaves:
        todo, seen = [(leaf, 0.0)], {}
        while todo:
            x, w = todo.pop()
            if x not in seen:
                seen[x] = w
                todo += [(y, w + v) for y, v in near[x]]
        out |= {(leaf, other): seen[other] for other in leaves}
    return out


def test_nj_tree(spark):
    names, d, _ = _means()
    rows = catalog.QUERIES["nj_tree"](spark, SF).toPandas()
    leaf = {r.node: r.id for r in rows.itertuples() if r.is_leaf}
    assert sorted(leaf.values()) == names
    edges = [(r.node, int(r.parent), r.branch_length) for r in rows.itertuples() if r.parent == r.parent and r.parent >= 0 and r.parent != r.node]
    got = _paths(edges, list(leaf))
    want = _paths(_joined(d), range(len(names)))
    lengths = [w for (_, _, w) in _joined(d)]
    if min(lengths) >= 0:  # the kernel holds negative branches at 0
        assert all(got[a, b] == pytest.approx(want[names.index(leaf[a]), names.index(leaf[b])], abs=1e-9) for a in leaf for b in leaf)
    assert len(edges) == len(rows) - 1


def _identity(a, b):
    """Affine global alignment cell by cell: (score, columns, matches) of the best ending in a column, a gap in b, a gap in a."""
    if not a or not b:
        return 0.0
    low = (-1e18, 0, 0)
    first = lambda *s: next(x for x in s if round(x[0], 9) == round(max(y[0] for y in s), 9))
    plus = lambda s, v, c=0, m=0: (s[0] + v, s[1] + c, s[2] + m)
    d = [(0.0, 0, 0)] + [low] * len(b)
    up = [low] * (len(b) + 1)
    left = [low] + [(-1.0 - 0.5 * (j - 1), 0, 0) for j in range(1, len(b) + 1)]
    for i in range(1, len(a) + 1):
        nd, nu, nl = [low], [], [low]
        for j in range(len(b) + 1):
            nu.append(first(plus(first(d[j], up[j], left[j]), -1.0), plus(up[j], -0.5)))
            if j:
                same = a[i - 1] == b[j - 1]
                nd.append(plus(first(d[j - 1], up[j - 1], left[j - 1]), 1.0 * same, 1, same))
                nl.append(first(plus(first(nd[j - 1], nu[j - 1], nl[j - 1]), -1.0), plus(nl[j - 1], -0.5)))
        d, up, left = nd, nu, nl
    end = first(d[-1], up[-1], left[-1])
    return 100.0 * end[2] / end[1] if end[1] else 0.0


def test_pairwise_identity(spark):
    import re

    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    seqs = {int(i): re.sub("[^ACGT]", "", (t or "").upper()) for i, t in zip(items.item_id, items.text, strict=True)}
    got = {(r.a, r.b): r.identity for r in catalog.QUERIES["pairwise_identity"](spark, SF).collect()}
    assert set(got) == {(a, b) for a in seqs for b in seqs if a < b}
    assert sum(got[k] != pytest.approx(_identity(seqs[k[0]], seqs[k[1]])) for k in got) <= 0.02 * len(got)  # equal scores may be reached by other columns


def test_consensus_events(spark):
    from tests.test_operators import _one_pass

    rows = catalog.events(spark, SF).orderBy("ord").collect()
    ords = [r.ord for r in rows]
    events = [(r.method, r.start, r.end, r.recombinant, r.parent_a, r.parent_b, r.pvalue) for r in rows]
    want = []
    for g in _one_pass(events, 0.01, 3):
        own = sorted(g)
        methods = sorted({events[i][0] for i in own})
        if len(methods) >= 2:
            starts, ends, p = sorted(events[i][1] for i in own), sorted(events[i][2] for i in own), [events[i][6] for i in own if 0 <= events[i][6] <= 1]
            members = sorted({x for i in own for x in events[i][3:6] if x})
            want.append((";".join(members), ",".join(methods), len(own), starts[len(own) // 2], ends[len(own) // 2], starts[0], ends[-1], min(p) if p else None))
    assert len(ords) == len(set(ords)) and want
    got = [(r.members, r.methods, r.n_events, r.start, r.end, r.start_min, r.end_max, None if r.min_pvalue != r.min_pvalue else r.min_pvalue) for r in catalog.QUERIES["consensus_events"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["explorer_grid", "explorer_items"])
def test_explorer(spark, name):
    one, two = (catalog.QUERIES[name](spark, SF).toPandas().sort_values(["state_id", "ord"]).reset_index(drop=True) for _ in range(2))
    pd.testing.assert_frame_equal(one, two)
    assert not one.duplicated(["state_id", "ord"]).any() and one.groupby("state_id").size().nunique() == 1
    assert one.x.notna().all() and one.y.notna().all() and one.cluster.str.fullmatch(r"C\d\d+").all()
    for _, state in one.groupby("state_id"):  # labels in the order of first appearance, places shared within a (k, n, d)
        seen = list(dict.fromkeys(state.cluster))
        assert seen == [f"C{i + 1:02d}" for i in range(len(seen))]
    assert one.groupby(["k", "neighbors", "min_dist", "ord"])[["x", "y"]].nunique().max().max() == 1


def test_explorer_items_keeps_neighbours(spark):
    from clademill.operators.kernels import trustworthiness

    e = pd.read_parquet(f"{SF}/embeddings.parquet").set_index("vec_id").embedding
    for _, state in catalog.QUERIES["explorer_items"](spark, SF).toPandas().groupby("state_id"):
        high, low = np.vstack(e.loc[state.id]).astype(float), state[["x", "y"]].to_numpy()
        mixed = np.random.default_rng(0).permutation(low)
        assert trustworthiness(high, low, 15) > trustworthiness(high, mixed, 15) + 0.05
