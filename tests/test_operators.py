"""Distributed operators against plain re-statements, and the queries against SQL."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clademill.operators import clusters as C
from clademill.operators import recombination as R
from clademill.operators import similarity as M
from clademill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_greedy_collapse_is_the_sequential_one(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 25
        edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.12}
        protected = {i for i in range(n) if rng.random() < 0.15}
        rank = list(range(n))
        rng.shuffle(rank)
        kept, owner = [], {}
        for v in sorted(range(n), key=lambda i: rank[i]):
            hit = next((k for k in kept if k not in protected and (min(k, v), max(k, v)) in edges), None) if v not in protected else None
            owner[v] = v if hit is None else hit
            if hit is None:
                kept.append(v)
        items = spark.createDataFrame([(i, rank[i], i in protected) for i in range(n)], "id bigint, rank int, protected boolean")
        got = M.greedy_collapse(items, spark.createDataFrame(sorted(edges) or [(0, 0)], "a bigint, b bigint"))
        assert {r.id: r.representative for r in got.collect()} == owner


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(3)]
    seqs = []
    for i in range(30):
        s = list(base[i % 3])
        for _ in range(i % 4):
            s[rng.randrange(120)] = rng.choice("ACGT")
        seqs.append("".join(s))
    seqs += [seqs[0], "ACG", ""]
    sets = [{s[i : i + 5] for i in range(len(s) - 4)} for s in seqs]
    expected = set()
    for i in range(len(seqs)):
        for j in range(i + 1, len(seqs)):
            n = len(sets[i] & sets[j])
            if n:
                import math

                jac = n / len(sets[i] | sets[j])
                if 100 * (1 + math.log(2 * jac / (1 + jac)) / 5) >= 90:
                    expected.add((i, j))
    got = M.similar_pairs(spark.createDataFrame(list(enumerate(seqs)), "id bigint, seq string"), 5, 90.0)
    assert {(r.a, r.b) for r in got.collect()} == expected
    with pytest.raises(ValueError):
        M.similar_pairs(got, 5, 0.0)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    nodes = sorted({x for e in edges for x in e} | {999})
    got = C.connected(spark.createDataFrame([(n,) for n in nodes], "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.id: r.component for r in got.collect()} == {n: root(n) for n in nodes}


@pytest.mark.parametrize("k", [1, 4, 30])
def test_neighbours_by_grid_are_those_of_all_pairs(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    xy = np.concatenate([rng.normal(size=(150, 2)), rng.normal(scale=0.01, size=(60, 2)) + 3, np.full((40, 2), 1.5), [[90.0, -70.0], [90.0, -70.0]]])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id bigint, x double, y double")
    rows = lambda *a, **b: sorted(map(tuple, C.nearest(*a, **b).collect()))
    whole, some = rows(points, points, k), rows(points.where("id % 7 = 0"), points, k, include_self=True)
    monkeypatch.setattr(C, "ALL_PAIRS", 0)
    assert rows(points, points, k) == whole and rows(points.where("id % 7 = 0"), points, k, include_self=True) == some


def test_allocation_labels_and_references(spark):
    w = spark.createDataFrame([("A", 7), ("B", 2), ("C", 1)], "key string, weight bigint")
    assert {r.key: r.quota for r in C.largest_remainder(w, 10).collect()} == {"A": 7, "B": 2, "C": 1}
    rows = spark.createDataFrame(list(enumerate([3, 3, 8, 8, 2])), "ord bigint, raw int")
    assert {r.raw: r.label for r in C.first_seen_labels(rows, "raw", "A", 3).collect()} == {3: "A001", 8: "A002", 2: "A003"}
    p = spark.createDataFrame([("g", "genome", 1, "r1", 90.0), ("g", "genome", 2, "r2", 95.0), ("r1", "reference", 1, "r1", 100.0), ("r1", "reference", 2, "r2", 80.0)], "id string, item_class string, ref_ord int, ref_id string, identity double")
    got = {r.id: r for r in C.top_references(p, 96.0).collect()}
    assert (got["g"].best_ref_id, got["g"].second_ref_id, got["g"].candidate_novel) == ("r2", "r1", True)
    assert (got["r1"].best_ref_id, got["r1"].second_ref_id, got["r1"].candidate_novel) == ("r2", "r2", False)


EVENT = "ord bigint, method string, start int, end int, recombinant string, parent_a string, parent_b string, pvalue double"


def _events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT)


#: Intervals of 100 sites on both sides of the overlap of one half, and ends on both sides of the tolerance.
TRIO = ("p", "q", "r")


@pytest.mark.parametrize(
    ("second", "joined"),
    [((150, 250), True), ((151, 281), True), ((199, 300), True), ((199, 301), False), ((201, 301), False), ((700, 800), False), ((190, 202), True), ((195, 215), True), ((195, 315), False), ((40, 160), True)],
)
def test_consensus_joins_by_overlap_or_ends(spark, second, joined):
    rows = [("rdp", 100, 200, *TRIO, 0.001), ("maxchi", *second, *TRIO, 0.002)]
    got = R.consensus(_events(spark, rows), min_methods=2).collect()
    assert len(got) == joined
    if joined:
        assert (got[0].start, got[0].end, got[0].start_min, got[0].end_max) == (max(100, second[0]), max(200, second[1]), min(100, second[0]), max(200, second[1]))


def test_consensus_gate_fragments_and_least_pvalue(spark):
    wide, near = ("geneconv", 1000, 1900, "x", "y", "", 0.02), ("geneconv", 300, 420, "x", "z", "", 0.03)
    one = R.consensus(_events(spark, [wide, near]), min_methods=1).collect()
    assert [(r.members, r.start, r.end, r.n_events, r.min_pvalue) for r in one] == [(["x", "y", "z"], 300, 420, 1, 0.03)]
    assert R.consensus(_events(spark, [wide, ("geneconv", 300, 800, "x", "z", "", 0.03)]), min_methods=1).count() == 2  # not twice as long
    assert R.consensus(_events(spark, [wide, ("geneconv", 950, 1100, "x", "z", "", 0.03)]), min_methods=1).count() == 2  # they overlap
    odd = [("rdp", 5, 90, *TRIO, -2.0), ("maxchi", 5, 90, *TRIO, 0.04), ("chimaera", 5, 90, *TRIO, 7.5), ("siscan", 5, 90, *TRIO, float("nan")), ("rdp", 5, 90, "p", "", "", 0.01)]
    got = R.consensus(_events(spark, odd), min_methods=1).collect()
    assert [(r.methods, r.min_pvalue) for r in got] == [(["maxchi", "rdp", "siscan"], 0.04)]
    assert {r.n_events for r in R.consensus(_events(spark, odd), min_methods=1, pvalue_max=1.0).collect()} == {4}
    assert np.isnan(R.consensus(_events(spark, odd[3:4]), min_methods=1).first().min_pvalue)


def _one_pass(rows, pvalue_max, max_members):
    """Groups of one loop over all events, as sets of their ``ord``."""
    kept = []
    for i, (method, start, end, rec, a, b, p) in enumerate(rows):
        members = sorted({x for x in (rec, a, b) if x})
        if len(members) >= 2 and not min(p, 1.0) > pvalue_max:
            kept.append({"ord": i, "method": method, "start": start, "end": end, "members": members, "recombinant": rec, "parents": [x for x in (a, b) if x]})
    used, paired = set(), []
    for i, x in enumerate(kept):
        for y in kept[i + 1 :]:
            if x["ord"] in used or y["ord"] in used or not all(e["method"] == "geneconv" and len(e["parents"]) == 1 and e["recombinant"] for e in (x, y)) or x["recombinant"] != y["recombinant"] or x["parents"] == y["parents"]:
                continue
            small, big = (x, y) if x["end"] - x["start"] <= y["end"] - y["start"] else (y, x)
            both = max(0, min(x["end"], y["end"]) - max(x["start"], y["start"]))
            if big["end"] - big["start"] >= 2 * (small["end"] - small["start"]) and both <= 0.1 * (small["end"] - small["start"]):
                used |= {x["ord"], y["ord"]}
                paired.append(small | {"ord": x["ord"], "members": sorted({*x["members"], *y["members"]})})
    groups = []
    for e in sorted(paired + [e for e in kept if e["ord"] not in used], key=lambda e: (e["start"], e["end"])):
        for g in groups:
            fits = any(len({*e["members"]} & {*o["members"]}) >= 2 and (max(0, min(e["end"], o["end"]) - max(e["start"], o["start"])) >= 0.5 * min(e["end"] - e["start"], o["end"] - o["start"]) or abs(e["start"] - o["start"]) <= 100 and abs(e["end"] - o["end"]) <= 100) for o in g)
            if fits and len({m for o in [*g, e] for m in o["members"]}) <= max_members:
                g.append(e)
                break
        else:
            groups.append([e])
    return {frozenset(o["ord"] for o in g) for g in groups}


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(220):
        names = rng.sample("abcdefgh"[: 4 + seed], 3)
        start = rng.randrange(0, 1500)
        rows.append((rng.choice(["geneconv", "rdp", "maxchi"]), start, start + rng.choice([60, 150, 150, 400]), names[0], names[1], rng.choice(["", names[2]]), rng.choice([0.001, 0.02, 0.2, 3.0, -1.0, float("nan")])))
    got = R.merged_events(_events(spark, rows), 0.05, max_members=3 + seed % 2)
    groups = {}
    for r in got.collect():
        groups.setdefault((r.block, r.grp), set()).add(r.ord)
    assert {frozenset(g) for g in groups.values()} == _one_pass(rows, 0.05, 3 + seed % 2)


def test_consensus_bound(spark):
    rows = [(m, 1000, 1200, f"S{i}", f"S{i + 1}", f"S{i + 2}", 0.001) for i in range(6) for m in ("geneconv", "rdp")]
    got = R.consensus(_events(spark, rows), min_methods=1).collect()
    assert len(got) > 1 and max(len(r.members) for r in got) <= 3
    assert max(len(r.members) for r in R.consensus(_events(spark, rows), min_methods=1, max_members=99).collect()) > 3


def test_roles():
    rows = {"B": "A" * 40, "D": "C" * 40, "R": "A" * 20 + "C" * 10 + "A" * 9 + "-", "E": "A" * 40}
    call = R.polarise(rows, "R", ["B", "D"], 20, 30)
    assert call == {"backbone_parent": "B", "donor_parent": "D", "informative_sites_tract": 10, "informative_sites_flank": 29, "tract_supports": "D", "flank_supports": "B"}
    assert R.polarise(rows, "R", ["B", "D", "E"], 20, 30) == R.NO_ROLES == R.polarise(rows, "gone", ["B", "D"], 20, 30)
    assert R.polarise(rows, "R", ["B", "D", "gone", ""], 20, 30) == call
    assert R.polarise(rows, "B", ["D", "E"], 20, 30)["backbone_parent"] == "" and R.polarise(rows, "B", ["D", "E"], 20, 30)["tract_supports"] == "E"
    best = R.assign_roles(rows, ["B", "D", "R"], 20, 30)
    assert (best["recombinant_resolved"], best["role_support"], best["donor_parent"]) == ("R", 39, "D")
    assert R.assign_roles(rows, ["B", "R"], 20, 30) == R.NO_ROLES | {"recombinant_resolved": "", "role_support": 0}
    none = R.assign_roles({"B": "AAAA", "D": "CCCC", "E": "AAAA"}, ["B", "D", "E"], 1, 2)
    assert (none["recombinant_resolved"], none["informative_sites_tract"], none["informative_sites_flank"], none["tract_supports"]) == ("", 1, 3, "E")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, name):
    import duckdb

    got = catalog.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in "part supplier lineitem events documents embeddings benchmark labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


def test_gaussian_graph_has_edges_from_every_point(spark):
    points = {r.id for r in catalog.points(spark, SF).collect()}
    edges = catalog.QUERIES["knn_graph_gaussian"](spark, SF).toPandas()
    degree = pd.concat([edges.src, edges.dst]).value_counts()
    assert set(degree.index) == points and degree.min() >= 10
