"""Candidates of similar sequences: none that merely shares a few k-mers, and no link lost."""

import random

import pytest

from clademill.operators import similarity as M
from clademill.operators.kernels import kmer_codes_without_n


def _family(r, n, changes):
    first = "".join(r.choice("ACGT") for _ in range(n))
    out = [first]
    for c in changes:
        s = list(first)
        for _ in range(c):
            s[r.randrange(len(s))] = r.choice("ACGT")
        out.append("".join(s))
    return out


@pytest.mark.parametrize("identity", [90.0, 98.1, 99.5])
def test_pairs_equal_brute_force_and_candidates_are_few(spark, identity):
    r = random.Random(5)
    common = "".join(r.choice("ACGT") for _ in range(40))
    rows = [s for n in (30, 90, 400, 900) for s in _family(r, n, (1, 2, 4, 9, 20, 40))]
    rows += ["".join(r.choice("ACGT") for _ in range(500)) + common + "".join(r.choice("ACGT") for _ in range(300)) for _ in range(60)]
    rows += [rows[0], rows[9], "", "ACGT", rows[20][:700], rows[25][100:]]
    seqs = spark.createDataFrame(list(enumerate(rows)), "id bigint, seq string")
    k, sets = 15, [set(kmer_codes_without_n(s, 15).tolist()) for s in rows]
    j = M.least_jaccard(identity, k)
    want = {(a, b): len(sets[a] & sets[b]) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and len(sets[a] & sets[b]) >= (j - 1e-9) * len(sets[a] | sets[b])}
    got = {(x.a, x.b): x.shared for x in M.similar_pairs(seqs, k, identity).collect()}
    assert got == want
    _, distinct = M._groups(seqs, k)
    assert set(distinct.columns) == {"rep", "size", "seq"}  # k-mers are eight times the letters
    prefix = M._prefixes(distinct, k, j, M._frequent(distinct, k))
    near = {(x.a, x.b) for x in M._near(prefix, prefix, j, True).collect()}
    # sixty sequences hold one passage, and none of their pairs is looked at in full
    assert not any(28 <= a < 88 and 28 <= b < 88 for a, b in near)
    assert {p for p in want if rows[p[0]] != rows[p[1]] and rows.index(rows[p[0]]) == p[0] and rows.index(rows[p[1]]) == p[1]} <= near


def test_a_query_goes_once_to_a_tile_of_cells(spark):
    """Vectors that no bound parts need all cells, and are sent as often as there are tiles, not cells."""
    import numpy as np
    import pandas as pd

    from clademill.operators import metric as X

    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(50, 16))
    cells = pd.DataFrame({"cell": range(50), "n": 20, "low": 0.0, "high": 9.0})
    tile, told = X._tiled(cells, pivots, 200)
    assert np.bincount(tile, cells["n"]).max() <= 200 and told["parts"].max() == 1 and tile.max() + 1 == 5
    rows = [(i, [float(v) for v in rng.normal(size=16)], 50.0) for i in range(30)]
    asked = spark.createDataFrame(rows, "id bigint, vector array<double>, bound double")
    first = X._plan(asked, pivots, cells, 5, "bigint", False, tile).count()
    rest = X._plan(asked, pivots, cells, 5, "bigint", True, tile).count()
    assert first == 30 and first + rest == 30 * 5


def test_ten_thousand_points_go_by_the_grid(spark, monkeypatch):
    """All pairs of them were made and sorted; the grid gives the same."""
    import numpy as np

    from clademill.operators import clusters as C

    def refused(*_):
        raise AssertionError("all pairs of 4,000 points")

    x = np.random.default_rng(6).normal(size=(4000, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, x double, y double")
    monkeypatch.setattr(C, "_by_blocks", refused)
    got = {(r.id, r["rank"]): r.other for r in C.nearest(points, points, 3).where("id % 400 = 7").collect()}
    for i in range(7, 4000, 400):
        d = np.hypot(*(x - x[i]).T)
        d[i] = np.inf
        assert [got[i, n] for n in (1, 2, 3)] == np.argsort(d)[:3].tolist()


def test_kmer_set_sizes_over_all_letters():
    from clademill.operators.kernels import kmer_set_size

    for s in ("", "ACG", "ACGTACGTAC", "ABNCDEFNGHIJKL", "\0\0\0\0\0", "aé\U0001F600\U0001F600bcdaé\U0001F600\U0001F600N", "N" * 9, "Mitternacht im Wald" * 3):
        assert kmer_set_size(s, 4) == len({s[i : i + 4] for i in range(len(s) - 3) if "N" not in s[i : i + 4]}), s
