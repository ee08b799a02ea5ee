"""Nearest neighbours in many dimensions against all pairs."""

import numpy as np
import pytest

from clademill.operators import metric


def _frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, vector array<double>").repartition(5)


def _all_pairs(q, x, k, own, start=0):
    out = {}
    for i, v in enumerate(q):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if own or start + i != j][:k]
        out[start + i] = [(int(j), float(d[j])) for j in order]
    return out


def _got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.id, r["rank"])):
        out.setdefault(r.id, []).append((r.other, r.d))
    return out


@pytest.mark.parametrize(("dim", "n", "tile"), [(64, 700, 1500), (64, 700, 40), (1024, 200, 1500), (2, 400, 30)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, dim, n, tile):
    monkeypatch.setattr(metric, "TILE", tile)
    rng = np.random.default_rng(dim + tile)
    centres = rng.normal(size=(8, dim)) * 3
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * rng.choice([0.01, 1.0], (n, 1))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all points are one point
    x = np.round(x, 3)
    points = _frame(spark, x)
    assert _got(metric.nearest_vectors(points, points, 7)) == _all_pairs(x, x, 7, False)
    asked = points.where("id % 50 = 0")
    want = {i: v for i, v in _all_pairs(x, x, 3, True).items() if i % 50 == 0}
    assert _got(metric.nearest_vectors(asked, points, 3, include_self=True)) == want


def test_fewer_points_than_neighbours_and_none(spark):
    x = np.array([[0.0, 0.0], [3.0, 4.0], [0.0, 1.0]])
    points = _frame(spark, x)
    assert _got(metric.nearest_vectors(points, points, 10)) == _all_pairs(x, x, 10, False)
    others = _frame(spark, x[:1], start=100)
    assert _got(metric.nearest_vectors(others, points, 10)) == {100: [(0, 0.0), (2, 1.0), (1, 5.0)]}
    assert metric.nearest_vectors(points, points.where("false"), 3).collect() == []
    assert metric.nearest_vectors(points.where("false"), points, 3).collect() == []


def test_far_cells_are_not_looked_into(spark):
    """Of well parted clusters a query meets about its own one."""
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(16) * 100, 60, axis=0) + rng.normal(size=(960, 16))
    p = _frame(spark, x).select(metric.F.col("id").alias("other"), "vector")
    pivots = metric._pivots(p, 960)
    dealt = metric._dealt(p, pivots, "bigint")
    cells = dealt.groupBy("cell").agg(metric.F.count("*").alias("n"), metric.F.min("r").alias("low"), metric.F.max("r").alias("high")).orderBy("cell").toPandas()
    bounds = _frame(spark, x).withColumn("bound", metric.F.lit(12.0))
    looks = metric._plan(bounds, pivots, cells, 5, "bigint", True).join(dealt.groupBy("cell").count(), "cell")
    assert looks.agg(metric.F.sum("count")).first()[0] < 960 * 70


def test_what_is_shuffled_grows_with_tiles_that_grow_too(spark, monkeypatch):
    """Tiles of 6,000 points, however many there were, sent each of 100,000 queries to 17 of them."""
    import pandas as pd

    seen = []
    tiled = metric._tiled
    monkeypatch.setattr(metric, "_tiled", lambda cells, pivots, rows: (seen.append(rows), tiled(cells, pivots, rows))[1])
    x = np.random.default_rng(4).normal(size=(120, 3))
    points = _frame(spark, x)
    monkeypatch.setattr(metric, "LEAST_ROWS", 10)
    assert _got(metric.nearest_vectors(points, points, 4)) == _all_pairs(x, x, 4, False)
    assert seen == [15]  # eight tiles of few points
    cells = pd.DataFrame({"cell": range(400), "n": 250, "low": 0.0, "high": 9.0})
    tile, told = tiled(cells, np.random.default_rng(1).normal(size=(400, 16)), max(2000, 100_000 // metric.LEAST_TILES))
    assert tile.max() < 9 and told["parts"].max() == 1 and metric.TILE >= 12_500


def test_distances_within_a_bound_need_no_order():
    """With a bound for each query no row of distances is partitioned, and what comes out is the same."""
    rng = np.random.default_rng(8)
    x, y = np.round(rng.normal(size=(300, 8)), 2), np.round(rng.normal(size=(500, 8)), 2)
    y[100:160] = y[0]
    d = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), 9)
    bound = np.sort(d, axis=1)[:, 5]
    own = np.full(300, -1)
    row, col, gap = metric._nearest_in(x, own, bound, y, 6)
    free = metric._nearest_in(x, own, np.full(300, np.inf), y, 6)
    assert all((a == b).all() for a, b in zip((row, col, gap), free, strict=True))
    order = [np.lexsort((np.arange(500), d[i]))[:6] for i in range(300)]
    assert (col.reshape(300, 6) == np.array(order)).all() and (gap.reshape(300, 6) == np.take_along_axis(d, np.array(order), 1)).all()


def test_neighbours_of_the_graph_are_found_once(spark):
    """The mean distance and the graph took a search each."""
    from pyspark.sql import functions as F

    from clademill.operators import layout

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    near = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 0, 2.0)], "id bigint, other bigint, d double").mapInArrow(counted, "id bigint, other bigint, d double")
    assert layout.fuzzy_graph(near).agg(F.count("*")).first()[0] == 2 and seen.value == 3
