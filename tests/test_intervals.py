"""Overlap joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from clademill.operators import recombination as R
from clademill.operators.intervals import overlapping


def _frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"id bigint, start int, end int{extra}")


@pytest.mark.parametrize("wide", [1, 30, 5000])
def test_overlaps_equal_all_pairs(spark, wide):
    rng = random.Random(wide)

    def some(n):
        rows = [(i, s := rng.randint(-500, 500), s + rng.randint(0, wide)) for i in range(n)]
        return rows + [(n, 5, 4), (n + 1, None, 3), (n + 2, 3, None), (n + 3, 0, 0), (n + 4, -900, 900)]

    a, b = some(150), some(130)
    want = sorted((x, y) for x, s, e in a for y, t, f in b if None not in (s, e, t, f) and s <= e and t <= f and s <= f and t <= e)
    assert sorted(map(tuple, overlapping(_frame(spark, a), _frame(spark, b)).collect())) == want


def test_overlaps_within_keys(spark):
    rng = random.Random(2)
    rows = [(i, s := rng.randint(0, 300), s + rng.randint(0, 40), "ab"[i % 2]) for i in range(120)]
    frame = _frame(spark, rows, ", k string")
    want = sorted((x, y) for x, s, e, k in rows for y, t, f, j in rows if k == j and s <= f and t <= e)
    assert sorted(map(tuple, overlapping(frame, frame, ["k"]).collect())) == want


def test_many_intervals_meet_only_where_they_overlap(spark):
    a = spark.range(300_000).selectExpr("id", "id * 20 AS start", "id * 20 + 30 AS end")
    b = spark.range(100_000).selectExpr("id", "id * 60 AS start", "id * 60 + 5 AS end")
    met = overlapping(a, b)
    assert met.where("NOT (left * 20 <= right * 60 + 5 AND right * 60 <= left * 20 + 30)").isEmpty()
    plain = sum(1 for i in range(100_000) for x in range(max(0, (i * 60 - 30 + 19) // 20), min(299_999, (i * 60 + 5) // 20) + 1))
    assert met.count() == plain == met.distinct().count()


def test_features_of_many_genomes(spark, monkeypatch):
    rng = random.Random(5)
    events = spark.createDataFrame([(s := rng.randint(0, 400), s + rng.randint(0, 60), "x") for _ in range(80)] + [(900, 910, "x")], "start int, end int, ord string")
    features = spark.createDataFrame([(i, f"f{i % 40}", s := rng.randint(0, 400), s + rng.randint(0, 30)) for i in range(120)], "ord bigint, name string, start int, end int")
    want = sorted(map(tuple, R.feature_overlap(events, features).collect()))
    monkeypatch.setattr(R, "PACKED_FEATURES", 10)
    assert sorted(map(tuple, R.feature_overlap(events, features).collect())) == want


def test_compatible_pairs_equal_the_rule(spark):
    rng = random.Random(8)
    names = ["a", "b", "c", "d"]
    rows = [(i, sorted(rng.sample(names, rng.randint(2, 3))), s := rng.randint(0, 900), s + rng.randint(-5, 200)) for i in range(150)]
    frame = spark.createDataFrame(rows, "ord bigint, members array<string>, start int, end int")

    def agree(x, y):
        shorter = min(x[3] - x[2], y[3] - y[2])
        shared = max(0, min(x[3], y[3]) - max(x[2], y[2]))
        near = abs(x[2] - y[2]) <= 100 and abs(x[3] - y[3]) <= 100
        return len({*x[1]} & {*y[1]}) >= 2 and (shorter > 0 and shared >= 0.5 * shorter or near)

    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and agree(x, y))
    assert sorted(map(tuple, R.compatible_pairs(frame).collect())) == want
    assert R.compatible_pairs(frame.where(F.lit(False))).collect() == []
