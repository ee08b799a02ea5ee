"""UMAP by rounds over the edge table of a neighbour graph: memberships, a start from landmarks, blocks of the plane."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.operators.kernels import _curve, umap
from clademill.operators.metric import nearest_vectors
from clademill.plans.shared import checkpoint, forget, partitions

#: Rows of the bounded sample, by hash of the id, whose own embedding is the start, and the landmarks that place another row.
LANDMARKS, GUIDES = 1000, 3
#: Points that a block of the plane holds about, and places that a round draws its repulsion from.
BLOCK, FAR = 4000, 4000
#: Rounds, and the epochs of descent that a block goes on alone within a round.
ROUNDS, EPOCHS = 10, 20
#: Repulsions for each attraction, and halvings in the search for a bandwidth.
NEGATIVES, HALVINGS = 5, 64


def _bandwidth(ds: Column, rho: Column, count: Column) -> Column:
    """The sigma for which ``sum(exp(-max(d - rho, 0) / sigma))`` is the logarithm of the count, by halving."""
    target = F.when(count > 1, F.log2(count.cast("double"))).otherwise(0.5)
    inf = F.lit(float("inf"))

    def step(s: Column, _: Column) -> Column:
        total = F.aggregate(ds, F.lit(0.0), lambda t, d: t + F.exp(-F.greatest(d - rho, F.lit(0.0)) / s.sigma))
        high, low = F.when(total > target, s.sigma).otherwise(s.high), F.when(total > target, s.low).otherwise(s.sigma)
        return F.struct(low.alias("low"), high.alias("high"), F.when(high == inf, s.sigma * 2).otherwise((low + high) / 2).alias("sigma"))

    first = F.struct(F.lit(0.0).alias("low"), inf.alias("high"), F.lit(1.0).alias("sigma"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), first, step).sigma


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """``(src, dst, w)`` with ``src < dst``: the fuzzy union of the memberships of neighbours ``(id, other, d)``.

    A neighbour's membership falls with its distance beyond the nearest positive one, by the bandwidth that
    makes a row's memberships add up to the logarithm of their count; bandwidths are at least a thousandth of the
    mean distance. The union of both directions is ``p + q - p q``. A group is one row's neighbours.
    The neighbours are needed twice, and are found once.
    """
    near = checkpoint(near.select("id", "other", "d"))
    mean = near.agg(F.avg("d")).first()[0] or 0.0
    held = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "d"))).alias("near"))
    held = held.withColumn("ds", F.transform("near", lambda e: e.d))
    held = held.withColumn("rho", F.coalesce(F.array_min(F.filter("ds", lambda d: d > 0)), F.lit(0.0)))
    held = held.withColumn("sigma", F.greatest(_bandwidth(F.col("ds"), F.col("rho"), F.size("ds")), F.lit(1e-3 * max(mean, 1e-12))))
    rows = held.select("id", "rho", "sigma", F.explode("near").alias("e"))
    p = F.exp(-F.greatest(F.col("e.d") - F.col("rho"), F.lit(0.0)) / F.col("sigma"))
    rows = rows.select(F.least("id", "e.other").alias("src"), F.greatest("id", "e.other").alias("dst"), p.alias("p"))
    both = rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"), F.max("p").alias("q"))
    w = F.when(F.col("n") == 1, F.col("q")).otherwise(F.col("p") + F.col("q") - F.col("p") * F.col("q"))
    return both.select("src", "dst", w.alias("w")).where("w > 0")


def _noise(seed: int, axis: int) -> Column:
    """A small number by hash of the id, so that no two rows are in one place."""
    return (F.pmod(F.xxhash64("id", F.lit(2 * seed + axis)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 0.01


def landmark_start(items: DataFrame, neighbors: int, min_dist: float, spread: float = 1.0, seed: int = 42, landmarks: int = LANDMARKS) -> DataFrame:
    """``(id, x, y)``: a bounded sample is embedded by itself, in one task; every row then stands among its nearest landmarks."""
    kind = items.schema["id"].dataType.simpleString()
    sample = checkpoint(items.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(landmarks))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        xy = umap(np.vstack(frame["vector"].to_numpy()), neighbors, min_dist, spread, seed)
        return pd.DataFrame({"id": frame["id"], "x": xy[:, 0], "y": xy[:, 1]})

    placed = checkpoint(sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, f"id {kind}, x double, y double"))
    # a landmark is its own first guide, at distance 0, and stays where it is
    guides = nearest_vectors(items, sample, GUIDES, include_self=True).join(F.broadcast(placed.toDF("other", "gx", "gy")), "other")
    weight = 1 / (F.col("d") + 1e-9)
    own = guides.groupBy("id").agg((F.sum(weight * F.col("gx")) / F.sum(weight)).alias("x"), (F.sum(weight * F.col("gy")) / F.sum(weight)).alias("y"))
    return own.select("id", (F.col("x") + _noise(seed, 0)).alias("x"), (F.col("y") + _noise(seed, 1)).alias("y"))


def _blocks(places: DataFrame, count: int, rows: int, flip: bool) -> DataFrame:
    """``places`` with ``block``: slabs of one axis cut along the other at quantiles, of about ``rows`` points each.

    Rounds take turns in which axis is cut first, so the rims of one round lie inside blocks of the next.
    """
    side = max(1, math.ceil(math.sqrt(count / rows)))
    if side == 1:
        return places.withColumn("block", F.lit(0))
    first, second = ("y", "x") if flip else ("x", "y")
    shares = F.array(*(F.lit(i / side) for i in range(1, side)))
    cuts = places.agg(F.percentile_approx(first, shares, 10_000).alias("cuts"))
    beyond = lambda c: F.size(F.filter("cuts", lambda q: q < F.col(c)))
    slabs = places.crossJoin(F.broadcast(cuts)).withColumn("slab", beyond(first)).drop("cuts")  # one row of cuts
    across = slabs.groupBy("slab").agg(F.percentile_approx(second, shares, 10_000).alias("cuts"))  # one row a slab
    return slabs.join(F.broadcast(across), "slab").withColumn("block", F.col("slab") * side + beyond(second)).drop("slab", "cuts")


def _descent(far: Broadcast, n: int, first: int, last: int, whole: int, heaviest: float, a: float, b: float, seed: int):
    """The epochs ``first`` to ``last`` of one block, as a function of its points and of their edges with the other ends' places."""

    def move(own: pd.DataFrame, pulled: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id").reset_index(drop=True)
        ids, y = own["id"].to_numpy(), own[["x", "y"]].to_numpy(float)
        others, away = far.value
        pulled = pulled.sort_values(["src", "dst"])
        at = pd.Index(ids)
        s, t = at.get_indexer(pulled["src"]), at.get_indexer(pulled["dst"])
        outside = t < 0
        t[outside] = len(y) + np.arange(outside.sum())
        fixed = np.concatenate([pulled.loc[outside, ["tx", "ty"]].to_numpy(float), away])
        # of the sample, the block's own points push from where they are now
        pushes = at.get_indexer(others)
        pushes = np.where(pushes >= 0, pushes, len(y) + len(fixed) - len(away) + np.arange(len(away)))
        often = pulled["w"].to_numpy(float) / heaviest
        rng = np.random.default_rng([seed, n, int(own["block"].iloc[0])])
        for e in range(first, last):
            on = np.floor((e + 1) * often) > np.floor(e * often)
            i, j = s[on], t[on]
            places = np.concatenate([y, fixed])
            delta = y[i] - places[j]
            q = (delta * delta).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(q > 0, -2 * a * b * q ** (b - 1) / (1 + a * q**b), 0.0)
            step = 2 * np.clip(pull[:, None] * delta, -4, 4)  # an edge is in the table once for each end, and either row pulls at both
            for _ in range(NEGATIVES):
                delta = y[i] - places[pushes[rng.integers(0, len(pushes), len(i))]]
                q = (delta * delta).sum(1)
                step += np.clip((2 * b / ((0.001 + q) * (1 + a * q**b)))[:, None] * delta, -4, 4)
            moved = np.column_stack([np.bincount(i, step[:, c], len(y)) for c in (0, 1)])
            y = y + (1 - e / whole) * np.clip(moved, -4, 4)
        return pd.DataFrame({"id": ids, "x": y[:, 0], "y": y[:, 1]})

    return move


def layout(edges: DataFrame, start: DataFrame, min_dist: float, spread: float = 1.0, seed: int = 42, rounds: int = ROUNDS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """``(id, x, y)``: places after rounds of sampled descent over ``edges`` ``(src, dst, w)``, from ``start`` ``(id, x, y)``.

    In a round every block of the plane has its points, their edges and the other ends' places: ends in
    the block move, those outside stay until the next round. An edge pulls in every ``max(w) / w``-th epoch;
    points are pushed off points drawn from a bounded sample of all, which changes with the round and whose
    members in the block move too. A task holds about
    ``block`` points and their edges; a round shuffles the edges and the places, once each.
    """
    a, b = _curve(spread, min_dist)
    kind = start.schema["id"].dataType.simpleString()
    spark = start.sparkSession
    turn = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    both = checkpoint(edges.where("src != dst AND w > 0").select(turn, "w").select("e.src", "e.dst", "w"))
    heaviest = both.agg(F.max("w")).first()[0]
    now = checkpoint(start)
    count, width = now.count(), partitions(spark)
    if not heaviest or count < 3:
        return now
    whole = rounds * epochs
    for n in range(rounds):
        placed = checkpoint(_blocks(now, count, block, n % 2 == 1))
        sample = placed.orderBy(F.xxhash64("id", F.lit(seed + n)), "id").limit(FAR).toPandas()
        far = sample["id"].to_numpy(), sample[["x", "y"]].to_numpy(float)
        there = placed.select(F.col("id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        here = placed.select(F.col("id").alias("src"), F.col("block").alias("part"))
        pulls = both.join(here, "src").join(there, "dst").select("part", "src", "dst", "w", "tx", "ty")
        move = _descent(spark.sparkContext.broadcast(far), n, n * epochs, (n + 1) * epochs, whole, heaviest, a, b, seed)
        own = placed.repartition(width, "block").groupBy("block").cogroup(pulls.repartition(width, "part").groupBy("part"))
        after = checkpoint(own.applyInPandas(move, f"id {kind}, x double, y double"))
        forget(placed, now)
        now = after
    forget(both)
    return now


def embed(items: DataFrame, neighbors: int, min_dist: float, spread: float = 1.0, seed: int = 42, landmarks: int = LANDMARKS, block: int = BLOCK) -> DataFrame:
    """``(id, x, y)``: an embedding in the plane of ``items`` ``(id, vector)``, ids unique, vectors of one length.

    Neighbours are exact (:func:`nearest_vectors`), and the graph is an edge table; nothing is of size n times n,
    and only bounded samples are in one task. Equal vectors are one point and share its place, so that copies,
    however many, are no hub. A row without a vector has no place. Fewer than three different
    vectors stand in a row.
    """
    items = items.select("id", F.col("vector").cast("array<double>").alias("vector"))
    points = checkpoint(items.where("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"))
    n = points.count()
    if n < 3:
        rank = {r.id: float(k) for k, r in enumerate(points.orderBy("id").collect())}
        kind = items.schema["id"].dataType.simpleString()
        places = items.sparkSession.createDataFrame([(i, v, v) for i, v in rank.items()], f"id {kind}, x double, y double")
    else:
        edges = checkpoint(fuzzy_graph(nearest_vectors(points, points, max(1, min(neighbors, n - 1)))))
        places = layout(edges, landmark_start(points, neighbors, min_dist, spread, seed, landmarks), min_dist, spread, seed, block=block)
    shared = places.join(points, "id").select("vector", "x", "y")
    return items.join(shared, "vector", "left").select("id", "x", "y")
