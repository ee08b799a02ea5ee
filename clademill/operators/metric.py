"""Exact nearest neighbours in many dimensions, by pivots and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.plans.shared import checkpoint, partitions

#: Pivots at most, and the rows of a point tile and of a query tile that meet in one group, fewer where they hold more than ``TILE_VALUES``
#: or where there would be fewer than so many tiles, of at least so many rows. What is shuffled grows with the number of tiles.
PIVOTS, TILE, TILE_VALUES, LEAST_TILES, LEAST_ROWS = 512, 60_000, 1 << 22, 8, 2000
#: Distances that a task holds at once.
TOGETHER = 1 << 21
#: Distances are compared in this many decimals, so that equal ones are ties; bounds allow for it.
DECIMALS, SLACK = 9, 1e-8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, from differences, so that equal rows are at 0."""
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        out[i] = np.sqrt(((y - row) ** 2).sum(1))
    return out


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """About the square root of the points, spread over a bounded sample by hash of the id: each is the one farthest from those before."""
    many = int(min(PIVOTS, max(1, round(n**0.5))))
    found = points.select("vector").orderBy(F.xxhash64("other"), "other").limit(4 * many).collect()
    sample = np.unique(np.array([r.vector for r in found], float), axis=0)
    chosen, far = [0], _apart(sample[:1], sample)[0]
    while len(chosen) < many and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _apart(sample[chosen[-1:]], sample)[0])
    return sample[chosen]


def _dealt(points: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """``(other, vector, cell, r)``: each point with its nearest pivot and how far that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, 1024) for s in range(0, batch.num_rows, 1024)):
                d = _apart(_matrix(part.column(1), pivots.shape[1]), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["other", "vector", "cell", "r"])

    return points.mapInArrow(run, f"other {kind}, vector array<double>, cell int, r double")


def _plan(queries: DataFrame, pivots: np.ndarray, cells: pd.DataFrame, k: int, kind: str, bounded: bool, tile: np.ndarray | None = None) -> DataFrame:
    """``(id, vector, bound, cell, dp)``: the cells that a query has to look into, and its distance from their pivots.

    Without bounds yet, those nearest to it that hold ``k`` points; with them, all whose ring of
    distances from their pivot comes within the bound, but those looked into before. With ``tile``, the number of
    each cell's tile, ``(id, vector, bound, tile)`` instead: a query goes once to a tile, however many of its cells it needs.
    """
    if tile is not None:
        along = np.argsort(tile, kind="stable")
        names, heads = np.unique(tile[along], return_index=True)
    count, low, high = (cells[c].to_numpy() for c in ("n", "low", "high"))
    ids = cells["cell"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, 256) for s in range(0, batch.num_rows, 256)):
                d = _apart(_matrix(part.column(1), pivots.shape[1]), pivots[ids])
                order = np.argsort(d, axis=1, kind="stable")
                first = np.zeros(d.shape, bool)
                held = np.cumsum(count[order], axis=1)
                np.put_along_axis(first, order, (held - count[order]) < k, axis=1)
                if bounded:
                    bound = part.column(2).to_numpy(zero_copy_only=False)[:, None] + SLACK
                    near = (d - high <= bound) & (low - d <= bound)
                told = part.column(2) if bounded else pa.array(np.full(part.num_rows, np.inf))
                if tile is not None:
                    over = lambda cells: np.logical_or.reduceat(cells[:, along], heads, axis=1)
                    row, at_tile = np.nonzero(~over(first) & over(near) if bounded else over(first))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), told.take(at), pa.array(names[at_tile], pa.int32())], names=["id", "vector", "bound", "tile"])
                    continue
                row, cell = np.nonzero(~first & near if bounded else first)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), told.take(at), pa.array(ids[cell], pa.int32()), pa.array(d[row, cell])], names=["id", "vector", "bound", "cell", "dp"])

    return queries.mapInArrow(run, f"id {kind}, vector array<double>, bound double, " + ("cell int, dp double" if tile is None else "tile int"))


def _tiled(cells: pd.DataFrame, pivots: np.ndarray, rows: int) -> tuple[np.ndarray, pd.DataFrame]:
    """The tile of each cell, and ``(cell, tile, parts)``: cells near each other share a tile of about ``rows`` points, larger cells are split.

    Cells are taken along a chain of nearest pivots, a few hundred at most.
    """
    own = pivots[cells["cell"].to_numpy()]
    left, chain = np.ones(len(own), bool), [0]
    left[0] = False
    while left.any():
        chain.append(int(np.where(left, _apart(own[chain[-1:]], own)[0], np.inf).argmin()))
        left[chain[-1]] = False
    count, tile, held, now = cells["n"].to_numpy(), np.zeros(len(own), int), 0, 0
    for c in chain:
        if held and held + count[c] > rows:
            now, held = now + 1, 0
        tile[c] = now
        held += count[c]
    size = np.bincount(tile, count)
    return tile, pd.DataFrame({"cell": cells["cell"], "tile": tile, "parts": -(-size[tile] // rows)})


def _nearest_in(x: np.ndarray, own: np.ndarray, bound: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` and of ``y``, and their distances: of each row the ``k`` nearest within its bound; ``own`` is the place in ``y`` to leave out, or -1.

    A matrix product gives distances with a small error; what is within it of the k-th is compared exactly.
    """
    norm, rows, cols, gaps = (y * y).sum(1), [], [], []
    # in one product, with the norms as two more columns
    wide, step = np.column_stack([y, norm, np.ones(len(y))]).T, max(1, min(256, TOGETHER // max(1, len(y))))
    for s in range(0, len(x), step):
        q, most = x[s : s + step], bound[s : s + step]
        mine = (q * q).sum(1)
        square = np.column_stack([-2 * q, np.ones(len(q)), mine]) @ wide
        error = 1e-12 * (mine + norm.max())
        at = np.nonzero(own[s : s + step] >= 0)[0]
        square[at, own[s : s + step][at]] = np.inf
        far = most + SLACK
        near = square <= (far * far + error)[:, None]
        if not np.isfinite(most).all() or np.count_nonzero(near) > 64 * k * len(q):  # few are within a bound, and then the k-th need not be known
            kth = np.partition(square, k - 1, axis=1)[:, k - 1] if len(y) >= k else np.full(len(q), np.inf)
            far = np.minimum(np.sqrt(np.maximum(kth, 0) + error), most) + SLACK
            near = square <= (far * far + error)[:, None]
        row, col = np.nonzero(near & (square < np.inf))
        for e in range(0, len(row), 50_000):
            i, j = row[e : e + 50_000], col[e : e + 50_000]
            rows.append(s + i)
            cols.append(j)
            gaps.append(np.round(np.sqrt(((y[j] - q[i]) ** 2).sum(1)), DECIMALS))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    row, col, gap = np.concatenate(rows), np.concatenate(cols), np.concatenate(gaps)
    order = np.lexsort((col, gap, row))  # points are in the order of ids, which ties go by
    row, col, gap = row[order], col[order], gap[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < k
    return row[best], col[best], gap[best]


def _met(looks: DataFrame, tiles: DataFrame, parts: DataFrame, k: int, kind: str, rows: int, include_self: bool) -> DataFrame:
    """``(id, other, d)``: of each group of a query tile and a point tile, the ``k`` nearest of every query."""
    width = partitions(looks.sparkSession)
    asked = looks.join(F.broadcast(parts), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a tile's queries are split by hash too
    per = checkpoint(looks.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("asks")))
    asked = asked.join(F.broadcast(per), "tile").withColumn("ask", F.pmod(F.xxhash64("id"), F.col("asks")).cast("int")).select("tile", "part", "ask", "id", "vector", "bound")
    there = tiles.join(F.broadcast(per), "tile").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("tile", "part", "ask", "other", "vector")

    def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "other": [], "d": []})
        p = p.sort_values("other")
        ids, others = q["id"].to_numpy(), p["other"].to_numpy()
        own = np.full(len(ids), -1)
        if not include_self:
            at = np.minimum(np.searchsorted(others, ids), len(others) - 1)
            own = np.where(others[at] == ids, at, -1)
        row, col, gap = _nearest_in(np.stack(q["vector"].to_numpy()), own, q["bound"].to_numpy(), np.stack(p["vector"].to_numpy()), k)
        return pd.DataFrame({"id": ids[row], "other": others[col], "d": gap})

    keys = ["tile", "part", "ask"]
    return asked.repartition(width, *keys).groupBy(*keys).cogroup(there.repartition(width, *keys).groupBy(*keys)).applyInPandas(meet, f"id {kind}, other {kind}, d double")


def _first(met: DataFrame, k: int) -> DataFrame:
    return met.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("d", "other"))).where(F.col("rank") <= k)


def nearest_vectors(queries: DataFrame, points: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """``(id, other, d, rank)``: the ``k`` nearest points of every query by Euclidean distance, exactly.

    ``queries`` and ``points``: ``(id, vector)``, ids unique and not null, vectors of one length
    without nulls. Points go to the cell of their nearest pivot. A query first looks into the nearest
    cells that hold ``k`` points, which gives it a bound; then only into those cells whose distances from the pivot differ from its own
    by no more than the bound. Cells near each other share a tile, to which a query goes once, and those with
    many points or queries are split, so no group is larger than a tile of each, and where bounds leave nothing
    out, what is shuffled is a row for each query and tile of points. Ties,
    by nine decimals, go to the smaller id. Of all points only counts and radii of the cells
    and a bounded sample of pivots reach the driver.
    """
    kind = points.schema["id"].dataType.simpleString()
    p = points.select(F.col("id").alias("other"), F.col("vector").cast("array<double>").alias("vector"))
    q = checkpoint(queries.select("id", F.col("vector").cast("array<double>").alias("vector")))
    n = p.count()
    if not n or q.isEmpty() or k < 1:
        return q.select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"), F.lit(0).alias("rank")).where("false")
    pivots = _pivots(p, n)
    dealt = checkpoint(_dealt(p, pivots, kind))
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    cells = sizes.orderBy("cell").toPandas()  # one row for each pivot
    rows = max(1, min(TILE, TILE_VALUES // max(1, pivots.shape[1]), max(LEAST_ROWS, -(-n // LEAST_TILES))))
    tile, told = _tiled(cells, pivots, rows)
    told = dealt.sparkSession.createDataFrame(told.astype(int), "cell int, tile int, parts int")
    tiles = dealt.join(F.broadcast(told), "cell").withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int")).select("tile", "part", "other", "vector")
    parts = told.select("tile", "parts").distinct()
    own = 0 if include_self else 1  # a query may meet itself among the nearest
    begun = checkpoint(_met(_plan(q, pivots, cells, k + own, kind, False, tile), tiles, parts, k, kind, rows, include_self))
    kth = _first(begun, k).groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounds = q.join(kth, "id", "left").select("id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    rest = _met(_plan(bounds, pivots, cells, k + own, kind, True, tile), tiles, parts, k, kind, rows, include_self)
    return _first(begun.unionByName(rest), k).select("id", "other", "d", "rank")
