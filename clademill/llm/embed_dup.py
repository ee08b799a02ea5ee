"""Embedding near-duplicates by spherical-cap filters.

A structured random product code: the rotated space is split into blocks, each
with its own small codebook of directions, and every combination of one direction
per block is a filter. A vector is list-decoded to all filters whose direction it
exceeds; vectors that meet in a filter are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import bounded, save, tidy
from clademill.llm.components import components

#: Rows of one filter that are compared as a block; larger filters are tiled.
TILE = 512
#: Filters of up to so many vectors are compared together with others.
FEW = 16
#: Deviations below a vector's best filter that always count.
MARGIN = 0.3


def book_size(dim: int) -> int:
    """Directions of a block's codebook: fewer in few dimensions, where they lie closer, so that a vector has 40 to 130 filters in any."""
    return min(2048, 1 << (dim + 4 if dim < 8 else dim // 8 + 4))


@dataclass(frozen=True)
class CapCode:
    """``codes`` product codes of ``size ** blocks`` filters each; each direction is a unit vector.

    ``level`` is the least inner product, in deviations ``1 / sqrt(dim)`` of a
    random direction's. With the defaults a vector has about 85 filters, an
    unrelated vector exceeds one of them with a chance of 3.4e-6 a filter, and a
    pair at cosine 0.9 is expected to share a quarter of its filters. Several
    codes, each with its own rotation, even out how many filters vectors get.
    """

    dim: int
    codes: int = 6
    blocks: int = 2
    size: int = 2048
    level: float = 4.5
    seed: int = 7

    @cached_property
    def _parts(self) -> list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        rng = np.random.default_rng(self.seed)
        cuts = np.array_split(np.arange(self.dim), max(1, min(self.blocks, self.dim // 4)))
        parts = []
        for _ in range(self.codes):
            rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
            books = []
            for c in cuts:
                d = rng.standard_normal((self.size, len(c)))
                books.append((d / np.linalg.norm(d, axis=1, keepdims=True) * math.sqrt(len(c) / self.dim)).astype(np.float32))
            parts.append((rotation, cuts, books))
        return parts

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the sorted ids of all filters it exceeds.

        Blocks are joined one by one; a partial sum is dropped once the best of the
        remaining blocks cannot lift it to the level, so no filter is missed. In a
        code whose best filter is below ``level + MARGIN``, all within ``MARGIN``
        of the best are taken instead, so that no vector is left with few.
        """
        out: list[list[np.ndarray]] = [[] for _ in unit]
        least = self.level / math.sqrt(self.dim)
        for number, (rotation, cuts, books) in enumerate(self._parts):
            turned = (unit @ rotation).astype(np.float32)
            scores = [turned[:, c] @ b.T for c, b in zip(cuts, books, strict=True)]
            best = np.array([s.max(axis=1) for s in scores])
            for i in range(len(unit)):
                goal = min(least, float(best[:, i].sum()) - MARGIN / math.sqrt(self.dim))
                ids, sums = np.zeros(1, np.int64), np.zeros(1, np.float32)
                for k, s in enumerate(scores):
                    need = goal - best[k + 1 :, i].sum()
                    own = np.nonzero(s[i] >= need - sums.max())[0]
                    total = sums[:, None] + s[i][own][None, :]
                    keep = np.nonzero(total >= need)
                    ids, sums = ids[keep[0]] * self.size + own[keep[1]], total[keep]
                out[i].append(ids + number * self.size ** len(cuts))
        return [np.sort(np.concatenate(x)) for x in out]


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Double vectors; None where null, empty, zero, or with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in column:
        if not v.is_valid or v.values is None or len(v.values) == 0 or v.values.null_count:
            out.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        out.append(None if not np.isfinite(x).all() or top == 0 else x / top / np.linalg.norm(x / top))
    return out


def _normal(flat: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Double unit vectors of vectors one after the other."""
    flat = flat.astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(dims)[:-1]])
    flat /= np.repeat(np.maximum.reduceat(np.abs(flat), starts), dims)
    return flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), dims)


def _kind(rows: DataFrame) -> type:
    """The number that vectors travel as: single precision where they come in it, so that they take half the room."""
    return np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64


def _units(rows: DataFrame) -> DataFrame:
    """``(vec_id, node, unit)``; node, a hash of the unit vector, and unit, the vector as it is, are null for vectors that link with nothing."""
    kind = _kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _vectors(batch.column(1))
            nodes = [None if u is None else xxhash.xxh3_64_intdigest(u.tobytes()) >> 1 for u in units]
            raw = [None if u is None else v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for u, v in zip(units, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "node", "unit"])

    return rows.select("vec_id", "embedding").mapInArrow(tidy(run), "vec_id bigint, node bigint, unit binary")


def _filters(units: DataFrame, level: float, kind: type) -> DataFrame:
    """``(dim, cap, node, copies)``: each distinct vector under each of its filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, CapCode] = {}
        for batch in batches:
            raw = batch.column("unit").to_pylist()
            dims = np.array([len(r) // np.dtype(kind).itemsize for r in raw])
            for dim in np.unique(dims):
                own = np.nonzero(dims == dim)[0]
                code = codes.setdefault(int(dim), CapCode(int(dim), size=book_size(int(dim)), level=level))
                caps = code.decode(_normal(np.frombuffer(b"".join(raw[i] for i in own), kind), dims[own]).reshape(len(own), dim))
                at = pa.array(np.repeat(own, [len(c) for c in caps]), pa.int64())
                ids = batch.column("node").take(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(np.concatenate(caps)), ids, batch.column("copies").take(at)], names=["dim", "cap", "node", "copies"])

    return units.mapInArrow(tidy(run), "dim int, cap bigint, node bigint, copies bigint")


def _compared(tiles: DataFrame, cosine: float, number: type) -> DataFrame:
    """``(node, other, links)`` for tiles sorted together: degrees in a tile and spanning links.

    ``tiles``: ``(dim, cap, row_tile, col_tile, tile, node, copies, caps, unit)``, with
    the vector's shared filters before ``cap``. A pair counts in the smallest filter that both are decoded to, so degrees of
    different tiles add up; ``other`` is the smallest vector that links of the tile lead to.
    """

    def one(rows: dict[str, np.ndarray], units: np.ndarray, caps: list[np.ndarray]) -> tuple | None:
        tile, ids, copies = rows["tile"], rows["node"], rows["copies"]
        low, high = tile == rows["row_tile"], tile == rows["col_tile"]
        same = rows["row_tile"][0] == rows["col_tile"][0]
        a, b = np.nonzero(low)[0], np.nonzero(high)[0]
        hit = units[a] @ units[b].T >= cosine
        if same:
            np.fill_diagonal(hit, False)
        x, y = np.nonzero(hit)
        if not len(x):
            return None
        # earlier filters in common, by products of 0/1 membership rows
        near = np.unique(np.concatenate([a[x], b[y]]))
        early = [caps[i] for i in near]
        known, code, times = np.unique(np.concatenate(early), return_inverse=True, return_counts=True)
        if (times > 1).any():
            column = np.cumsum(times > 1) - 1
            some = times[code] > 1
            member = np.zeros((len(near), int((times > 1).sum())), np.float32)
            member[np.repeat(np.arange(len(near)), [len(e) for e in early])[some], column[code[some]]] = 1
            place = np.full(len(ids), -1)
            place[near] = np.arange(len(near))
            first = (member @ member.T == 0)[place[a[x]], place[b[y]]]
            x, y = x[first], y[first]
            if not len(x):
                return None
        i, j = a[x], b[y]
        degree = np.bincount(i, copies[j], minlength=len(ids))
        if not same:
            degree += np.bincount(j, copies[i], minlength=len(ids))
        label = ids.copy()
        while True:  # the smallest id that each vector reaches inside the tile
            low_label = label.copy()
            np.minimum.at(low_label, i, label[j])
            np.minimum.at(low_label, j, label[i])
            if (low_label == label).all():
                break
            label = low_label
        some = np.nonzero(degree > 0)[0]
        return ids[some], label[some], degree[some].astype(np.int64)

    def small(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> tuple | None:
        """All groups of one tile with itself and few rows at once: their pairs, hits, and hits whose filter is the pair's first."""
        # row numbers of all pairs i < j of a group
        place = np.concatenate([np.arange(n) for n in sizes])
        first = np.repeat(starts, sizes) + place
        after = np.repeat(sizes, sizes) - place - 1
        i = np.repeat(first, after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        if not len(i):
            return None
        unit = table.column("unit").combine_chunks()
        dims = table.column("dim").to_numpy()
        raw = _normal(np.frombuffer(b"".join(unit.to_pylist()), number), dims)
        offset = np.concatenate([[0], np.cumsum(dims)])
        hit = np.zeros(len(i), bool)
        for dim in np.unique(dims[i]):
            of = np.nonzero(dims[i] == dim)[0]
            span = np.arange(dim)
            for part in np.array_split(of, max(1, len(of) * int(dim) // 4_000_000)):
                hit[part] = np.einsum("ij,ij->i", raw[offset[i[part]][:, None] + span], raw[offset[j[part]][:, None] + span]) >= cosine
        i, j = i[hit], j[hit]
        if not len(i):
            return None
        caps = table.column("caps").combine_chunks()
        at, values = caps.offsets.to_numpy(), caps.values.to_numpy()
        held = {k: values[at[k] : at[k + 1]] for k in np.unique(np.concatenate([i, j])).tolist()}
        new = np.array([not len(np.intersect1d(held[x], held[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[new], j[new]
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        return np.concatenate([ids[i], ids[j]]), np.concatenate([np.minimum(ids[i], ids[j])] * 2), np.concatenate([copies[j], copies[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        keys = ["dim", "cap", "row_tile", "col_tile"]

        def groups(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            out, size = [], np.diff(bounds)
            few = (size > 1) & (size <= FEW) & (table.column("row_tile").to_numpy()[bounds[:-1]] == table.column("col_tile").to_numpy()[bounds[:-1]])
            if few.any():
                out.append(small(table, bounds[:-1][few], size[few]))
            for s, e in zip(bounds[:-1][~few & (size > 1)], bounds[1:][~few & (size > 1)], strict=True):
                part = table.slice(s, e - s).combine_chunks()
                rows = {n: part.column(n).to_numpy() for n in ("tile", "row_tile", "col_tile", "node", "copies")}
                units = _normal(np.frombuffer(b"".join(part.column("unit").to_pylist()), number), part.column("dim").to_numpy()).reshape(e - s, -1)
                out.append(one(rows, units, [np.array(c, np.int64) for c in part.column("caps").to_pylist()]))
            out = [x for x in out if x is not None and len(x[0])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "other", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            k = np.array([table.column(c).to_numpy() for c in keys])
            cut = np.nonzero((k[:, 1:] != k[:, :-1]).any(axis=0))[0] + 1
            bounds = np.concatenate([[0], cut])
            yield from groups(table.slice(0, int(bounds[-1])).combine_chunks(), bounds)
            held = table.slice(int(bounds[-1]))
        if held is not None:
            yield from groups(held.combine_chunks(), np.array([0, held.num_rows]))

    return tiles.mapInArrow(tidy(run), "node bigint, other bigint, links bigint")


def near_vectors(rows: DataFrame, cosine: float = 0.9, level: float = 4.5) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row ``(vec_id, embedding)``.

    Equal directions are compared once and counted with their copies. Vectors of
    different length are not compared. Vectors that are null, empty or zero, or
    hold null or non-finite components, link with nothing. ``component_id`` is the
    smallest ``vec_id`` reached; rows of a null id have none and are kept. Rows of one id
    each have their own ``n_links``, among which equal vectors of that id count, and
    belong to one component. Filters with more than ``TILE`` vectors are compared tile
    by tile, each pair of tiles on its own, so no filter is gathered in one task.
    """
    units = save(_units(rows), "units").df
    valid = units.where("node IS NOT NULL AND vec_id IS NOT NULL")
    # one row of each direction, combined before the shuffle
    firsts = save(valid.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "directions").df
    caps = save(_filters(firsts.select("node", "copies", "unit"), level, _kind(rows)), "caps")
    sizes = caps.df.groupBy("dim", "cap").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = save(caps.df.join(sizes, ["dim", "cap"]), "shared-caps")  # filters of one vector are done with
    tiled = met.df.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # every tile meets itself and each other tile once
    to = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with")
    pairs = tiled.select("dim", "cap", "tile", "node", "copies", to)
    pairs = pairs.select("dim", "cap", F.least("tile", "with").alias("row_tile"), F.greatest("tile", "with").alias("col_tile"), "tile", "node", "copies")
    own = met.df.groupBy("node").agg(F.sort_array(F.collect_list("cap")).alias("caps"))
    carried = own.join(firsts.select("node", "unit"), "node")
    keys = ["dim", "cap", "row_tile", "col_tile"]
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a vector comes with its shared filters before the tile's, which is all that telling a pair's first filter takes
    tiles = pairs.join(carried, "node").withColumn("caps", F.filter("caps", lambda c: c < F.col("cap"))).repartition(parts, *keys).sortWithinPartitions(*keys)
    found = save(_compared(tiles, cosine, _kind(rows)), "vector-links").df
    for table in (caps, met):
        table.drop()
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    # rows of one id hold together
    least = save(valid.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("vec_id", "a"), "repeated").df
    again = valid.join(bounded(least), "vec_id").where("a != node").select("node", F.col("a").alias("other"))
    linked = components(found.select("node", "other").unionByName(again)).df.join(firsts.select("node", "rep"), "node")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("smallest"))
    linked = linked.join(smallest, "component").select("node", "smallest")
    told = firsts.select("node", "rep", "copies").join(degree, "node", "left").join(linked, "node", "left")
    out = units.select("vec_id", "node").join(told, "node", "left")
    whole = F.when(F.col("vec_id").isNotNull(), F.coalesce("smallest", "rep", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).otherwise(0)
    return out.select("vec_id", links.cast("bigint").alias("n_links"), whole.alias("component_id"), F.coalesce(F.col("vec_id") == whole, F.lit(True)).alias("kept"))


def embed_dup_query(embeddings: DataFrame) -> DataFrame:
    """Contract rows of op5."""
    return near_vectors(embeddings.select("vec_id", "embedding"))
