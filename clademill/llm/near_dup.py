"""MinHash near-duplicates: bottom-k sketches, inverted lists, exact verification.

Every distinct shingle set keeps its ``k`` smallest hashes under one hash
function. Inverted lists over the rarest retained values generate overlaps,
the sketch of a pair's union estimates its similarity, and the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.llm.common import WordHashes, bounded, rolling, save, tidy, words_of
from clademill.llm.components import components

#: Retained values of a set.
SKETCH = 48
#: Least common values of two full sketches, of SKETCH: half, where 0.8 is expected to give 38.4 with a deviation of 2.8.
OVERLAP = 24
#: Lists up to this length give all their pairs at once; longer ones are compared to a pivot, and then tile by tile.
SHORT_LIST = 8
#: Sets of one side of a tile, and shingles that are multiplied at once.
TILE, COLUMNS = 512, 4096


def shingle_set(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word runs; fewer words are one run, none is the empty set."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(h) < width:
        return rolling(h, len(h)) >> np.uint64(1)
    return np.unique(rolling(h, width) >> np.uint64(1))


def _sets(docs: DataFrame, width: int, full: bool) -> DataFrame:
    """``(doc_id, n, node, values)``: all hashes, or the ``SKETCH`` smallest; ``node`` is a hash of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = batch.slice(part, 512)
                sets = [shingle_set(t.as_py(), hashes, width) for t in rows.column(1)]
                held = [s if full else s[:SKETCH] for s in sets]
                offsets = np.cumsum([0, *map(len, held)]).astype(np.int32)
                flat = np.concatenate([*held, np.zeros(0, np.uint64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ], names=["doc_id", "n", "node", "values"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n bigint, node bigint, values array<bigint>")


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose union's sketch shows at least ``OVERLAP / SKETCH`` common values."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("values").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sa"), batch.column("sb")
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.values.to_numpy(), y.values.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, n = np.unique(np.concatenate([xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]]), return_counts=True)
                keep[i] = (n[:SKETCH] == 2).sum() * SKETCH >= OVERLAP * min(SKETCH, len(u))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` on their full sets."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("values").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sa"), batch.column("sb")
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.values.to_numpy(), y.values.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def _lists(reps: DataFrame, percent: int) -> DataFrame:
    """Inverted lists ``(value, node, n, central)`` over the rarest retained values of each set.

    ``central`` is the mean number of sets that retain a value of the set.

    Two sketches of sizes s with ``o`` common values share one of the first
    ``s - o + 1`` in any common order; here rarer values come first, so values of
    boilerplate are indexed only where a set has little else.
    """
    values = reps.select("node", F.explode("values").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = values.join(shared, "value")
    own = W.partitionBy("node")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("df", "value"))).withColumns({"n_shared": F.count(F.lit(1)).over(own), "sum_df": F.sum("df").over(own)})
    sizes = reps.select("node", "n", F.size("values").alias("m"))
    rows = rows.join(sizes, "node").withColumn("central", (F.col("sum_df") - F.col("n_shared")) / F.col("m") + 1)
    # a set that fits its sketch, and its partners too, needs ceil(percent% of n) common values
    exact = F.col("n") * 100 <= F.lit(SKETCH * percent)
    needed = F.when(exact, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(OVERLAP))
    return rows.where(F.col("place") + F.col("m") - F.col("n_shared") <= F.col("m") - needed + 1).select("value", "node", "n", "central")


def _oriented(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a < b`` whose sizes allow the similarity; from columns x, nx, y, ny."""
    sizes = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    return pairs.where(sizes & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Links join sets with ``100 * intersection >= percent * union``; equal sets
    are one node. ``component_id`` is the smallest ``doc_id`` reached. Rows
    without words (null and empty texts too) are linked with nothing. A null
    ``doc_id`` has a null component and is kept. Rows of one id with different
    texts are each compared, with their own ``n_shingles``, and belong to one component.

    Long inverted lists are never expanded into pairs. Each is first compared to a
    pivot, its most central member, which lists of one group of copies have in
    common. What no link has joined to the pivot is compared with all members of
    the pivot's lists in tiles, on full sets inside a task, which gives out one
    row per linked set: no pair of a list is left out that could join two
    components, and no hot list is gathered in one task.
    """
    sketched = save(_sets(docs, width, full=False), "sketches")
    member = sketched.df.select("doc_id", "n", "node")
    able = sketched.df.where("n > 0 AND doc_id IS NOT NULL")
    # one row of each set, combined before the shuffle: copies have one sketch
    reps = save(able.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("values").alias("values")), "sketch-reps")
    firsts = reps.df.select("node", "rep")
    lists = save(_lists(reps.df, percent), "lists")
    pivot = F.max_by("node", F.struct("central", "node")).alias("pivot")
    stats = save(lists.df.groupBy("value").agg(F.count(F.lit(1)).alias("size"), pivot).where("size > 1"), "list-sizes")
    short = lists.df.join(stats.df.where(F.col("size") <= SHORT_LIST), "value")
    long = save(lists.df.join(stats.df.where(F.col("size") > SHORT_LIST), "value").select("pivot", "node", "n").distinct(), "long-lists")
    other = F.col("node").alias("y"), F.col("n").alias("ny")
    pairs = short.select("value", F.col("node").alias("x"), F.col("n").alias("nx")).join(short.select("value", *other), "value").where("x < y")
    sizes = reps.df.select(F.col("node").alias("x"), F.col("n").alias("nx"))
    to_pivot = long.df.select(F.col("pivot").alias("x"), *other).join(sizes, "x")
    pairs = pairs.select("x", "nx", "y", "ny").unionByName(to_pivot.select("x", "nx", "y", "ny"))
    candidates = save(_estimated(_oriented(pairs, percent), reps.df), "candidates")
    # full sets of all nodes that any list may still pair
    wanted = candidates.df.select(F.col("a").alias("node")).union(candidates.df.select("b")).union(long.df.select("node")).distinct()
    wanted = save(wanted.join(firsts, "node"), "wanted")
    ids, nodes = bounded(wanted.df.select(F.col("rep").alias("doc_id"))), bounded(wanted.df.select("node"))
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(ids, "doc_id", "left_semi")
    sets = _sets(texts, width, full=True).join(nodes, "node", "left_semi")
    sets = save(sets.dropDuplicates(["node"]).select("node", "values"), "sets")
    links = save(_verified(candidates.df, sets.df, percent), "links")
    found = components(links.df)
    more = save(_tiled(long.df, found.df, sets.df, percent), "tile-links")
    # rows of one id hold together
    least = able.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    least = save(least, "repeated")
    again = able.join(bounded(least.df), "doc_id").where("a != node").select("a", F.col("node").alias("b"))
    if not (more.df.isEmpty() and least.df.isEmpty()):
        found.drop()
        found = components(links.df.unionByName(more.df.toDF("a", "b")).unionByName(again))
    for table in (lists, stats, long, candidates, wanted, sets, links, more):
        table.drop()
    named = found.df.join(firsts, "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = named.join(smallest, "component").select("node", "smallest")
    answer = member.join(firsts.join(named, "node", "left"), "node", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", F.when(F.col("n") > 0, F.col("rep")), "doc_id"))
    return answer.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


def _tile_links(ids: np.ndarray, sets: list[np.ndarray], component: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest ids that links between the rows ``low`` and ``high`` lead them to.

    Intersections are products of 0/1 rows over the shingles that occur twice.
    """
    sizes = np.array([len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = times[code] > 1
    column, row = (np.cumsum(times > 1) - 1)[code[some]], np.repeat(np.arange(len(sets)), sizes)[some]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(low), len(high)), np.float32)
    for start in range(0, int((times > 1).sum()), COLUMNS):
        s, e = np.searchsorted(column, [start, start + COLUMNS])
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[row[s:e], column[s:e] - start] = 1
        common += ones[low] @ ones[high].T
    total = sizes[low][:, None] + sizes[high][None, :]
    x, y = np.nonzero((100 * common >= percent * (total - common)) & (component[low][:, None] != component[high][None, :]))
    i, j = low[x], high[y]
    label = ids.copy()
    while len(i):
        lower = label.copy()
        np.minimum.at(lower, i, label[j])
        np.minimum.at(lower, j, label[i])
        if (lower == label).all():
            break
        label = lower
    moved = label != ids
    return ids[moved], label[moved]


def _tiled(long: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, other)`` links between a pivot's members of different components."""
    comp = found.select(F.col("node").alias("node"), "component")
    rows = long.select("pivot", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    base = rows.where("node = pivot").select("pivot", F.col("component").alias("base"))
    rows = rows.join(base, "pivot").withColumn("open", F.col("component") != F.col("base"))
    counts = rows.groupBy("pivot").agg(F.count_if("open").alias("n_open"), F.count_if(~F.col("open")).alias("n_shut")).where("n_open > 0")
    rows = rows.join(counts, "pivot")
    n_open, n_shut = (F.ceil(F.col(c) / TILE).cast("int") for c in ("n_open", "n_shut"))
    own = F.xxhash64("node")
    tile = F.when(F.col("open"), F.pmod(own, n_open)).otherwise(n_open + F.pmod(own, n_shut)).cast("int")
    to = F.sequence(F.lit(0), F.when(F.col("open"), n_open + n_shut).otherwise(n_open) - 1)
    rows = rows.select("pivot", "node", "component", tile.alias("tile"), F.explode(to).alias("with"))
    keys = ["pivot", "row_tile", "col_tile"]
    rows = rows.select("pivot", F.least("tile", "with").alias("row_tile"), F.greatest("tile", "with").alias("col_tile"), "tile", "node", "component")
    spark = sets.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a number, or few rows of much work would be dealt to one task
    rows = rows.join(sets, "node").repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(part: pa.Table) -> Iterator[pa.RecordBatch]:
            tile = part.column("tile").to_numpy()
            low, high = (np.nonzero(tile == part.column(c)[0].as_py())[0] for c in ("row_tile", "col_tile"))
            if len(part) > 1 and len(low) and len(high):
                values = [v for c in part.column("values").chunks for v in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])]
                ids, other = _tile_links(part.column("node").to_numpy(), values, part.column("component").to_numpy(), low, high, percent)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(other)], names=["node", "other"])

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            k = np.array([table.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.nonzero((k[:, 1:] != k[:, :-1]).any(axis=0))[0] + 1).tolist(), len(table)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(s, e - s)
                if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in keys):
                    yield from links(pa.concat_tables(held))
                    held = []
                held.append(part)
        if held:
            yield from links(pa.concat_tables(held))

    return rows.mapInArrow(tidy(run), "node bigint, other bigint")


def near_dup_query(documents: DataFrame) -> DataFrame:
    """Contract rows of op1: four-word shingles."""
    return near_duplicates(documents, width=4, percent=80)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their group; columns as given."""
    gone = save(near_duplicates(docs, width, percent).where("NOT kept").select("doc_id").distinct(), "copies").df
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)
