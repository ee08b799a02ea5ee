"""Cluster tables: sizes, labels, votes, agreement, references, graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.functions.sequence import cluster_order
from clademill.operators import kernels
from clademill.plans.shared import checkpoint, forget


def size_metrics(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: count, largest and its share, singletons, clusters of ten and fewer, members."""
    c = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("cluster_count"), F.max("n").alias("largest"), (100.0 * F.max("n") / F.sum("n")).alias("largest_pct"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") <= 10).alias("small_le_10"), F.sum("n").alias("members"))


def percentages(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    c = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("genomes"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("genomes").alias("_t")))).select(cluster, "genomes", (100.0 * F.col("genomes") / F.col("_t")).alias("pct_genomes"))


def centroids(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    return points.groupBy(cluster).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))


def first_seen_labels(rows: DataFrame, raw: str, prefix: str, width: int) -> DataFrame:
    """``(raw, label)``: labels numbered by first appearance along ``ord``; numbers wider than ``width`` are not cut."""
    first = rows.groupBy(raw).agg(F.min("ord").alias("first"))
    n = F.row_number().over(W.orderBy("first"))  # one row per label
    return first.select(raw, F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.lit(width), F.length(n.cast("string"))), F.lit("0"))).alias("label"))


def contingency(rows: DataFrame, u: str, v: str) -> DataFrame:
    """One row of pair-count and entropy sums of two labellings; nulls are left out."""
    n = rows.where(F.col(u).isNotNull() & F.col(v).isNotNull()).groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    logs = lambda c: F.sum(F.col(c) * F.ln(c))
    a = n.agg(F.sum("n").alias("total"), pairs("n").alias("p"), logs("n").alias("l"))
    bu = n.groupBy("u").agg(F.sum("n").alias("n")).agg(pairs("n").alias("pu"), logs("n").alias("lu"), F.count(F.lit(1)).alias("ku"))
    bv = n.groupBy("v").agg(F.sum("n").alias("n")).agg(pairs("n").alias("pv"), logs("n").alias("lv"), F.count(F.lit(1)).alias("kv"))
    return a.crossJoin(bu).crossJoin(bv)  # single rows


def nmi(rows: DataFrame, u: str, v: str) -> DataFrame:
    """Mutual information over the mean entropy; 1 where both have one class."""
    c = contingency(rows, u, v).withColumns({"hu": F.ln("total") - F.col("lu") / F.col("total"), "hv": F.ln("total") - F.col("lv") / F.col("total"), "hj": F.ln("total") - F.col("l") / F.col("total")})
    mi = F.col("hu") + F.col("hv") - F.col("hj")
    return c.select(F.when((F.col("ku") == 1) & (F.col("kv") == 1), 1.0).when(F.abs(mi) < 1e-15, 0.0).otherwise(2 * mi / (F.col("hu") + F.col("hv"))).alias("nmi"))


def ari(rows: DataFrame, u: str, v: str) -> DataFrame:
    """Rand index adjusted for chance; 1 for equal partitions."""
    c = contingency(rows, u, v).withColumn("all", F.col("total") * (F.col("total") - 1) / 2.0)
    expected = F.when(F.col("all") > 0, F.col("pu") * F.col("pv") / F.col("all")).otherwise(0.0)
    high = (F.col("pu") + F.col("pv")) / 2
    return c.select(F.when(high == expected, 1.0).otherwise((F.col("p") - expected) / (high - expected)).alias("ari"))


def grouped_scores(rows: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    """``(keys, u_count, v_count, items, nmi, ari)`` of two labellings in every group, from one contingency table."""
    n = rows.where(F.col(u).isNotNull() & F.col(v).isNotNull()).groupBy(*keys, F.col(u).alias("_u"), F.col(v).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    pairs, logs = F.sum(F.col("n") * (F.col("n") - 1) / 2.0), F.sum(F.col("n") * F.ln("n"))
    side = lambda c, k: n.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(pairs.alias(f"p{k}"), logs.alias(f"l{k}"), F.count(F.lit(1)).alias(f"{k}_count"))
    j = n.groupBy(*keys).agg(F.sum("n").alias("items"), pairs.alias("p"), logs.alias("l")).join(side("_u", "u"), keys).join(side("_v", "v"), keys)
    hu, hv, hj = (F.ln("items") - F.col(c) / F.col("items") for c in ("lu", "lv", "l"))
    mi = hu + hv - hj
    score = F.when((F.col("u_count") == 1) & (F.col("v_count") == 1), 1.0).when(F.abs(mi) < 1e-15, 0.0).otherwise(2 * mi / (hu + hv))
    all_pairs = F.col("items") * (F.col("items") - 1) / 2.0
    expected = F.when(all_pairs > 0, F.col("pu") * F.col("pv") / all_pairs).otherwise(0.0)
    high = (F.col("pu") + F.col("pv")) / 2
    adjusted = F.when(high == expected, 1.0).otherwise((F.col("p") - expected) / (high - expected))
    return j.select(*keys, "u_count", "v_count", "items", score.alias("nmi"), adjusted.alias("ari"))


def agreement(rows: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """``(left, right, nmi)`` of every pair of labelling columns, in one grouped query."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.col(a).cast("string").alias("u"), F.lit(b).alias("right"), F.col(b).cast("string").alias("v")) for a in left for b in right])).alias("s")).select("s.*")
    return grouped_scores(long, ["left", "right"], "u", "v").select("left", "right", "nmi")


def pearson_composition(full: DataFrame, panel: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``(r, p, clusters)`` of the clusters' percentages in two tables; 1 and 0 below two clusters."""
    a, b = percentages(full, cluster).select(cluster, F.col("pct_genomes").alias("pa")), percentages(panel, cluster).select(cluster, F.col("pct_genomes").alias("pb"))
    both = a.join(b, cluster, "full_outer").select(F.coalesce("pa", F.lit(0.0)).alias("pa"), F.coalesce("pb", F.lit(0.0)).alias("pb"))
    row = both.agg(F.corr("pa", "pb").alias("r"), F.count(F.lit(1)).alias("clusters"))
    return row.select(F.when(F.col("clusters") < 2, 1.0).otherwise(F.col("r")).alias("r"), "clusters")


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, by the incomplete beta function."""
    if n < 2:
        return 0.0
    if n == 2 or math.isnan(r):
        return 1.0 if n == 2 else math.nan
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 500):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or 1e-300)
                c = 1 + k / c or 1e-300
                h *= d * c
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def top_references(pairs: DataFrame, novelty: float = 92.0) -> DataFrame:
    """Best and second reference per id from ``(id, item_class, ref_ord, ref_id, identity)``, and the novelty flag.

    Larger identity first, then later reference. A reference is not compared with
    itself unless it is alone; one candidate stands in both places.
    """
    rows = pairs.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id"))).where((F.col("id").cast("string") != F.col("ref_id").cast("string")) | (F.col("n") == 1))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("identity"), F.desc("ref_ord")))).where("r <= 2")
    at = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    out = ranked.groupBy("id", "item_class").agg(at("ref_id", 1).alias("best_ref_id"), at("identity", 1).alias("best_identity"), F.coalesce(at("ref_id", 2), at("ref_id", 1)).alias("second_ref_id"), F.coalesce(at("identity", 2), at("identity", 1)).alias("second_identity"))
    return out.withColumn("candidate_novel", (F.col("item_class") == "genome") & (F.col("best_identity") < novelty))


#: Distances up to which all are taken, block by block; beyond, a grid leaves out what is too far to matter.
ALL_PAIRS = 10_000_000


def _candidates(query: DataFrame, k: int, include_self: bool) -> DataFrame:
    """``(id, x, y, best)`` of joined rows ``(id, x, y, other, ox, oy)``: the k nearest of each query, ties to the smaller id."""
    d = F.sqrt((F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x")) + (F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y")))
    near = F.struct(d.alias("d"), "other")
    rows = F.collect_list(near) if include_self else F.collect_list(F.when(F.col("other") != F.col("id"), near))
    return query.groupBy("id", "x", "y").agg(F.slice(F.array_sort(rows), 1, k).alias("best"))


def _by_blocks(queries: DataFrame, points: DataFrame, k: int, include_self: bool, block_rows: int) -> DataFrame:
    """``(id, other, d)``: each query meets each block of points, and of a block its k best are handed on."""
    blocks = max(1, -(-points.count() // block_rows))
    packed = points.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("other", "ox", "oy")).alias("ps"))
    entry = lambda p: F.struct(F.sqrt((p.ox - F.col("x")) * (p.ox - F.col("x")) + (p.oy - F.col("y")) * (p.oy - F.col("y"))).alias("d"), p.other.alias("other"))
    each = F.transform("ps", entry)
    each = each if include_self else F.filter(each, lambda e: e.other != F.col("id"))
    met = queries.crossJoin(packed).select("id", F.explode(F.slice(F.array_sort(each), 1, k)).alias("e"))  # one row of `packed` is a block
    return met.select("id", "e.other", "e.d")


def _by_grid(queries: DataFrame, points: DataFrame, k: int, include_self: bool) -> DataFrame:
    """``(id, other, d)`` over a grid of cells of about ``k`` points.

    A query is done once its k-th neighbour is no farther than the rim of the cells it has
    looked at; the others look twice as far in the next round. Of points in one place only the
    ``k + 1`` smallest ids can be anybody's neighbours.
    """
    place = W.partitionBy("ox", "oy").orderBy("other")
    points = points.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1).drop("n")
    box = points.agg(F.min("ox").alias("x0"), F.max("ox").alias("x1"), F.min("oy").alias("y0"), F.max("oy").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    side = max(math.sqrt(max(box.x1 - box.x0, 1e-12) * max(box.y1 - box.y0, 1e-12) * k / box.n), max(box.x1 - box.x0, box.y1 - box.y0) / 1e6, 1e-12)
    cell = lambda c, low: F.floor((F.col(c) - low) / side)
    points = checkpoint(points.withColumns({"cx": cell("ox", box.x0), "cy": cell("oy", box.y0)}))
    left = checkpoint(queries.select("id", "x", "y"))
    wide = max((box.x1 - box.x0) / side, (box.y1 - box.y0) / side) + 2
    reach, done = 1, []
    while not left.isEmpty():
        if reach >= wide:  # the rest see everything
            done.append(_by_blocks(left, points.select("other", "ox", "oy"), k, include_self, 2000))
            break
        around = F.sequence(F.lit(-reach), F.lit(reach))
        seen = left.withColumn("dx", F.explode(around)).withColumn("cx", cell("x", box.x0) + F.col("dx")).withColumn("dy", F.explode(around)).withColumn("cy", cell("y", box.y0) + F.col("dy")).drop("dx", "dy")
        best = checkpoint(_candidates(seen.join(points, ["cx", "cy"]), k, include_self))
        enough = (F.size("best") == k) & (F.element_at("best", -1)["d"] <= reach * side)
        done.append(best.where(enough).select("id", F.explode("best").alias("e")).select("id", "e.other", "e.d"))
        left = checkpoint(left.join(best.where(enough).select("id"), "id", "left_anti"))
        reach *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def nearest(queries: DataFrame, points: DataFrame, k: int, include_self: bool = False, block_rows: int = 2000) -> DataFrame:
    """``(id, other, d, rank)``: the k nearest points of every query in the plane, exactly.

    ``points`` and ``queries``: ``(id, x, y)``, ids unique. Up to ``ALL_PAIRS`` distances each query meets
    blocks of about ``block_rows`` points, and nothing larger than k rows a query and block is
    shuffled; beyond, only points of cells near a query are compared with it. Ties go to the smaller id.
    """
    q = queries.select("id", "x", "y")
    p = points.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    few = q.count() * p.count() <= ALL_PAIRS
    met = _by_blocks(q, p, k, include_self, block_rows) if few else _by_grid(q, p, k, include_self)
    return met.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("d", "other"))).where(F.col("rank") <= k).select("id", "other", "d", "rank")


def gaussian_edges(neighbours: DataFrame) -> DataFrame:
    """``(src, dst, w)``: union of neighbour pairs, the larger weight of each, exp(-d^2 / 2 sigma^2).

    sigma is the exact median of the positive distances.
    """
    sigma = neighbours.where("d > 0").agg(F.percentile("d", F.lit(0.5)).alias("sigma"))
    w = F.when(F.coalesce("sigma", F.lit(0.0)) > 0, F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma")))).otherwise(1.0)
    rows = neighbours.crossJoin(F.broadcast(sigma)).select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), w.alias("w"))
    return rows.groupBy("src", "dst").agg(F.max("w").alias("w"))


def majority_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, cluster)``: the neighbours' most frequent cluster; on ties the one met first by rank."""
    v = neighbours.join(labels.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return v.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "first"))).where("r = 1").select("id", "cluster")


#: Edges up to this count are united by one task, about 200 bytes each; more are halved by rounds first.
LOCAL_EDGES = 500_000


def _united(edges: DataFrame) -> DataFrame:
    """``(u, v)`` of each node and the smallest one it reaches, roots left out; for at most ``LOCAL_EDGES`` edges."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
        ids = [x for x in up if up[x] != x]
        type_ = batch.schema.field(0).type if up else pa.int64()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array([root(x) for x in ids], type_)], names=["u", "v"])

    return edges.repartition(1).mapInArrow(run, f"u {kind}, v {kind}")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id that each node reaches, by large and small stars.

    A round hooks all larger neighbours of a node to its smallest one, and then all
    smaller neighbours; rounds grow with the logarithm of the diameter and are
    checkpointed. A hub's neighbours are joined, never gathered. Edges that are few enough,
    at first or after rounds, are united in one task.
    """
    now = checkpoint(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0] > LOCAL_EDGES:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))))
        after = checkpoint(large.join(low, "u").select(pair.alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u != v").distinct())
        forget(now)
        now, before, seen = after, seen, mark(after)
        if before == seen:  # every node hangs on its root
            break
    else:
        now = _united(now)
    root = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.select("id").join(root, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def largest_remainder(weights: DataFrame, total: int) -> DataFrame:
    """``(key, weight, quota)``: floors of the shares, then one more by (remainder, weight, key)."""
    s = weights.agg(F.sum("weight").alias("_s"))
    rows = weights.crossJoin(F.broadcast(s)).withColumn("exact", F.col("weight") * F.lit(total) / F.col("_s")).withColumn("base", F.floor("exact"))
    left = rows.agg((F.lit(total) - F.sum("base")).alias("_left"))
    r = F.row_number().over(W.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), F.desc("weight"), "key"))  # one row per cluster
    return rows.withColumn("r", r).crossJoin(F.broadcast(left)).select("key", "weight", (F.col("base") + F.when(F.col("r") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def nearest_to_centroid(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The member of each cluster nearest to its centroid, the first by ``ord`` on ties."""
    c = centroids(points, cluster)
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    rows = points.join(c, cluster).withColumn("d", F.round(d, 9))
    return rows.groupBy(cluster).agg(F.min_by(F.struct("id", "d"), F.struct("d", "ord")).alias("m")).select(cluster, "m.id", F.col("m.d").alias("centroid_distance"))


def export_summary(rows: DataFrame) -> DataFrame:
    """``(cluster, members, genomes, references)``; a blank class counts as genome."""
    cls = F.coalesce(F.nullif(F.trim("item_class"), F.lit("")), F.lit("genome"))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.count_if(cls == "genome").alias("genomes"), F.count_if(cls == "reference").alias("references"))


def best_hit(hits: DataFrame, least_pident: float = 0.0, least_qcovs: float = 0.0) -> DataFrame:
    """The highest bit score per query after the floors, the first by ``ord`` on ties."""
    ok = hits.where((F.col("pident") >= least_pident) & (F.col("qcovs") >= least_qcovs))
    return ok.groupBy("qseqid").agg(F.max_by(F.struct("sseqid", "pident", "qcovs", "bitscore"), F.struct("bitscore", -F.col("ord"))).alias("h")).select("qseqid", "h.*")


def outermost(points: DataFrame, directions: int = 64) -> DataFrame:
    """``(cluster, x, y)`` of the points that can be corners of their cluster's convex hull: a few per cluster, and no corner is left out.

    The extreme points in ``directions`` directions span a polygon inside the hull; points
    strictly inside it are no corners. Extremes are found by grouped maxima with partial aggregation.
    """
    angles = [2 * math.pi * i / directions for i in range(directions)]
    along = [F.max_by(F.struct("x", "y"), F.col("x") * math.cos(a) + F.col("y") * math.sin(a)).alias(f"e{i}") for i, a in enumerate(angles)]
    corners = points.groupBy("cluster").agg(*along).select(F.col("cluster").alias("_cluster"), F.array(*(f"e{i}" for i in range(directions))).alias("ring"))
    rows = points.select("cluster", "x", "y").distinct().join(F.broadcast(corners), F.col("cluster").eqNullSafe(F.col("_cluster")))
    after = F.concat(F.slice("ring", 2, directions - 1), F.slice("ring", 1, 1))
    # inside if strictly to the left of every edge of the ring, with a margin for rounding; equal neighbours are no edge
    edges = F.zip_with("ring", after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda e: (e.b.x - e.a.x) * (F.col("y") - e.a.y) - (e.b.y - e.a.y) * (F.col("x") - e.a.x)
    size = lambda e: F.abs(e.b.x - e.a.x) + F.abs(e.b.y - e.a.y)
    margin = lambda e: 1e-9 * size(e) * (F.abs("x") + F.abs("y") + F.abs(e.a.x) + F.abs(e.a.y))
    inside = F.forall(edges, lambda e: (size(e) == 0) | (cross(e) > margin(e)))
    flat = F.size(F.array_distinct("ring")) < 3
    return rows.where(flat | ~inside).select("cluster", "x", "y")


def typed(queries: DataFrame, hits: DataFrame, types: DataFrame, default: str = "untyped", least_pident: float = 0.0, least_qcovs: float = 0.0) -> DataFrame:
    """``(id, type, pident, qcovs)`` for every query: its best hit's type, ``default`` without a hit.

    ``types``: ``(sseqid, type)``; a hit whose subject has none keeps the subject's id.
    """
    best = best_hit(hits, least_pident, least_qcovs).join(types, "sseqid", "left")
    rows = queries.select("id").join(best.select(F.col("qseqid").alias("id"), F.coalesce("type", "sseqid").alias("type"), "pident", "qcovs"), "id", "left")
    return rows.select("id", F.coalesce("type", F.lit(default)).alias("type"), "pident", "qcovs")


def best_cell(scores: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The row of the largest ``value``, the first by ``order`` on ties; missing values are passed over."""
    known = scores.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    first = known.agg(F.min_by(F.struct(*scores.columns), F.struct((-F.col(value)).alias("_v"), *order)).alias("r"))
    return first.where("r IS NOT NULL").select("r.*")


def cluster_view(points: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Per cluster of the genomes in a length window: place in order, count, share, label place and hull.

    ``points``: ``(id, x, y, cluster, len)`` and ``item_class`` if there are others than
    genomes. Ordered by letters, number and name of the cluster; ``hull`` is an array of ``(x, y)``.
    """
    rows = points.where(F.coalesce("item_class", F.lit("genome")) != "reference") if "item_class" in points.columns else points
    rows = rows.where(F.col("len") >= least) if least is not None else rows
    rows = rows.where(F.col("len") <= most) if most is not None else rows
    own = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("genomes"), F.avg("x").alias("label_x"), F.avg("y").alias("label_y"))

    def corners(frame):
        import pandas as pd

        h = kernels.hull(frame[["x", "y"]].to_numpy())
        return pd.DataFrame({"cluster": [frame["cluster"].iloc[0]], "hull": [[{"x": float(a), "y": float(b)} for a, b in h]]})

    kind = points.schema["cluster"].dataType.simpleString()
    hulls = outermost(rows.select("cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).groupBy("cluster").applyInPandas(corners, f"cluster {kind}, hull array<struct<x:double,y:double>>")
    total = own.agg(F.sum("genomes").alias("_total"))
    place = F.row_number().over(W.orderBy(*cluster_order(F.col("cluster"))))  # one row per cluster
    return own.join(hulls, "cluster", "left").crossJoin(F.broadcast(total)).select(place.alias("place"), "cluster", "genomes", (100.0 * F.col("genomes") / F.col("_total")).alias("pct_genomes"), "label_x", "label_y", "hull")
