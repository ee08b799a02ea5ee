"""Panel selection: quotas, farthest points, sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.operators.clusters import largest_remainder
from clademill.operators.kernels import farthest_points
from clademill.plans.shared import checkpoint


def quotas(points: DataFrame, budget: int, cluster: str = "cluster") -> DataFrame:
    """``(cluster, genomes_in_cluster, allocated)``: proportional, held at the cluster's size, without redistribution."""
    n = points.groupBy(F.col(cluster).alias("key")).agg(F.count(F.lit(1)).alias("weight"))
    q = largest_remainder(n, budget)
    return q.select(F.col("key").alias(cluster), F.col("weight").alias("genomes_in_cluster"), F.least("quota", "weight").alias("allocated"))


def farthest_point_panel(points: DataFrame, allocation: DataFrame) -> DataFrame:
    """``(cluster, id, selection_rank, selection_mode, x, y, centroid_distance)``; rank 1 is nearest to the centroid."""
    rows = points.select("cluster", "ord", "id", "x", "y").join(allocation.where("allocated > 0").select("cluster", "allocated"), "cluster")
    id_type = points.schema["id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord").reset_index(drop=True)
        order, centre = farthest_points(frame[["x", "y"]].to_numpy(), int(frame["allocated"].iloc[0]))
        out = frame.iloc[order][["cluster", "id", "x", "y"]].copy()
        out["selection_rank"] = range(1, len(out) + 1)
        out["selection_mode"] = ["centroid"] + ["coverage"] * (len(out) - 1)
        out["centroid_distance"] = centre[order]
        return out

    return rows.groupBy("cluster").applyInPandas(run, f"cluster string, id {id_type}, x double, y double, selection_rank int, selection_mode string, centroid_distance double")


def stratified_quotas(sizes: DataFrame, total: int) -> DataFrame:
    """``(cluster, members, quota)`` of ``(cluster, members)``: floors of the shares, then one more by (remainder, cluster), both from the largest.

    No cluster gets more than it has, and what one cannot take the next one gets. One
    row for each cluster; remainders are whole numbers, so ties are ties.
    """
    n = sizes.agg(F.sum("members").alias("_n"))
    rows = sizes.crossJoin(F.broadcast(n)).withColumns({"_base": F.least("members", F.floor(F.lit(total) * F.col("members") / F.col("_n")).cast("bigint")), "_rest": (F.lit(total) * F.col("members")) % F.col("_n")})
    left = rows.agg((F.lit(total) - F.sum("_base")).alias("_left"))
    turn = F.sum((F.col("_base") < F.col("members")).cast("int")).over(W.orderBy(F.desc("_rest"), F.desc("cluster")).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_turn", turn).crossJoin(F.broadcast(left))
    more = (F.col("_base") < F.col("members")) & (F.col("_turn") <= F.col("_left"))
    return rows.select("cluster", "members", (F.col("_base") + more.cast("int")).alias("quota"))


#: Clusters up to this count are broadcast beside the rows; more are joined by a shuffle.
BROADCAST_CLUSTERS = 100_000


def stratified_sample(rows: DataFrame, total: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``(id, cluster, ...)`` that a seeded choice of ``total`` takes, and ``(cluster, members, quota)``.

    A cluster's rows are ordered by the SHA-256 of ``seed:id``, and the first as many as its quota are
    taken, rows of one id in any order. Counts by cluster and the hash's first four digits tell up to
    which digits all rows go in; only the rows of the digits at the bound are ranked, so
    no cluster is sorted or meets in one task.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    keyed = rows.withColumns({"_key": key, "_head": F.substring(key, 1, 4)})
    counts = checkpoint(keyed.groupBy("cluster", "_head").agg(F.count(F.lit(1)).alias("_n")))
    quotas = checkpoint(stratified_quotas(counts.groupBy("cluster").agg(F.sum("_n").alias("members")), total))
    upto = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy("cluster").orderBy("_head").rowsBetween(W.unboundedPreceding, 0)))
    bound = upto.join(quotas.where("quota > 0"), "cluster").where("_upto >= quota").groupBy("cluster").agg(F.min("_head").alias("_at"), F.min_by(F.col("quota") - F.col("_upto") + F.col("_n"), "_head").alias("_take"))
    bound = F.broadcast(bound) if quotas.count() <= BROADCAST_CLUSTERS else bound
    near = keyed.join(bound, "cluster").where("_head <= _at")
    rank = F.row_number().over(W.partitionBy("cluster").orderBy("_key"))
    last = near.where("_head = _at").withColumn("_rank", rank).where("_rank <= _take").drop("_rank")
    taken = near.where("_head < _at").unionByName(last)
    return taken.drop("_key", "_head", "_at", "_take"), quotas


def panel_metrics(items: DataFrame, panel: int) -> DataFrame:
    """One row: items, their pairs, the panel's share, how many times fewer pairs it has, its triplets."""
    n = items.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    own = panel * (panel - 1) / 2
    return n.select("n", pairs.cast("bigint").alias("pairs"), F.round(100.0 * panel / F.col("n"), 6).alias("panel_pct"), F.round(pairs / own, 6).alias("compression") if own else F.lit(float("nan")).alias("compression"), F.lit(panel * (panel - 1) * (panel - 2) // 6).cast("bigint").alias("triplets"))
