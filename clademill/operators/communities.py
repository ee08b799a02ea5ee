"""Communities of a weighted graph by rounds over its edge table: moves, refinement, aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.operators import kernels as K
from clademill.operators.clusters import connected
from clademill.plans.shared import checkpoint, forget

#: Rounds of moves and of refinement in one level, and levels; all end earlier where nothing is gained.
MOVES, REFINEMENTS, LEVELS = 24, 12, 32
#: Gains below this share of the graph's weight are none, so that the order of sums decides nothing.
LEAST = 1e-10
#: Edges of a level up to this count are settled by one task, about 300 bytes each; more go through rounds first.
LOCAL_EDGES = 500_000


def _coin(column: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(2)) == 0


def _summed(edges: DataFrame, state: DataFrame, label: str) -> DataFrame:
    """``(id, to, w)``: a node's weight towards every label among its neighbours."""
    other = state.select(F.col("id").alias("dst"), F.col(label).alias("to"))
    return edges.join(other, "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))


def _moved(edges: DataFrame, state: DataFrame, whole: float, inside: float, resolution: float, seed: int) -> tuple[DataFrame, float]:
    """The best labelling that rounds of moves reach from ``state``, and its quality.

    In a round the nodes for which a coin falls move to the neighbouring community of the largest
    gain. Moves of one round do not see each other, so the quality is measured after
    each, and the best state is the one that stays.
    """
    best, top, idle, now = state, float("-inf"), 0, state
    for n in range(MOVES):
        total = now.groupBy("c").agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("n"))
        rows = checkpoint(_summed(edges, now, "c").join(now.select("id", "c", "k"), "id"))
        within = rows.agg(F.sum(F.when(F.col("to") == F.col("c"), F.col("w")))).first()[0] or 0.0
        spread = total.agg(F.sum((F.col("t") / whole) ** 2)).first()[0] or 0.0
        quality = (within + inside) / whole - resolution * spread
        better = quality > top + LEAST
        idle = 0 if better else idle + 1
        if better:
            if best is not state:
                forget(best)
            best, top = now, quality
        if idle == 3:
            forget(rows)
            break
        price = resolution * F.col("k") / whole
        value = F.round((F.col("w") - price * F.col("t")) / whole, 14)
        offer = F.when(F.col("to") != F.col("c"), F.struct((-value).alias("less"), F.col("to").alias("to"), F.col("n").alias("n")))
        offers = rows.join(total.withColumnRenamed("c", "to"), "to").groupBy("id").agg(F.min(offer).alias("offer"), F.max(F.when(F.col("to") == F.col("c"), F.col("w"))).alias("w"))
        here = now.select("id", "c", "k").join(total, "c").join(offers, "id", "left")
        stay = F.round((F.coalesce("w", F.lit(0.0)) - price * (F.col("t") - F.col("k"))) / whole, 14)
        wants = F.coalesce(-F.col("offer.less") > stay + LEAST * F.col("k") / whole, F.lit(False))
        # two single nodes do not change places: the larger label goes to the smaller
        swap = (F.col("n") == 1) & (F.col("offer.n") == 1) & (F.col("offer.to") > F.col("c"))
        goes = wants & ~swap & _coin(F.col("id"), seed + n)
        after = checkpoint(here.select("id", F.when(goes, F.col("offer.to")).otherwise(F.col("c")).alias("c"), "k", wants.alias("wants")))
        forget(rows)
        if now is not state and now is not best:
            forget(now)
        now = after
        if not now.agg(F.max("wants")).first()[0]:
            break
    if now is not best and now is not state:
        forget(now)
    return best.select("id", "c", "k"), top


def _refined(edges: DataFrame, state: DataFrame, whole: float, resolution: float, seed: int) -> DataFrame:
    """``(id, c, k, r)``: parts of each community, grown from single nodes along its own edges.

    A node that is still alone and well connected to its community joins the neighbouring part of the
    largest positive gain, if that part is well connected too. Parts of one face of a coin stay in a
    round and those of the other move, so a node joins only what stays, and every part is connected.
    """
    label = state.select("id", "c")
    inner = edges.join(label.toDF("src", "c"), "src").join(label.toDF("dst", "d"), "dst").where("c = d")
    inner = checkpoint(inner.select("src", "dst", "w"))
    total = state.groupBy("c").agg(F.sum("k").alias("t"))
    degree = inner.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("inward"))
    enough = lambda w, k: F.coalesce(w, F.lit(0.0)) >= resolution * k * (F.col("t") - k) / whole
    now = checkpoint(state.join(total, "c").join(degree, "id", "left").select("id", "c", "k", "t", enough(F.col("inward"), F.col("k")).alias("well"), F.col("id").alias("r"), F.lit(True).alias("wants")))
    for n in range(REFINEMENTS):
        rows = checkpoint(_summed(inner, now, "r").join(now.select("id", "k", "t", "r", "well"), "id"))
        cut = rows.where("`to` != r").groupBy(F.col("r").alias("to")).agg(F.sum("w").alias("cut"))
        parts = now.groupBy(F.col("r").alias("to")).agg(F.sum("k").alias("pk"), F.count(F.lit(1)).alias("n"), F.first("t").alias("t"))
        parts = parts.join(cut, "to", "left").select("to", "pk", "n", enough(F.col("cut"), F.col("pk")).alias("fit"))
        gain = F.round((F.col("w") - resolution * F.col("k") * F.col("pk") / whole) / whole, 14)
        alone = parts.where("n = 1").select(F.col("to").alias("r"))
        open_ = rows.where("well AND `to` != r").join(alone, "r", "left_semi").join(parts.where("fit"), "to")
        open_ = open_.where(gain > LEAST * F.col("k") / whole)
        stays = _coin(F.col("to"), seed + n) & ~_coin(F.col("id"), seed + n)
        offers = open_.groupBy("id").agg(F.min(F.when(stays, F.struct((-gain).alias("less"), F.col("to").alias("to")))).alias("offer"))
        after = checkpoint(now.drop("wants").join(offers.withColumn("wants", F.lit(True)), "id", "left").select("id", "c", "k", "t", "well", F.coalesce("offer.to", "r").alias("r"), F.coalesce("wants", F.lit(False)).alias("wants")))
        forget(rows, now)
        now = after
        if not now.agg(F.max("wants")).first()[0]:
            break
    forget(inner)
    return now.select("id", "c", "k", "r")


def _joined(parts: DataFrame) -> DataFrame:
    """``(id, c, k)``: the parts as nodes of the next level."""
    return parts.groupBy(F.col("r").alias("id")).agg(F.first("c").alias("c"), F.sum("k").alias("k"))


def _settled(links: DataFrame, state: DataFrame, resolution: float, seed: int) -> DataFrame:
    """``(id, c)``: communities of a level's nodes, by the kernel in one task; for at most ``LOCAL_EDGES`` edges.

    A node's weight beyond its edges lies inside it. The kernel starts from single nodes, which are connected parts of
    the level's communities; where those communities are better than what it finds, they stay.
    """
    kind = state.schema["id"].dataType.simpleString()

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id").reset_index(drop=True)
        edges = edges[edges["src"] < edges["dst"]].sort_values(["src", "dst"])
        at = pd.Index(nodes["id"])
        src, dst, w = at.get_indexer(edges["src"]), at.get_indexer(edges["dst"]), edges["w"].to_numpy(float)
        k = nodes["k"].to_numpy(float)
        own = np.maximum(k - np.bincount(src, w, len(k)) - np.bincount(dst, w, len(k)), 0) / 2

        def quality(c: np.ndarray) -> float:
            inside = own.sum() + w[c[src] == c[dst]].sum()
            return 2 * inside / k.sum() - resolution * ((np.bincount(c, k) / k.sum()) ** 2).sum()

        before = np.unique(nodes["c"].to_numpy(), return_inverse=True)[1]
        found = K.leiden(len(k), src, dst, w, resolution, seed, own=own)
        found = before if quality(before) > quality(found) + LEAST else found
        ids, (_, first, member) = nodes["id"].to_numpy(), np.unique(found, return_index=True, return_inverse=True)
        return pd.DataFrame({"id": ids, "c": ids[first[member]]})

    one = lambda d: d.withColumn("all", F.lit(0)).groupBy("all")
    return one(state.select("id", "c", "k")).cogroup(one(links.select("src", "dst", "w"))).applyInPandas(run, f"id {kind}, c {kind}")


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``(id, cluster)``: communities of the configuration null model, each connected and named by its smallest id.

    ``nodes``: ``(id)``, unique; ``edges``: ``(src, dst, w)``, undirected. Weights of repeated pairs are
    added in either direction; loops, edges to unknown nodes and weights that are null or not positive are
    left out. A level moves nodes between communities, refines each community into well connected
    parts, and makes each part a node of the next level, which starts from the communities found; where no
    part has grown, the communities themselves become nodes, and it ends where each is one already. These levels are
    joins and sums over the edge table: a round moves at most one row an edge, and neither
    a community nor a graph of more than ``LOCAL_EDGES`` edges is ever one group. A level of fewer, at first or after others, is
    settled in one task (:func:`_settled`). The quality never falls from level to level.
    """
    good = edges.where("src != dst AND w > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("w").cast("double").alias("w"))
    known = nodes.select("id")
    good = good.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi").groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")
    first = checkpoint(good.select(both, "w").select("e.src", "e.dst", "w"))
    whole = first.agg(F.sum("w")).first()[0]
    if not whole:
        return known.select("id", F.col("id").alias("cluster"))
    degree = first.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    state = checkpoint(known.join(degree, "id", "left").select("id", F.col("id").alias("c"), F.coalesce("k", F.lit(0.0)).alias("k")))
    member = known.select("id", F.col("id").alias("node"))
    links, inside, size = first, 0.0, state.count()
    for level in range(LEVELS):
        # a pair is in the table once for each end
        if size <= LOCAL_EDGES and links.count() <= 2 * LOCAL_EDGES:
            state = checkpoint(_settled(links, state, resolution, seed))
            break
        state, _ = _moved(links, state, whole, inside, resolution, seed + 1000 * level)
        parts = _refined(links, state, whole, resolution, seed + 1000 * level + 500)
        fewer = checkpoint(_joined(parts))
        now = fewer.count()
        if now == size:
            # no parts grow any more: whole communities become nodes, so that they can join
            parts = state.select("id", "c", "k", F.col("c").alias("r"))
            forget(fewer)
            fewer = checkpoint(_joined(parts))
            now = fewer.count()
        if now == size:
            break
        size = now
        to = parts.select("id", "r")
        mapped = links.join(to.toDF("src", "a"), "src").join(to.toDF("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        after = checkpoint(mapped.where("src != dst"))
        member = checkpoint(member.join(to.toDF("node", "r"), "node").select("id", F.col("r").alias("node")))
        # the rest of the weight lies inside the new nodes
        inside = whole - (after.agg(F.sum("w")).first()[0] or 0.0)
        links, state = after, fewer
    found = checkpoint(member.join(state.select(F.col("id").alias("node"), "c"), "node").select("id", "c"))
    label = found.toDF("src", "c")
    own = first.where("src < dst").join(label, "src").join(found.toDF("dst", "d"), "dst").where("c = d").select("src", "dst")
    return connected(found.select("id"), own).withColumnRenamed("component", "cluster")


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, ``modularity``: of ``(id, cluster)`` over undirected ``(src, dst, w)`` without loops."""
    label = clusters.select("id", "cluster")
    rows = edges.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").select("a", "b", F.col("w").cast("double").alias("w"))
    ends = rows.select(F.explode(F.array("a", "b")).alias("a"), "w").groupBy("a").agg(F.sum("w").alias("t"))
    total = ends.agg(F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("q"))
    within = rows.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))).alias("i"))
    return within.crossJoin(F.broadcast(total)).select((2 * F.coalesce("i", F.lit(0.0)) / F.col("s") - resolution * F.col("q") / (F.col("s") * F.col("s"))).alias("modularity"))  # one row each
