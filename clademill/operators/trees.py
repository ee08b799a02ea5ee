"""Neighbour-joining trees of many groups, one group in a task, as tables of drawn lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.operators import kernels as K
from clademill.plans.shared import partitions

#: Members of a group whose matrix a task may hold: 288 MB.
MOST = 6000


def group_trees(items: DataFrame) -> DataFrame:
    """``(cluster, kind, parent, child, x1, y1, x2, y2, branch_length, distance_from_root, id)``: a tree for each cluster of ``(cluster, id, vector)``.

    Distances are Euclidean. A branch ends at ``child``, and where that is a leaf ``id`` names it; a connector
    crosses a node's children. Leaves are numbered in the order of ids. A cluster is a panel's:
    one of more than ``MOST`` rows is an error before any tree is made; one of a single row has no line.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in ("cluster", "id")}
    largest = items.groupBy("cluster").count().agg(F.max("count")).first()[0] or 0
    if largest > MOST:
        raise ValueError(f"a cluster of {largest} rows is no panel: trees are made for up to {MOST}")
    names = [x.split()[0] for x in K.SEGMENT.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        x = np.vstack(frame["vector"].to_numpy()).astype(float)
        d = np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in x])
        lines = pd.DataFrame(K.tree_segments(K.tree_nodes(K.neighbor_joining(d), len(d))), columns=names)
        lines["id"] = lines["child"].map(lambda c: frame["id"][int(c)] if c == c and c is not None and c < len(frame) else None)
        lines["parent"], lines["child"] = lines["parent"].astype("Int32"), lines["child"].astype("Int32")
        lines.insert(0, "cluster", frame["cluster"].iloc[0])
        return lines

    rows = items.select("cluster", "id", F.col("vector").cast("array<double>").alias("vector")).repartition(partitions(items.sparkSession), "cluster")
    return rows.groupBy("cluster").applyInPandas(run, f"cluster {kinds['cluster']}, {K.SEGMENT}, id {kinds['id']}")
