"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import SharedTable, save


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, label: str = "components") -> SharedTable:
    """Table ``(node, component)`` of the smallest node that each node reaches.

    ``links`` has two BIGINT columns; direction, repeats, loops and order do not
    matter, and a row with a null end is no link. Nodes without a link are
    absent. Each round hooks every node to its smallest neighbour by a grouped
    minimum and a join, so a hub's neighbours are never gathered in one task;
    the round's edges go to the shared folder, and the former ones are removed.
    Rounds grow with the logarithm of the diameter.
    """
    a, b = links.columns[:2]
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    start = start.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    table = save(start.distinct(), label)
    mark = _mark(table.df)
    while mark[0]:
        edges = table.df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = save(small, label)
        now = _mark(after.df)
        table.drop()
        table = after
        if now == mark:
            break
        mark = now
    node = table.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = node.select(F.col("component").alias("node"), "component").distinct()
    return SharedTable(node.unionByName(roots), table.path)
