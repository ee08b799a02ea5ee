"""A curated, stratified panel of a collection.

    python -m jobs.panel --source TABLE --output FOLDER [--config FILE]

Reads a Parquet table of sequences, keeps those of a length window that are not mostly
ambiguous, takes each distinct sequence once, and picks a share of them: as many of each
cluster as its size asks for, by a seeded hash of the id, so the choice can be repeated
and does not depend on how the table is dealt out.

- ``output/panel/cluster=C``: ``id``, ``letters``, ``copies``, ``ambiguity`` and ``seq`` of the picked;
- ``output/quotas``: ``cluster``, ``members`` and ``quota`` of all clusters.

A rerun overwrites the partitions that it writes with the same rows; clusters that are
no longer there go. Rows without an id are left out, null texts are empty, and a
null part of a cluster is ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions.sequence import acgt, ambiguity_fraction, normalise
from clademill.operators.sampling import stratified_sample
from clademill.plans.shared import checkpoint, forget
from jobs.common import log, main, settings

#: Columns of the source; letters at least and at most; the largest ambiguous share; the share to pick; the seed of the choice.
DEFAULTS = {"id": "doc_id", "sequence": "text", "cluster": ["lang", "source"], "least": 40, "most": 100_000, "ambiguous": 0.9, "share": 0.1, "seed": 42}


def curated(rows: DataFrame, own: dict) -> DataFrame:
    """``(id, seq, letters, ambiguity, copies, cluster)``: one row for each distinct sequence that passes, that of the smallest id."""
    cluster = F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in own["cluster"]))
    told = normalise(F.coalesce(F.col(own["sequence"]), F.lit("")))
    rows = rows.select(F.col(own["id"]).alias("id"), cluster.alias("cluster"), acgt(told).alias("seq"), F.round(ambiguity_fraction(told), 6).alias("ambiguity"))
    rows = rows.where(F.col("id").isNotNull() & F.length("seq").between(own["least"], own["most"]) & (F.col("ambiguity") <= own["ambiguous"]))
    first = F.min(F.struct("id", "cluster", "ambiguity")).alias("x")
    distinct = rows.groupBy("seq").agg(first, F.count(F.lit(1)).alias("copies"))
    return distinct.select("x.id", "seq", F.length("seq").alias("letters"), "x.ambiguity", "copies", "x.cluster")


def run(spark: SparkSession, source: str, output: str, config: str | None = None) -> DataFrame:
    """Writes a stratified panel of a table of sequences; returns the panel as written."""
    own = settings(DEFAULTS, config)
    rows = spark.read.parquet(source)
    distinct = checkpoint(curated(rows, own))
    n = distinct.count()
    log.info("%s: %d rows read, %d distinct sequences kept", source, rows.count(), n)
    picked, quotas = stratified_sample(distinct, int(n * own["share"]), own["seed"])
    quotas.write.mode("overwrite").parquet(f"{output}/quotas")
    picked.select("id", "letters", "copies", "ambiguity", "seq", "cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{output}/panel")
    forget(distinct)
    panel = spark.read.schema(f"id {distinct.schema['id'].dataType.simpleString()}, letters int, copies bigint, ambiguity double, seq string, cluster string").parquet(f"{output}/panel")
    clusters, size = panel.agg(F.count_distinct("cluster"), F.count(F.lit(1))).first()
    log.info("%s/panel: %d sequences of %d clusters written", output, size, clusters)
    return panel


if __name__ == "__main__":
    main("panel", ["source", "output"], run)
