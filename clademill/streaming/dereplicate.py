"""Incremental exact dereplication of a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.functions.sequence import normalise


def distinct_stream(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """First record of each sequence in a stream ``(id, seq, at)``; state is dropped ``delay`` after the watermark."""
    keyed = records.withColumn("key", F.sha2(normalise(F.col("seq")), 256))
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key"])
