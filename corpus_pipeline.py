"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.llm.common import SharedTable, bounded, fresh, save, shared_dir
from clademill.llm.decontaminate import drop_contaminated
from clademill.llm.line_dedup import cut_spans, repeated_spans
from clademill.llm.near_dup import drop_near_duplicates, near_duplicates
from clademill.llm.packing import default_tokenizer, pack
from clademill.llm.toxicity import fit_from_tables, keep_clean

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document of which line dedup would remove this share may be a copy, left to the near-duplicate stage if that removes it.
WHOLE_COPY_SHARE = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones of ``docs``."""
    return keep_clean(docs, fit_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents go, but for their first occurrence.

    ``n_chars`` follows the cut text. Documents mostly made of repeated passages stay
    whole only where the next stage is sure to remove them: the near-duplicate rule, on
    the texts that stage would get, links them to a first document that is not
    one of them. All others are cut, by the passages that those others hold: a document
    that is going to be removed is no first holder, so what only it shares with a later
    one stays there.
    """
    counts = tuple(fresh(c, docs.columns) for c in ("n_words", "n_removed", "n_spans"))  # documents keep columns of these names
    removed, found = F.col(counts[1]), F.col(counts[2])
    first = save(cut_spans(docs, repeated_spans(docs), whole_share=WHOLE_COPY_SHARE, counts=counts), "first-cut")
    whole = first.df.where((removed == 0) & (found > 0)).select("doc_id").distinct()
    copies = near_duplicates(first.df.select("doc_id", "text")).where("NOT kept").select("doc_id", "component_id").distinct()
    copies = copies.join(whole.toDF("component_id"), "component_id", "left_anti")
    leaving = bounded(save(whole.join(copies, "doc_id", "left_semi"), "leaving").df)
    first.drop()
    staying = docs.join(leaving, "doc_id", "left_anti")
    cut = cut_spans(staying, repeated_spans(staying), counts=counts)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns).unionByName(docs.join(leaving, "doc_id", "left_semi"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return pack(docs, default_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dup", near_dup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and then its predecessor removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before: SharedTable | None = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            before.drop()
        before = SharedTable(docs, path)
    return docs
