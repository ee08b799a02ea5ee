"""The jobs as registered queries: each runs twice into a new folder, and gives its output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clademill.plans.catalog import _COLLAPSE, ACGT
from clademill.plans.shared import shared_folder
from jobs import dereplicate, panel


def job1_dereplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        out = dereplicate.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return out


def job2_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        out = panel.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output")
    return out


QUERIES = {"job1_dereplicate": job1_dereplicate, "job2_panel": job2_panel}

#: All sequences arrive at once, in the order of ids.
JOB1_SQL = (
    _COLLAPSE.replace("ORDER BY -length(q), id", "ORDER BY id")
    + """ SELECT c.id, c.representative, length(s.q)::INT AS letters, CASE WHEN c.id = c.representative THEN 100.0::DOUBLE ELSE round(greatest(0, least(100, 100*(1+ln(2.0*p.shared/(na.n+nb.n))/15))), 6) END AS identity, 0::BIGINT AS arrival, coalesce(nullif(d.lang, ''), 'unknown') AS lang
FROM c JOIN s ON s.id = c.id JOIN documents d ON d.doc_id = c.id LEFT JOIN p ON p.a = c.representative AND p.b = c.id LEFT JOIN n na ON na.id = p.a LEFT JOIN n nb ON nb.id = p.b"""
)

JOB2_SQL = f"""WITH q AS (SELECT doc_id AS id, coalesce(lang, 'unknown') || '-' || coalesce(source, 'unknown') AS cluster, {ACGT} AS seq, upper(replace(replace(coalesce(text,''), '-', ''), 'ß', 'SS')) AS whole FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT *, round(CASE WHEN length(whole) = 0 THEN 1.0 ELSE 1 - length(seq) / length(whole) END, 6) AS ambiguity FROM q), k AS (SELECT * FROM a WHERE length(seq) BETWEEN 40 AND 100000 AND ambiguity <= 0.9),
d AS (SELECT min(id) AS id, seq, arg_min(ambiguity, id) AS ambiguity, arg_min(cluster, id) AS cluster, count(*)::BIGINT AS copies FROM k GROUP BY seq),
t AS (SELECT count(*)::BIGINT AS n, floor(count(*) * 0.1)::BIGINT AS total FROM d), z AS (SELECT cluster, count(*)::BIGINT AS members FROM d GROUP BY 1),
b AS (SELECT cluster, members, (total * members) // n AS base, (total * members) % n AS rest, total FROM z, t),
u AS (SELECT *, row_number() OVER (ORDER BY rest DESC, cluster DESC) AS turn, total - sum(base) OVER () AS spare FROM b), p AS (SELECT cluster, base + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS quota FROM u),
o AS (SELECT d.*, row_number() OVER (PARTITION BY cluster ORDER BY sha256('42:' || id)) AS place FROM d)
SELECT o.id, length(o.seq)::INT AS letters, o.copies, o.ambiguity::DOUBLE AS ambiguity, o.seq, o.cluster FROM o JOIN p USING (cluster) WHERE o.place <= p.quota"""

ORACLE_SQL = {"job1_dereplicate": JOB1_SQL, "job2_panel": JOB2_SQL}
