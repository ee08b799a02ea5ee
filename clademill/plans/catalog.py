"""Registered queries over the driver's tables, with equivalent SQL.

Driver tables stand in for sequence collections: a document's letters A, C, G and
T are a sequence, its language or source a cluster, the first two components of an
embedding a point, its label a cluster, and an event row a recombination event.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.functions import sequence as S
from clademill.operators import clusters as C
from clademill.operators import intervals as V
from clademill.operators import kernels as K
from clademill.operators import layout as U
from clademill.operators import linkage as L
from clademill.operators import metric as X
from clademill.operators import recombination as R
from clademill.operators import similarity as M
from clademill.operators.communities import leiden
from clademill.operators.sampling import farthest_point_panel, panel_metrics, quotas
from clademill.operators.trees import group_trees

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """``(ord, id, seq, cluster, source)``; null texts are empty.

    A table of fewer files than cores may be one row group that one task reads; it
    is dealt out, which larger inputs never need.
    """
    docs, cores = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    docs = docs.repartition(cores) if len(docs.inputFiles()) < cores else docs
    return docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("seq"), F.col("lang").alias("cluster"), "source")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """``(ord, id, x, y, cluster)`` of the embeddings' first two components."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("cluster"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Recombination events: user ids as members, event types as methods, p from the value."""
    e = table(spark, sf, "events")
    u = F.coalesce(F.col("user_id"), F.lit(0))
    member = lambda k: F.concat(F.lit("S"), F.pmod(u + k, F.lit(997)).cast("string"))
    start = F.pmod(F.col("event_id") * 37, F.lit(5000)).cast("int")
    return e.select(F.col("event_id").alias("ord"), member(0).alias("recombinant"), member(1).alias("parent_a"), F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise(member(2)).alias("parent_b"), start.alias("start"), (start + 100 + F.pmod("event_id", F.lit(211)).cast("int")).alias("end"), F.col("event_type").alias("method"), (F.coalesce("value", F.lit(0.0)) / 1000).alias("pvalue"))


PTS = "(SELECT vec_id AS ord, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 'L' || label AS cluster FROM embeddings)"
EVT = "(SELECT event_id AS ord, 'S' || (coalesce(user_id,0) % 997) AS recombinant, 'S' || ((coalesce(user_id,0)+1) % 997) AS parent_a, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'S' || ((coalesce(user_id,0)+2) % 997) END AS parent_b, (event_id*37 % 5000)::INT AS \"start\", (event_id*37 % 5000 + 100 + event_id % 211)::INT AS \"end\", event_type AS method, coalesce(value,0)/1000 AS pvalue FROM events)"
ACGT = "regexp_replace(upper(coalesce(text,'')), '[^ACGT]', '', 'g')"


# ------------------------------------------------------------- k-mers, sequences


@query(f"""WITH s AS (SELECT doc_id AS id, {ACGT} AS q FROM documents), k AS (SELECT id, substring(q, i::INT, 3) AS kmer FROM s, range(1, greatest(length(q)-1, 1)) t(i) WHERE length(q) >= 3)
SELECT id, kmer, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY id), 6) AS freq FROM k GROUP BY id, kmer""")
def kmer_freq(spark, sf):
    return M.kmer_frequencies(sequences(spark, sf), 3).withColumn("freq", F.round("freq", 6))


@query(f"""WITH s AS (SELECT lang AS cluster, {ACGT} AS q FROM documents), k AS (SELECT cluster, substring(q, i::INT, 3) AS kmer FROM s, range(1, greatest(length(q)-1, 1)) t(i) WHERE length(q) >= 3)
SELECT cluster, kmer, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cluster), 6) AS freq FROM k GROUP BY cluster, kmer""")
def kmer_freq_by_lang(spark, sf):
    return M.kmer_frequencies(sequences(spark, sf), 3, "cluster").withColumn("freq", F.round("freq", 6))


@query(f"""WITH s AS (SELECT doc_id AS id, {ACGT} AS q FROM documents), k AS (SELECT id, substring(q, i::INT, 3) AS kmer FROM s, range(1, greatest(length(q)-1, 1)) t(i) WHERE length(q) >= 3), f AS (SELECT id, kmer, (count(*) / sum(count(*)) OVER (PARTITION BY id))::FLOAT AS v FROM k GROUP BY id, kmer),
c AS (SELECT i, substring('ACGT', (i // 16 + 1)::INT, 1) || substring('ACGT', (i // 4 % 4 + 1)::INT, 1) || substring('ACGT', (i % 4 + 1)::INT, 1) AS kmer FROM range(64) t(i)) SELECT s.id, c.i::INT AS i, round(coalesce(v, 0)::DOUBLE, 6) AS v FROM s CROSS JOIN c LEFT JOIN f ON f.id = s.id AND f.kmer = c.kmer""")
def kmer_vectors(spark, sf):
    """The vectors of all sequences, one row per component."""
    return M.kmer_vectors(sequences(spark, sf), 3).select("id", F.posexplode("vector").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("""WITH s AS (SELECT doc_id AS id, upper(replace(replace(coalesce(text,''), '-', ''), 'ß', 'SS')) AS q FROM documents) SELECT id, len(list_distinct(list_filter(list_transform(range(1, greatest(length(q) - 2, 1)), lambda i: substring(q, i::INT, 4)), lambda x: NOT contains(x, 'N'))))::BIGINT AS n FROM s""")
def kmer_set_sizes(spark, sf):
    """Distinct 4-mers without N over all letters of a record."""
    return M.kmer_set_sizes(sequences(spark, sf), 4)


@query(f"""WITH s AS (SELECT doc_id AS id, {ACGT} AS q FROM documents), k AS (SELECT DISTINCT id, substring(q, i::INT, 15) AS kmer FROM s, range(1, greatest(length(q)-13, 1)) t(i) WHERE length(q) >= 15),
n AS (SELECT id, count(*) AS n FROM k GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.id < b.id GROUP BY ALL)
SELECT p.a, p.b, shared::BIGINT AS shared, na.n::BIGINT AS size_a, nb.n::BIGINT AS size_b, round(100*(1+ln(2.0*shared/(na.n+nb.n))/15), 6) AS identity FROM p JOIN n na ON na.id = p.a JOIN n nb ON nb.id = p.b WHERE 100*(1+ln(2.0*shared/(na.n+nb.n))/15) >= 98.1 - 1e-9""")
def kmer_jaccard_pairs(spark, sf):
    s = sequences(spark, sf).select("id", S.acgt(F.col("seq")).alias("seq"))
    return M.similar_pairs(s, 15, 98.1).select("a", "b", *(F.col(c).cast("bigint").alias(c) for c in ("shared", "size_a", "size_b")), F.round("identity", 6).alias("identity"))


#: The loop in rank order over the sequences that are near to another: each is lost if a kept one comes before it.
_COLLAPSE = f"""WITH RECURSIVE s AS (SELECT doc_id AS id, {ACGT} AS q FROM documents), rk AS (SELECT id, row_number() OVER (ORDER BY -length(q), id) AS r FROM s), k AS (SELECT DISTINCT id, substring(q, i::INT, 15) AS kmer FROM s, range(1, greatest(length(q)-13, 1)) t(i) WHERE length(q) >= 15),
n AS (SELECT id, count(*) AS n FROM k GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.id < b.id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.id = p.a JOIN n nb ON nb.id = p.b WHERE 100*(1+ln(2.0*shared/(na.n+nb.n))/15) >= 98.1 - 1e-9), o AS (SELECT least(x.r, y.r) AS a, greatest(x.r, y.r) AS b FROM e JOIN rk x ON x.id = e.a JOIN rk y ON y.id = e.b),
w AS (SELECT row_number() OVER (ORDER BY b) AS step, b, list(a ORDER BY a) AS pre FROM o GROUP BY b),
g(step, lost) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.step, CASE WHEN len(list_filter(w.pre, lambda x: NOT list_contains(g.lost, x))) > 0 THEN list_append(g.lost, w.b) ELSE g.lost END FROM g JOIN w ON w.step = g.step + 1),
z AS (SELECT lost FROM g ORDER BY step DESC LIMIT 1), t AS (SELECT w.b, list_filter(w.pre, lambda x: NOT list_contains(z.lost, x))[1] AS first FROM w, z), c AS (SELECT rk.id, coalesce(h.id, rk.id) AS representative FROM rk LEFT JOIN t ON t.b = rk.r LEFT JOIN rk h ON h.r = t.first)"""


@query(_COLLAPSE + " SELECT id, representative, false AS protected FROM c")
def collapse_panel(spark, sf):
    s = sequences(spark, sf).select("id", S.acgt(F.col("seq")).alias("seq"))
    items = s.select("id", F.struct((-F.length("seq")).alias("l"), "id").alias("rank"), F.lit(False).alias("protected"))
    return M.collapse(s, items, 15, 98.1)


@query(_COLLAPSE + " SELECT representative, count(*)::BIGINT AS n_absorbed, string_agg(id::VARCHAR, ';' ORDER BY id::VARCHAR) AS absorbed_ids FROM c WHERE id <> representative GROUP BY 1")
def collapse_groups(spark, sf):
    return M.collapse_groups(collapse_panel(spark, sf)).where("n_absorbed > 0")


@query(_COLLAPSE + " SELECT lang AS cluster, count(*)::BIGINT AS genomes_in_cluster, count(*) FILTER (c.id = c.representative)::BIGINT AS retained FROM c JOIN documents d ON d.doc_id = c.id GROUP BY 1")
def cluster_retention(spark, sf):
    kept = collapse_panel(spark, sf).select("id", (F.col("id") == F.col("representative")).alias("kept"))
    return sequences(spark, sf).join(kept, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("genomes_in_cluster"), F.count_if("kept").alias("retained"))


@query(f"""SELECT doc_id AS id, length({ACGT})::BIGINT AS acgt_len, round(CASE WHEN length(q)=0 THEN 1.0 ELSE 1 - length({ACGT}) / length(q) END, 6) AS ambiguity, (length(q) - length(translate(q, 'RYSWKMBDHV', '')))::BIGINT AS recoded,
md5(translate(q, 'RYSWKMBDHV', 'NNNNNNNNNN')) AS recoded_md5 FROM (SELECT *, upper(replace(replace(coalesce(text,''), '-', ''), 'ß', 'SS')) AS q FROM documents)""")
def sequence_quality(spark, sf):
    q = S.normalise(F.col("seq"))
    return sequences(spark, sf).select("id", F.length(S.acgt(F.col("seq"))).cast("bigint").alias("acgt_len"), F.round(S.ambiguity_fraction(q), 6).alias("ambiguity"), (F.length(q) - F.length(F.translate(q, S.AMBIGUITY_CODES, ""))).cast("bigint").alias("recoded"), F.md5(S.recode_ambiguity(q)).alias("recoded_md5"))


@query("""SELECT min(doc_id) AS id, count(*)::BIGINT AS copies FROM documents WHERE n_chars BETWEEN 200 AND 20000 AND NOT regexp_matches(lower(coalesce(text,'')), 'licensed|reserved') GROUP BY coalesce(text,'')""")
def curated_distinct(spark, sf):
    """Length window, keyword exclusion and exact de-duplication; the first id stays."""
    d = table(spark, sf, "documents").where(F.col("n_chars").between(200, 20000) & ~F.lower(F.coalesce("text", F.lit(""))).rlike("licensed|reserved"))
    return d.groupBy(F.sha1(F.coalesce("text", F.lit(""))).alias("k")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")).drop("k")


@query(f"""WITH s AS (SELECT doc_id AS id, {ACGT} AS q FROM documents), f AS (SELECT id, frame, list_transform(range(0, (length(q) - frame) // 3), lambda i: substring(q, (frame + 3*i + 1)::INT, 3)) AS codons FROM s, range(3) t(frame)),
a AS (SELECT id, frame, regexp_replace(coalesce(array_to_string(list_transform(codons, lambda c: substring('{S._AMINO}', (16*(strpos('TCAG', c[1])-1) + 4*(strpos('TCAG', c[2])-1) + strpos('TCAG', c[3]))::INT, 1)), ''), ''), '[*]$', '') AS aa FROM f),
r AS (SELECT *, length(aa) - length(replace(aa, '*', '')) AS stops FROM a), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stops, -length(aa), encode(aa), frame) AS n FROM r) SELECT id, frame::INT AS frame, length(aa)::INT AS aa_len, stops::INT AS internal_stops, md5(aa) AS aa_md5 FROM b WHERE n = 1""")
def translate_best_frame(spark, sf):
    s = sequences(spark, sf).select("id", S.best_frame(S.acgt(F.col("seq"))).alias("t"))
    return s.select("id", "t.frame", "t.aa_len", "t.internal_stops", F.md5("t.aa").alias("aa_md5"))


@query(r"""SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(coalesce(text,''), '[A-Z]{1,3}[0-9]{5,8}'))) AS accession FROM documents""")
def accessions(spark, sf):
    return sequences(spark, sf).select("id", F.explode(F.array_distinct(F.regexp_extract_all("seq", F.lit("([A-Z]{1,3}[0-9]{5,8})"), F.lit(1)))).alias("accession"))


# --------------------------------------------------------------- panels, quotas


@query("""WITH w AS (SELECT source AS key, count(*) AS weight FROM documents GROUP BY 1), e AS (SELECT *, weight*100.0::DOUBLE/sum(weight) OVER () AS x FROM w), r AS (SELECT *, row_number() OVER (ORDER BY round(x-floor(x), 9) DESC, weight DESC, key) AS r FROM e)
SELECT key, weight::BIGINT AS weight, (floor(x) + CASE WHEN r <= 100 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def quota_largest_remainder(spark, sf):
    return C.largest_remainder(sequences(spark, sf).groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("weight")), 100)


@query(f"""WITH RECURSIVE p AS {PTS}, w AS (SELECT cluster, count(*) AS weight, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), e AS (SELECT *, weight*60.0::DOUBLE/sum(weight) OVER () AS share FROM w), l AS (SELECT *, row_number() OVER (ORDER BY round(share-floor(share), 9) DESC, weight DESC, cluster) AS r FROM e),
q AS (SELECT cluster, cx, cy, least(weight, floor(share) + CASE WHEN r <= 60 - (SELECT sum(floor(share)) FROM e) THEN 1 ELSE 0 END)::INT AS quota FROM l), m AS (SELECT cluster, any_value(quota) AS quota, list({{'o': ord, 'id': id, 'x': x, 'y': y, 'c': sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))}} ORDER BY ord) AS pts FROM p JOIN q USING (cluster) WHERE quota > 0 GROUP BY 1),
g AS (SELECT cluster, 1 AS rank, [list_sort(list_transform(pts, lambda z: {{'c': round(z.c, 12), 'o': z.o, 'z': z}}))[1].z] AS chosen FROM m UNION ALL
SELECT g.cluster, g.rank + 1, list_append(chosen, list_sort(list_transform(list_filter(pts, lambda z: NOT list_contains(list_transform(chosen, lambda k: k.o), z.o)), lambda z: {{'d': -round(list_min(list_transform(chosen, lambda k: sqrt((z.x-k.x)*(z.x-k.x)+(z.y-k.y)*(z.y-k.y)))), 12), 'c': -round(z.c, 12), 'o': z.o, 'z': z}}))[1].z) FROM g JOIN m USING (cluster) WHERE g.rank < m.quota)
SELECT cluster, chosen[rank].id AS id, round(chosen[rank].x, 6) AS x, round(chosen[rank].y, 6) AS y, rank::INT AS selection_rank, CASE WHEN rank = 1 THEN 'centroid' ELSE 'coverage' END AS selection_mode, round(chosen[rank].c, 6) AS centroid_distance FROM g""")
def sample_panel(spark, sf):
    p = points(spark, sf)
    return farthest_point_panel(p, quotas(p, 60)).withColumns({c: F.round(c, 6) for c in ("x", "y", "centroid_distance")})


@query(f"""WITH p AS {PTS}, c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), d AS (SELECT p.*, round(sqrt((x-cx)**2+(y-cy)**2), 9) AS d FROM p JOIN c USING (cluster))
SELECT cluster, id, round(d, 6) AS centroid_distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, ord) AS r FROM d) WHERE r = 1""")
def sample_panel_centroid(spark, sf):
    return C.nearest_to_centroid(points(spark, sf)).withColumn("centroid_distance", F.round("centroid_distance", 6))


@query("""WITH t AS (SELECT count(*) AS n FROM documents) SELECT n::BIGINT AS n, (n*(n-1)/2)::BIGINT AS pairs, round(100.0*100/n, 6) AS panel_pct, round((n*(n-1)/2.0)/(100*99/2.0), 6) AS compression, (100*99*98/6)::BIGINT AS triplets FROM t""")
def panel_sizes(spark, sf):
    return panel_metrics(sequences(spark, sf), 100)


# --------------------------------------------------------------------- clusters


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT count(*)::BIGINT AS cluster_count, max(n)::BIGINT AS largest, round(100.0*max(n)/sum(n), 6) AS largest_pct, count(*) FILTER (n = 1)::BIGINT AS singletons, count(*) FILTER (n <= 10)::BIGINT AS small_le_10, sum(n)::BIGINT AS members FROM c""")
def cluster_size_metrics(spark, sf):
    return C.size_metrics(sequences(spark, sf), "source").withColumn("largest_pct", F.round("largest_pct", 6))


@query("""SELECT lang AS cluster, count(*)::BIGINT AS genomes, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS pct_genomes FROM documents GROUP BY 1""")
def cluster_percentages(spark, sf):
    return C.percentages(sequences(spark, sf)).withColumn("pct_genomes", F.round("pct_genomes", 6))


@query(f"""SELECT cluster, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*)::BIGINT AS n FROM {PTS} GROUP BY 1""")
def cluster_centroids(spark, sf):
    return C.centroids(points(spark, sf)).select("cluster", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT cluster, x, y FROM {PTS}), e AS (SELECT a.cluster, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.cluster = b.cluster AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.cluster = a.cluster
GROUP BY ALL HAVING bool_and((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) > 0 OR ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) = 0 AND (c.x-a.x)*(c.x-b.x)+(c.y-a.y)*(c.y-b.y) <= 0))),
f AS (SELECT cluster, min({{'x': x, 'y': y}}) AS s FROM p GROUP BY 1), h AS (SELECT cluster, 0 AS pos, s.x AS x, s.y AS y, s FROM f WHERE cluster IN (SELECT cluster FROM e GROUP BY 1 HAVING count(*) > 2) UNION ALL SELECT h.cluster, pos + 1, e.bx, e.by_, h.s FROM h JOIN e ON e.cluster = h.cluster AND e.ax = h.x AND e.ay = h.y WHERE NOT (e.bx = h.s.x AND e.by_ = h.s.y)) SELECT cluster, pos::INT AS pos, round(x, 6) AS x, round(y, 6) AS y FROM h""")
def convex_hulls(spark, sf):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h = K.hull(frame[["x", "y"]].to_numpy())
        return pd.DataFrame({"cluster": frame["cluster"].iloc[0], "pos": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    # a point that is not outermost in its cell of a coarse grid of directions stays out before any cluster is gathered
    return C.outermost(points(spark, sf).select("cluster", "x", "y")).groupBy("cluster").applyInPandas(run, "cluster string, pos int, x double, y double").withColumns({c: F.round(c, 6) for c in "xy"})


@query("""WITH f AS (SELECT source AS cluster, min(doc_id) AS first FROM documents GROUP BY 1) SELECT cluster, 'C' || lpad(row_number() OVER (ORDER BY first)::VARCHAR, greatest(2, length(row_number() OVER (ORDER BY first)::VARCHAR))::INT, '0') AS label FROM f""")
def label_normalise(spark, sf):
    s = sequences(spark, sf).select("ord", F.col("source").alias("cluster"))
    return C.first_seen_labels(s, "cluster", "C", 2)


_CONT = """WITH r AS (SELECT lang AS u, quality AS v FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL), n AS (SELECT u, v, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT u, sum(n) AS n FROM n GROUP BY 1), b AS (SELECT v, sum(n) AS n FROM n GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM n)"""


def _labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")


@query(_CONT + """, h AS (SELECT (SELECT -sum(n/t*ln(n/t)) FROM a, t) AS hu, (SELECT -sum(n/t*ln(n/t)) FROM b, t) AS hv, (SELECT -sum(n/t*ln(n/t)) FROM n, t) AS hj) SELECT round(2*(hu+hv-hj)/(hu+hv), 6) AS nmi FROM h""")
def nmi_lang_quality(spark, sf):
    return C.nmi(_labelled(spark, sf), "lang", "quality").select(F.round("nmi", 6).alias("nmi"))


@query(_CONT + """, p AS (SELECT (SELECT sum(n*(n-1)/2) FROM n) AS p, (SELECT sum(n*(n-1)/2) FROM a) AS pu, (SELECT sum(n*(n-1)/2) FROM b) AS pv, (SELECT t*(t-1)/2 FROM t) AS al) SELECT round((p - pu*pv/al)/((pu+pv)/2 - pu*pv/al), 6) AS ari FROM p""")
def ari_lang_quality(spark, sf):
    return C.ari(_labelled(spark, sf), "lang", "quality").select(F.round("ari", 6).alias("ari"))


_AGREE = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {a} AS u, {b}::VARCHAR AS v FROM documents JOIN labels USING (doc_id)" for a in ("lang", "source") for b in ("quality", "toxic"))


@query(f"""WITH l AS ({_AGREE}), n AS (SELECT "left", "right", u, v, count(*) AS n FROM l WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL), t AS (SELECT "left", "right", sum(n) AS t, sum(n*ln(n)) AS l FROM n GROUP BY ALL),
a AS (SELECT "left", "right", sum(n*ln(n)) AS l FROM (SELECT "left", "right", u, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL), b AS (SELECT "left", "right", sum(n*ln(n)) AS l FROM (SELECT "left", "right", v, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL)
SELECT t."left", t."right", round(2*((ln(t)-a.l/t)+(ln(t)-b.l/t)-(ln(t)-t.l/t))/((ln(t)-a.l/t)+(ln(t)-b.l/t)), 6) AS nmi FROM t JOIN a USING ("left", "right") JOIN b USING ("left", "right")""")
def agreement_matrix(spark, sf):
    return C.agreement(_labelled(spark, sf), ["lang", "source"], ["quality", "toxic"]).withColumn("nmi", F.round("nmi", 6))


@query("""WITH f AS (SELECT lang, 100.0*count(*)/sum(count(*)) OVER () AS p FROM documents GROUP BY 1), g AS (SELECT lang, 100.0*count(*)/sum(count(*)) OVER () AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT round(corr(coalesce(f.p,0), coalesce(g.p,0)), 6) AS r, count(*)::BIGINT AS clusters FROM f FULL JOIN g USING (lang)""")
def pearson_composition(spark, sf):
    return C.pearson_composition(table(spark, sf, "documents"), _labelled(spark, sf), "lang").withColumn("r", F.round("r", 6))


@query("""WITH c AS (SELECT source AS cluster, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT cluster, sum(n)::BIGINT AS members, sum(n) FILTER (lang = 'en')::BIGINT AS genomes, coalesce(sum(n) FILTER (lang = 'de'), 0)::BIGINT AS refs FROM c GROUP BY 1""")
def export_counts(spark, sf):
    rows = sequences(spark, sf).select(F.col("source").alias("cluster"), F.when(F.col("cluster") == "en", "").when(F.col("cluster") == "de", "reference").otherwise("other").alias("item_class"))
    return C.export_summary(rows).select("cluster", "members", "genomes", F.col("references").alias("refs"))


# ------------------------------------------------------------------ neighbours

_NN = f"""WITH p AS {PTS}, q AS (SELECT * FROM p WHERE id % 50 = 0), d AS (SELECT q.id, p.id AS other, sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS d, p.cluster FROM q, p WHERE q.id <> p.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM d)"""


def _searches(spark, sf, k):
    """The stated query set: every id divisible by 50, against all points."""
    p = points(spark, sf)
    return C.nearest(p.where(F.col("id") % 50 == 0), p, k)


@query(_NN + """ SELECT id, other, round(d, 6) AS d, rank::INT AS rank FROM k WHERE rank <= 10""")
def knn_search(spark, sf):
    return _searches(spark, sf, 10).select("id", "other", F.round("d", 6).alias("d"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH s AS (SELECT doc_id AS id, {ACGT} AS q FROM documents), g AS (SELECT id, substring(q, i::INT, 3) AS kmer FROM s, range(1, greatest(length(q)-1, 1)) t(i) WHERE length(q) >= 3),
f AS (SELECT id, kmer, (count(*) / sum(count(*)) OVER (PARTITION BY id))::FLOAT AS v FROM g GROUP BY id, kmer), c AS (SELECT substring('ACGT', (i // 16 + 1)::INT, 1) || substring('ACGT', (i // 4 % 4 + 1)::INT, 1) || substring('ACGT', (i % 4 + 1)::INT, 1) AS kmer, i FROM range(64) t(i)),
v AS (SELECT s.id, list(coalesce(f.v, 0)::DOUBLE ORDER BY c.i) AS v FROM s CROSS JOIN c LEFT JOIN f ON f.id = s.id AND f.kmer = c.kmer GROUP BY s.id), k AS (SELECT a.id, b.id AS other, round(list_distance(a.v, b.v), 9) AS d FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM k) SELECT id, other, round(d, 6) AS d, rank::INT AS rank FROM r WHERE rank <= 10""")
def knn_kmer_profiles(spark, sf):
    """The sequences nearest to every fiftieth one by their 3-mer frequencies, in 64 dimensions."""
    v = M.kmer_vectors(sequences(spark, sf), 3).select("id", "vector")
    return X.nearest_vectors(v.where("id % 50 = 0"), v, 10).select("id", "other", F.round("d", 6).alias("d"), F.col("rank").cast("int").alias("rank"))


@query(_NN + """, n AS (SELECT * FROM k WHERE rank <= 10), s AS (SELECT quantile_cont(d, 0.5) AS s FROM n WHERE d > 0) SELECT least(id, other) AS src, greatest(id, other) AS dst, round(max(exp(-d*d/(2*s*s))), 6) AS w FROM n, s GROUP BY 1, 2""")
def knn_edges_gaussian(spark, sf):
    return C.gaussian_edges(_searches(spark, sf, 10)).withColumn("w", F.round("w", 6))


@query(_NN.replace(" WHERE id % 50 = 0", "") + """, n AS (SELECT * FROM k WHERE rank <= 10), s AS (SELECT quantile_cont(d, 0.5) AS s FROM n WHERE d > 0) SELECT least(id, other) AS src, greatest(id, other) AS dst, round(max(exp(-d*d/(2*s*s))), 6) AS w FROM n, s GROUP BY 1, 2""")
def knn_graph_gaussian(spark, sf):
    """The whole graph: edges from every point, and sigma over all of them."""
    p = points(spark, sf)
    return C.gaussian_edges(C.nearest(p, p, 10)).withColumn("w", F.round("w", 6))


@query(_NN + """, v AS (SELECT id, cluster, count(*) AS n, min(rank) AS f FROM k WHERE rank <= 25 GROUP BY ALL) SELECT id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS r FROM v) WHERE r = 1""")
def reference_vote_25nn(spark, sf):
    return C.majority_vote(_searches(spark, sf, 25), points(spark, sf))


@query(_NN.replace("WITH", "WITH RECURSIVE", 1).replace(" WHERE id % 50 = 0", "") + """, e AS (SELECT DISTINCT id AS a, other AS b FROM k WHERE rank <= 3), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, component) AS (SELECT id, id FROM p UNION SELECT u.b, r.component FROM r JOIN u ON u.a = r.id) SELECT id, min(component)::BIGINT AS component FROM r GROUP BY 1""")
def graph_components(spark, sf):
    p = points(spark, sf)
    edges = C.gaussian_edges(C.nearest(p, p, 3))
    return C.connected(p.select("id"), edges)


@query()
def graph_communities(spark, sf):
    """Communities of the whole neighbour graph, by rounds over its edges."""
    p = points(spark, sf)
    return leiden(p.select("id"), C.gaussian_edges(C.nearest(p, p, 10)))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("cluster"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


_REF = """WITH v AS (SELECT vec_id AS id, 'L' || label AS cluster, unnest(range(1, len(embedding)+1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT cluster AS ref_id, i, avg(v) AS c FROM v GROUP BY ALL), n AS (SELECT id, sqrt(sum(v*v)) AS n FROM v GROUP BY 1), m AS (SELECT ref_id, sqrt(sum(c*c)) AS m FROM c GROUP BY 1),
s AS (SELECT v.id, c.ref_id, round(100*sum(v.v*c.c)/any_value(n.n*m.m), 6) AS identity FROM v JOIN c USING (i) JOIN n ON n.id = v.id JOIN m ON m.ref_id = c.ref_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY identity DESC, ref_id DESC) AS r FROM s)"""


def _identities(spark, sf):
    """Cosine per cent of every vector to each label's mean vector: a few references, broadcast."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    means = _vectors(spark, sf).groupBy(F.col("cluster").alias("ref_id"), "i").agg(F.avg("v").alias("c")).groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs")).select("ref_id", F.transform("cs", lambda x: x.c).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    identity = 100 * dot(F.col("e"), F.col("c")) / F.sqrt(dot(F.col("e"), F.col("e"))) / F.sqrt(dot(F.col("c"), F.col("c")))
    return v.crossJoin(F.broadcast(means)).select("id", F.lit("genome").alias("item_class"), F.col("ref_id").alias("ref_ord"), "ref_id", F.round(identity, 6).alias("identity"))


@query(_REF + """ SELECT id, 'genome' AS item_class, max(ref_id) FILTER (r = 1) AS best_ref_id, round(max(identity) FILTER (r = 1), 4) AS best_identity, max(ref_id) FILTER (r = 2) AS second_ref_id, round(max(identity) FILTER (r = 2), 4) AS second_identity, max(identity) FILTER (r = 1) < 40 AS candidate_novel FROM r GROUP BY id""")
def best_second_reference(spark, sf):
    return C.top_references(_identities(spark, sf), 40.0).withColumns({"best_identity": F.round("best_identity", 4), "second_identity": F.round("second_identity", 4)})


@query(_REF + """ SELECT count(*) FILTER (best < 40)::BIGINT AS novel, ceil(count(*)/60.0)::BIGINT AS smallest_lineage FROM (SELECT id, max(identity) AS best FROM s GROUP BY 1)""")
def novelty_count(spark, sf):
    best = _identities(spark, sf).groupBy("id").agg(F.max("identity").alias("best"))
    return best.agg(F.count_if(F.col("best") < 40).alias("novel"), F.ceil(F.count(F.lit(1)) / 60).cast("bigint").alias("smallest_lineage"))


@query(f"""SELECT round(quantile_cont(x, 0.01), 6) AS x_low, round(quantile_cont(x, 0.99), 6) AS x_high, round(quantile_cont(y, 0.01), 6) AS y_low, round(quantile_cont(y, 0.99), 6) AS y_high FROM {PTS}""")
def axis_bounds(spark, sf):
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return points(spark, sf).agg(q("x", 0.01).alias("x_low"), q("x", 0.99).alias("x_high"), q("y", 0.01).alias("y_low"), q("y", 0.99).alias("y_high"))


# ---------------------------------------------------- matrices over cluster means


def _mean_matrix(spark, sf) -> tuple[list[str], np.ndarray]:
    """Distances between the labels' mean vectors: a fixed few rows on the driver."""
    rows = _vectors(spark, sf).groupBy("cluster", "i").agg(F.avg("v").alias("c")).toPandas().pivot(index="cluster", columns="i", values="c").sort_index()
    v = rows.to_numpy()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    return list(rows.index), d


@query("""WITH v AS (SELECT 'L' || label AS cluster, unnest(range(1, len(embedding)+1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT cluster, i, avg(v) AS c FROM v GROUP BY ALL), n AS (SELECT cluster, sqrt(sum(c*c)) AS n FROM c GROUP BY 1),
d AS (SELECT a.cluster AS i, b.cluster AS j, CASE WHEN any_value(a.cluster) = any_value(b.cluster) THEN 0 ELSE 1 - sum(a.c*b.c)/any_value(na.n*nb.n) END AS d FROM c a JOIN c b ON a.i = b.i JOIN n na ON na.cluster = a.cluster JOIN n nb ON nb.cluster = b.cluster GROUP BY ALL), q AS (SELECT i, j, d*d AS q FROM d)
SELECT i, j, round(-0.5*(q - avg(q) OVER (PARTITION BY i) - avg(q) OVER (PARTITION BY j) + avg(q) OVER ()), 6) + 0.0 AS gram FROM q""")
def pcoa_gram(spark, sf):
    c = _vectors(spark, sf).groupBy("cluster", "i").agg(F.avg("v").alias("c"))
    n = c.groupBy("cluster").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    c = c.join(n, "cluster")
    a, b = (c.select(F.col("cluster").alias(k), "i", F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    d = a.join(b, "i").groupBy("a", "b").agg(F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.sum(F.col("ca") * F.col("cb")) / F.max(F.col("na") * F.col("nb"))).alias("d")).withColumn("q", F.col("d") * F.col("d"))
    gram = -0.5 * (F.col("q") - F.avg("q").over(W.partitionBy("a")) - F.avg("q").over(W.partitionBy("b")) + F.avg("q").over(W.partitionBy()))  # a label matrix
    return d.select(F.col("a").alias("i"), F.col("b").alias("j"), (F.round(gram, 6) + 0.0).alias("gram"))


@query()
def pcoa_coords(spark, sf):
    ids, d = _mean_matrix(spark, sf)
    xy, values = K.pcoa(d)
    pct = K.variance_explained(values)
    rows = [(i, float(xy[k, 0]), float(xy[k, 1]), float(pct[0]), float(pct[1])) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, pcoa1 double, pcoa2 double, pct1 double, pct2 double")


@query()
def threshold_summary(spark, sf):
    ids, d = _mean_matrix(spark, sf)
    tree = K.complete_linkage(d)
    sizes = points(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = [(float(t), i, int(c)) for t in (0.2, 0.5, 0.8, 0.9, 1.0, 1.1) for i, c in zip(ids, K.cut_tree(tree, len(ids), t), strict=True)]
    cut = spark.createDataFrame(rows, "threshold double, cluster string, merged int").join(sizes, "cluster")
    return cut.groupBy("threshold", "merged").agg(F.sum("n").alias("n")).groupBy("threshold").agg(F.count(F.lit(1)).alias("cluster_count"), F.max("n").alias("largest_genome_cluster"))


@query()
def closest_threshold(spark, sf):
    return threshold_summary(spark, sf).agg(F.min_by("threshold", F.struct(F.abs(F.col("cluster_count") - 4), "threshold")).alias("threshold"))


@query()
def threshold_clusters(spark, sf):
    """Complete-linkage groups of all sequences by k-mer distance, at four thresholds."""
    s = sequences(spark, sf).select("id", S.acgt(F.col("seq")).alias("seq"))
    pairs = M.similar_pairs(s, 15, 98.1).select(F.col("a").alias("i"), F.col("b").alias("j"), (1 - F.col("identity") / 100).alias("v"))
    return L.threshold_sizes(L.threshold_groups(s, pairs, [0.002, 0.005, 0.01, 0.019]))


@query()
def nj_tree(spark, sf):
    ids, d = _mean_matrix(spark, sf)
    edges = K.neighbor_joining(d)
    nodes = K.tree_nodes(edges, len(ids))
    rows = [(n, v["parent"], float(v["length"]), float(v["x"]), float(v["y"]), v["leaf"], ids[n] if n < len(ids) else None) for n, v in nodes.items()]
    return spark.createDataFrame(rows, "node int, parent int, branch_length double, x double, y double, is_leaf boolean, id string")


@query()
def panel_trees(spark, sf):
    """A proportional panel of the embeddings' rows, and the tree of each label's members by their whole vectors, drawn."""
    own = points(spark, sf)
    panel = farthest_point_panel(own, quotas(own, 200)).select("id", "cluster")
    return group_trees(_rows(spark, sf).join(panel, "id"))


@query()
def pairwise_identity(spark, sf):
    """Global alignment identity of the benchmark items' ACGT letters, tile by tile."""
    from clademill.operators.alignment import identity_pairs

    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.col("item_id").alias("id"), S.acgt(F.coalesce("text", F.lit(""))).alias("seq"))
    return identity_pairs(b)


@query()
def explorer_grid(spark, sf):
    """The embedding and clustering grid over the labels' mean vectors."""
    from clademill.plans.stages import run_grid

    ids, d = _mean_matrix(spark, sf)
    x, _ = K.pcoa(d)
    items = spark.createDataFrame([(k, i, [float(v) for v in x[k]]) for k, i in enumerate(ids)], "ord bigint, id string, vector array<double>")
    return run_grid(items, [3], [3, 5], [0.1, 0.5], [0.5, 1.0])


@query()
def explorer_items(spark, sf):
    """The grid over the embeddings' rows, one task per cell: the size of a collection that ``run_grid`` states."""
    from clademill.plans.stages import run_grid

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return run_grid(e, [3], [15], [0.1], [0.5, 1.0], graph_k=30)


_GRAPH = """WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT a.id, b.id AS other, round(list_distance(a.v, b.v), 9) AS d FROM e a JOIN e b ON a.id <> b.id),
n AS (SELECT id, other, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM k) WHERE r <= 15), h AS (SELECT id, list(d ORDER BY d) AS ds, coalesce(min(d) FILTER (d > 0), 0) AS rho, log2(count(*)) AS target FROM n GROUP BY id),
b AS (SELECT id, ds, rho, target, 0 AS step, 0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1::DOUBLE AS sigma FROM h UNION ALL
SELECT id, ds, rho, target, step + 1, low2, high2, CASE WHEN isinf(high2) THEN sigma * 2 ELSE (low2 + high2) / 2 END FROM (SELECT *, CASE WHEN total > target THEN low ELSE sigma END AS low2, CASE WHEN total > target THEN sigma ELSE high END AS high2 FROM (SELECT *, list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0) / sigma))) AS total FROM b WHERE step < 64))),
s AS (SELECT id, rho, greatest(sigma, 1e-3 * (SELECT avg(d) FROM n)) AS sigma FROM b WHERE step = 64), p AS (SELECT least(id, other) AS src, greatest(id, other) AS dst, exp(-greatest(d - rho, 0) / sigma) AS p FROM n JOIN s USING (id))
SELECT src, dst, round(CASE WHEN count(*) = 1 THEN max(p) ELSE min(p) + max(p) - min(p) * max(p) END, 6) AS w FROM p GROUP BY ALL"""


def _rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query(_GRAPH)
def umap_graph(spark, sf):
    """The fuzzy graph of the embeddings' rows by their 15 nearest, in all dimensions."""
    rows = _rows(spark, sf)
    return U.fuzzy_graph(X.nearest_vectors(rows, rows, 15)).withColumn("w", F.round("w", 6))


@query()
def umap_items(spark, sf):
    """The embeddings' rows in the plane, by rounds over that graph."""
    return U.embed(_rows(spark, sf), 15, 0.1)


@query("""WITH v AS (SELECT doc_id AS id, 60 + (n_chars % 41) AS v FROM documents), t AS (SELECT id, v, (v-70)/30.0 AS t FROM v) SELECT id, CASE WHEN v < 70 THEN '#d9d9d9' ELSE printf('#%02x%02x%02x', trunc(247+(8-247)*t)::INT, trunc(251+(81-251)*t)::INT, trunc(255+(156-255)*t)::INT) END AS color FROM t""")
def heatmap_colors(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.heat_color((F.lit(60) + F.col("n_chars") % 41).cast("double")).alias("color"))


# --------------------------------------------------------------- recombination


@query(f"""WITH e AS {EVT}, m AS (SELECT *, list_sort(list_distinct(list_filter([recombinant, parent_a, parent_b], lambda x: x <> ''))) AS members FROM e) SELECT ord, array_to_string(members, ';') AS members, round(least(pvalue, 1), 6) AS p FROM m WHERE len(members) >= 2 AND least(pvalue, 1) <= 0.05""")
def event_pvalue_gate(spark, sf):
    return R.gate(events(spark, sf)).select("ord", F.array_join("members", ";").alias("members"), F.round("p", 6).alias("p"))


@query(f"""WITH e AS {EVT}, m AS (SELECT *, list_sort(list_distinct(list_filter([recombinant, parent_a, parent_b], lambda x: x <> ''))) AS members FROM e), g AS (SELECT * FROM m WHERE len(members) >= 2 AND least(pvalue, 1) <= 0.01), x AS (SELECT *, unnest(members) AS a FROM g), y AS (SELECT *, unnest(members) AS b FROM x), pr AS (SELECT * FROM y WHERE a < b)
SELECT DISTINCT p.ord AS a, q.ord AS b FROM pr p JOIN pr q ON p.a = q.a AND p.b = q.b AND p.ord < q.ord WHERE greatest(0, least(p."end", q."end") - greatest(p."start", q."start")) >= 0.5 * least(p."end"-p."start", q."end"-q."start") OR (abs(p."start"-q."start") <= 100 AND abs(p."end"-q."end") <= 100)""")
def event_pairs_compatible(spark, sf):
    return R.compatible_pairs(R.gate(events(spark, sf), 0.01))


@query()
def consensus_events(spark, sf):
    e = R.consensus(events(spark, sf), min_methods=2, pvalue_max=0.01)
    return e.withColumns({"members": F.array_join("members", ";"), "methods": F.array_join("methods", ",")})


_FEATURES = [("rep", 1, 1200), ("ren", 1100, 1500), ("trap", 1400, 1900), ("cp", 2600, 3400), ("pre", 3500, 3600)]


_SPREAD = "SELECT event_id AS id, event_id * 37 AS \"start\", event_id * 37 + 100 + event_id % 211 AS \"end\" FROM events"


@query(f"""WITH e AS ({_SPREAD}), f AS (SELECT doc_id AS id, doc_id * 370 AS "start", doc_id * 370 + n_chars % 900 AS "end" FROM documents), x AS (SELECT e.id, count(*) AS n, min(f.id) AS low, max(f.id) AS high FROM e JOIN f ON e.start <= f.end AND f.start <= e.end GROUP BY 1)
SELECT e.id, coalesce(x.n, 0)::BIGINT AS features, x.low, x.high FROM e LEFT JOIN x USING (id)""")
def overlaps_by_place(spark, sf):
    """Events along one long genome, and how many features of it each overlaps."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 37).alias("start"), (F.col("event_id") * 37 + 100 + F.pmod("event_id", F.lit(211))).alias("end"))
    f = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 370).alias("start"), (F.col("doc_id") * 370 + F.pmod("n_chars", F.lit(900))).alias("end"))
    met = V.overlapping(e, f).groupBy(F.col("left").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("right").alias("low"), F.max("right").alias("high"))
    return e.join(met, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("features"), "low", "high")


@query(f"""WITH e AS {EVT}, f(ord, name, s, t) AS (VALUES (0,'rep',1,1200),(1,'ren',1100,1500),(2,'trap',1400,1900),(3,'cp',2600,3400),(4,'pre',3500,3600)), h AS (SELECT e.ord, string_agg(name, ',' ORDER BY f.ord) AS features FROM e JOIN f ON NOT (e."end" < f.s OR e."start" > f.t) GROUP BY 1) SELECT e.ord, coalesce(features, 'none') AS features FROM e LEFT JOIN h USING (ord)""")
def feature_overlap(spark, sf):
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(_FEATURES)], "ord bigint, name string, start int, end int")
    return R.feature_overlap(events(spark, sf), f).select("ord", "features")


@query("""WITH t AS (SELECT item_id AS key, upper(replace(replace(coalesce(text,''),'-',''),'ß','SS')) AS rec, lead(upper(replace(replace(coalesce(text,''),'-',''),'ß','SS'))) OVER (ORDER BY item_id) AS pa, lag(upper(replace(replace(coalesce(text,''),'-',''),'ß','SS'))) OVER (ORDER BY item_id) AS pb FROM benchmark), s AS (SELECT key, i-1 AS i, substring(rec, i::INT, 1) AS r, substring(pa, i::INT, 1) AS a, substring(pb, i::INT, 1) AS b FROM t, range(1, 2000) x(i) WHERE pa IS NOT NULL AND pb IS NOT NULL AND i <= least(length(rec), length(pa), length(pb))), q AS (SELECT *, i >= 20 AND i < 60 AS t FROM s WHERE a <> b)
SELECT key, count(*) FILTER (t AND r = a)::INT AS tract_a, count(*) FILTER (t AND r = b)::INT AS tract_b, count(*) FILTER (t)::INT AS tract_n, count(*) FILTER (NOT t AND r = a)::INT AS flank_a, count(*) FILTER (NOT t AND r = b)::INT AS flank_b, count(*) FILTER (NOT t)::INT AS flank_n FROM q GROUP BY 1""")
def site_tally(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), S.normalise(F.coalesce("text", F.lit(""))).alias("rec"))
    w = W.orderBy("key")  # the benchmark is a small panel
    t = b.withColumns({"pa": F.lead("rec").over(w), "pb": F.lag("rec").over(w), "start": F.lit(20), "end": F.lit(60)}).where("pa IS NOT NULL AND pb IS NOT NULL")
    return R.tally_sites(t)


# ------------------------------------------------------------- strings and hits


@query("""WITH s AS (SELECT event_id AS id, 'k' || (event_id % 9) || '_n' || (event_id % 200) || '_d0p' || (event_id % 10) || CASE WHEN event_id % 2 = 0 THEN '_r1e-0' || (1 + event_id % 6) ELSE '' END AS state FROM events) SELECT id, state, regexp_extract(state, '^k(\\d+)', 1)::INT AS k, regexp_extract(state, '_n(\\d+)', 1)::INT AS neighbors, replace(regexp_extract(state, '_d([0-9p]+)', 1), 'p', '.')::DOUBLE AS min_dist, nullif(regexp_extract(state, '_r(.+)$', 1), '')::DOUBLE AS resolution FROM s""".replace("\\\\d", "\\d"))
def state_slug_parse(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("k"), F.col("event_id") % 9, F.lit("_n"), F.col("event_id") % 200, F.lit("_d0p"), F.col("event_id") % 10, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("_r1e-0"), 1 + F.col("event_id") % 6)).otherwise("")).alias("state"))
    return e.withColumn("f", S.state_fields(F.col("state"))).select("id", "state", "f.*")


@query("""SELECT p_partkey AS id, coalesce(nullif(trim(regexp_replace(p_name || ' #' || p_size || '!', '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'cluster') AS slug FROM part""")
def slug_sanitise(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.safe_slug(F.concat("p_name", F.lit(" #"), "p_size", F.lit("!"))).alias("slug"))


@query("""WITH m AS (SELECT s_suppkey AS ord, s_name AS label, 'x' || (s_suppkey % 7) || ', y' || s_suppkey || '; z' || (s_suppkey % 3) || ';;' AS o FROM supplier), i AS (SELECT ord, label, unnest(string_split_regex(o, '[,;]')) AS id, unnest(range(len(string_split_regex(o, '[,;]')))) AS pos FROM m) SELECT trim(id) AS id, arg_max(label, ord*1000+pos) AS label FROM i WHERE trim(id) <> '' GROUP BY 1""")
def label_map_explode(spark, sf):
    from clademill.sources.fasta import explode_label_map

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("identified_id"), F.concat(F.lit("x"), F.col("s_suppkey") % 7, F.lit(", y"), "s_suppkey", F.lit("; z"), F.col("s_suppkey") % 3, F.lit(";;")).alias("orig_ids"))
    return explode_label_map(s)


@query("""SELECT qseqid, sseqid, pident, bitscore FROM (SELECT l_orderkey AS qseqid, l_partkey AS sseqid, l_discount*1000 AS pident, l_extendedprice AS bitscore, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem WHERE l_discount*1000 >= 20 AND l_quantity >= 5) WHERE r = 1""")
def best_hit(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("ord"), F.col("l_orderkey").alias("qseqid"), F.col("l_partkey").alias("sseqid"), (F.col("l_discount") * 1000).alias("pident"), F.col("l_quantity").alias("qcovs"), F.col("l_extendedprice").alias("bitscore"))
    return C.best_hit(h, 20, 5).drop("qcovs")


@query("""WITH h AS (SELECT l_orderkey, max(l_discount*1000) AS pident FROM lineitem GROUP BY 1) SELECT CASE WHEN pident >= 91 THEN 'species' WHEN pident >= 75 THEN 'below' ELSE 'unassigned' END AS category, count(*)::BIGINT AS n FROM h GROUP BY 1""")
def category_counts(spark, sf):
    h = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_discount") * 1000).alias("pident"))
    return h.groupBy(F.when(F.col("pident") >= 91, "species").when(F.col("pident") >= 75, "below").otherwise("unassigned").alias("category")).agg(F.count(F.lit(1)).alias("n"))
