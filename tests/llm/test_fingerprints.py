"""Fingerprints: their likeness against exact weighted similarities, and the edited texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.llm import fingerprint


def _similar(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    most = sum(max(a[k], b[k]) for k in {*a, *b})
    return sum(min(a[k], b[k]) for k in {*a, *b}) / most if most else 1.0


def _edited(texts):
    """Texts with their second half from the next one."""
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]


def _rows(spark, rows, parts=3, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return fingerprint.fingerprint_query(docs, **more).collect()


def _texts(n, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" for i in range(300)]
    return [" ".join(rng.choice(words[(i % 3) * 60 :][:120], int(rng.integers(1, 200)))) for i in range(n)]


def test_edited_texts_and_lengths(spark):
    texts = [*_texts(57), "", "x", "ab", "  ", "🦜" * 9]
    got = sorted(_rows(spark, [(10 * i, t or None) for i, t in enumerate(texts)]), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [10 * i for i in range(len(texts))]
    assert [r.n_chars for r in got] == [len(t) for t in texts]
    assert [r.edited_sha256 for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in _edited(texts)]


def test_likeness_is_the_weighted_similarity(spark):
    texts = _texts(120)
    got = sorted(_rows(spark, list(enumerate(texts)), slots=64), key=lambda r: r.doc_id)
    for column, others in (("near_edited", _edited(texts)), ("near_next", texts[1:] + texts[:1])):
        off = np.array([r[column] - _similar(t, o) for r, t, o in zip(got, texts, others, strict=True)])
        assert abs(off.mean()) < 0.02 and off.std() < 0.09, column


@pytest.mark.parametrize("weights", [(1, 1), (1, 4), (3, 7), (10, 100)])
def test_collision_rate_of_one_weight(spark, weights):
    """Documents of one word collide in the share of the smaller weight."""
    rows = [(f"{i}-{n}", f"word{i} " * n) for i in range(60) for n in weights]
    signed = fingerprint.signatures(spark.createDataFrame(rows, "id string, text string"), ["id"], slots=64)
    found = {r.id: r.signature for r in signed.collect()}
    same = np.mean([np.mean([x == y for x, y in zip(found[f"{i}-{weights[0]}"], found[f"{i}-{weights[1]}"], strict=True)]) for i in range(60)])
    assert same == pytest.approx(weights[0] / weights[1], abs=0.03)


def test_equal_texts_have_equal_fingerprints_however_they_are_dealt(spark):
    texts = _texts(40)
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 1000, t) for i, t in enumerate(texts)]
    by_text = {}
    for parts in (1, 7):
        for r in _rows(spark, rows, parts):
            by_text.setdefault(texts[r.doc_id % 1000], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({min(x) for x in by_text.values()}) == len(set(texts))


def test_texts_without_words(spark):
    got = {r.doc_id: r for r in _rows(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "word")])}
    assert [got[i].fingerprint for i in (1, 2, 3)] == ["", "", ""]
    assert [got[i].near_next for i in (1, 2, 3, 4)] == [1.0, 1.0, 0.0, 0.0]
    assert got[4].near_edited < 1 and got[1].near_edited == 1.0


def test_one_document_follows_itself_and_none_gives_none(spark):
    (one,) = _rows(spark, [(5, "a b c d")])
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert _rows(spark, []) == []


def test_rows_of_one_id_without_id_and_clashing_columns(spark):
    """Nulls first, rows of one id by the hash of their text; equal rows may follow each other."""
    rows = [(None, "n one"), (None, "n two words"), (3, "first of three"), (3, "second of three"), (3, "second of three"), (9, "last")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id bigint, text string, bin int, place string, own string")
    tie = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = sorted(zip([str(i) for i, _ in order], [hashlib.sha256(e.encode()).hexdigest() for e in _edited([t for _, t in order])], strict=True))
    got = fingerprint.fingerprint_query(docs).collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == want


def test_a_hot_id_is_dealt_out(spark):
    texts = [f"text {i} " + "w " * (i % 5) for i in range(300)]
    docs = spark.createDataFrame([(4 if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bins = {r["bin"]: r["count"] for r in fingerprint._in_bins(docs).groupBy("bin").count().collect()}
    assert max(bins.values()) < 100 and sum(bins.values()) == 300
    ordered = sorted((r.bin, r.doc_id, r.tie) for r in fingerprint._in_bins(docs).collect())
    assert [x[1:] for x in ordered] == sorted(x[1:] for x in ordered)


def test_a_very_long_text(spark):
    long = "many words and more " * 40_000
    got = sorted(_rows(spark, [(1, long), (2, "short text")]), key=lambda r: r.doc_id)
    assert got[0].n_chars == len(long) and got[0].near_edited > 0.3


def test_only_expressions(spark):
    plan = fingerprint.fingerprint_query(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
