"""Rows that share an id, null ids, odd characters, clashing columns and very long texts, by values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.llm import chat, embed_dup, near_dup, toxicity

WORDS = [f"w{i}x{i * i % 97}" for i in range(400)]
TURNS = "conv_id bigint, turn bigint, role string, text string, msg_id string, score string"


@pytest.fixture()
def rng():
    return np.random.default_rng(23)


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n))


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_dup_of_rows_with_one_id(spark, rng):
    a, b, c = _text(rng, 60), _text(rng, 60), _text(rng, 60)
    rows = [(10, a), (10, b), (3, b + " end"), (7, a + " end"), (20, c), (20, None), (21, c), (5, c + " end"), (30, "  ")]
    got = {}
    for r in near_dup.near_dup_query(_docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[3] == [(58, 3, True)] and got[7] == [(58, 3, False)]  # both texts of 10 join their neighbours
    assert sorted(got[10]) == [(57, 3, False), (57, 3, False)]
    assert got[21] == [(57, 5, False)] and got[5] == [(58, 5, True)] and sorted(got[20]) == [(0, 20, True), (57, 5, False)]
    assert got[30] == [(0, 30, True)]


def test_near_vectors_of_rows_with_one_id(spark, rng):
    x, y = rng.normal(size=(2, 64))
    near = lambda v: [float(c) for c in v + rng.normal(scale=0.01, size=64)]
    rows = [(10, list(map(float, x))), (10, list(map(float, y))), (3, near(y)), (7, near(x)), (8, [2 * float(c) for c in x]), (None, list(map(float, x)))]
    got = {}
    for r in embed_dup.embed_dup_query(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[3] == [(1, 3, True)] and got[7] == [(2, 3, False)] and got[8] == [(2, 3, False)]
    assert sorted(got[10]) == [(1, 3, False), (2, 3, False)] and got[None] == [(0, None, True)]


@pytest.mark.parametrize("dim", [2, 3, 5, 8, 16, 64, 256])
def test_pairs_at_the_bound_meet_in_a_filter(dim):
    rng = np.random.default_rng(dim)
    n = 300 if dim < 256 else 100
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = embed_dup.CapCode(dim, size=embed_dup.book_size(dim))
    low = code.decode(x)
    assert np.mean([len(c) for c in low]) < 700
    for cosine in (0.9, 0.925, 0.95):
        other = code.decode(cosine * x + np.sqrt(1 - cosine**2) * z)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(low, other, strict=True)]) >= 0.99


def test_many_equal_filters_in_tiles(spark, rng, monkeypatch):
    """A filter over the tile's size, groups of few and of many rows: degrees equal brute force."""
    monkeypatch.setattr(embed_dup, "TILE", 8)
    monkeypatch.setattr(embed_dup, "FEW", 4)
    centre = rng.normal(size=(6, 32))
    x = np.concatenate([centre[i % 6] + rng.normal(scale=0.12, size=32) for i in range(120)]).reshape(120, 32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embed_dup.embed_dup_query(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    assert want.max() > 10 and [got[i] for i in range(120)] == want.tolist()


def test_chat_of_null_ids_and_odd_roles(spark, rng):
    long = _text(rng, 40_000) + "##</turn>\\"
    roles = ["assistant", "a\u0000b", "\u0000", "\\\n", "\n\\\\n", "x\\", "##\\n</turn>", "", None, "\\n"]
    rows = [(1, k, role, f"t{k}") for k, role in enumerate(roles)] + [(None, 0, "user", "q"), (None, 1, "assistant", long), (None, None, None, None), (4, 0, "assistant", "")]
    got = {r.conv_id: r for r in chat.chat_query(spark.createDataFrame([(*r, "c", "c") for r in rows], TURNS)).collect()}
    assert set(got) == {1, None, 4, -7}
    for conv in (1, None, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_branches_of_null_ids_and_ties(spark):
    messages = spark.createDataFrame([(None, 1, None, 1.0, "user", "q"), (None, 2, 1, 2.0, "assistant", "a"), (None, 3, 1, 2.0, "assistant", "b"), (5, None, 1, 9.0, "user", "no id"), (5, 1, None, 1.0, "user", "root"), (5, 1, None, 1.0, "user", "root again")], "conv_id bigint, msg_id bigint, parent_id bigint, score double, role string, text string")
    got = {(r.conv_id, r.branch, r.turn): (r.leaf_id, r.text) for r in chat.best_branches(messages.withColumn("total", F.lit("own")), top=2).collect()}
    assert got == {(None, 1, 0): (2, "q"), (None, 1, 1): (2, "a"), (None, 2, 0): (3, "q"), (None, 2, 1): (3, "b"), (5, 1, 0): (None, "root"), (5, 1, 1): (None, "no id")}
    assert chat.best_branches(messages.withColumn("total", F.lit("own"))).where("total = 'own'").count() == 4


def test_keep_clean_leaves_the_callers_score(spark):
    model = toxicity.ToxicityModel({"w:vile": 9.0}, -4.0)
    docs = spark.createDataFrame([(1, "fine", 0.75, "x"), (2, "vile", 0.25, "y"), (3, None, None, None)], "doc_id bigint, text string, score double, _score string")
    assert {tuple(r) for r in toxicity.keep_clean(docs, model).collect()} == {(1, "fine", 0.75, "x"), (3, None, None, None)}


def test_training_sample_stops_at_its_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * 90) for i in range(50)] + [(7, "zz")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(4, 1)], "doc_id bigint, toxic int")
    every = toxicity.training_sample(docs, labels)
    assert len(every[0]) == len(every[1]) > 30 and "zz" in every[0]
    monkeypatch.setattr(toxicity, "MAX_TRAINING_CHARS", 1000)
    some = toxicity.training_sample(docs, labels)
    assert some[0] == every[0][: len(some[0])] and 1000 <= sum(map(len, some[0])) < 1100
