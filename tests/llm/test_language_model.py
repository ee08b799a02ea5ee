"""The word tree against a plain restatement over blocks of any size, and on unusual rows."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.llm import lm_score as M

WORDS = [f"w{i}x{i * i % 97}" for i in range(200)]


@pytest.fixture()
def rng():
    return np.random.default_rng(51)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, True, "x") for i, t in rows], "doc_id bigint, text string, kind int, t int, train boolean, held string")


def _fold(i):
    return zlib.crc32(str(i).encode()) % 5


def _letters(words):
    codes, n = M.gram_counts(sorted(words))
    least = max(2, math.ceil(n.sum() * M.MIN_SHARE)) if len(n) else 2
    tables = [defaultdict(dict) for _ in range(M.DEPTH + 1)]
    for d in range(M.DEPTH + 1):
        for code, k in zip(codes.tolist(), n.tolist(), strict=True):
            gram = int(code).to_bytes(M.DEPTH + 1, "big")
            own = tables[d][gram[M.DEPTH - d : M.DEPTH]]
            own[gram[-1]] = own.get(gram[-1], 0) + k
        if d:
            tables[d] = {c: v for c, v in tables[d].items() if sum(v.values()) >= least}
    return M.build_tree(tables)


def _plain(rows):
    texts = [(i, ["start", "start", *(t or "").encode().lower().split(), None]) for i, t in rows]
    train = [w for i, w in texts if i is not None and _fold(i) != 1]
    runs = [Counter(tuple(d[i - k : i + 1]) for d in train for i in range(2, len(d))) for k in range(3)]
    after = [Counter(tuple(d[i - k : i]) for d in train for i in range(2, len(d))) for k in range(3)]
    n, v = sum(runs[0].values()), len(runs[0])
    new = min(max(sum(c == 1 for c in runs[0].values()), 1) / n, 0.5) if n else 1.0
    tree, out = _letters({w for d in train for w in d[2:-1]}), []
    for i, d in texts:
        base = score = 0.0
        for j in range(2, len(d)):
            c = runs[0][d[j],]
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            p = c / n * (1 - new) if c else new * 10 ** float(tree.scores([d[j] or b""])[0])
            for k in (1, 2):
                context, c = after[k][tuple(d[j - k : j])], runs[k][tuple(d[j - k : j + 1])]
                if context:
                    c = c if c and c * math.log(c / context / p) >= M.MIN_DIVERGENCE else 0
                    p = (c + context ** M.WEIGHTS[k - 1] * p) / (context + context ** M.WEIGHTS[k - 1])
            score += math.log10(p)
        out.append((i, None if i is None else _fold(i) == 1, len(d) - 2, sum(runs[0][w,] > 0 for w in d[2:]), n, base, score))
    return out


def _rows(rng):
    chain = {w: rng.choice(WORDS, 3) for w in WORDS}

    def text(n):
        out = [rng.choice(WORDS)]
        for _ in range(n - 1):
            out.append(rng.choice(chain.get(out[-1], WORDS)) if rng.random() < 0.7 else f"new{rng.integers(10**6)}" if rng.random() < 0.1 else rng.choice(WORDS))
        return " ".join(out)

    rows = [(i, text(int(rng.integers(1, 90)))) for i in range(160)]
    return rows + [(200, rows[3][1]), (5, rows[5][1]), (7, "other text of 7"), (None, text(20)), (None, None), (300, None), (301, ""), (302, " \n"), (303, "ÜNÏ \U0001f600 É"), (304, "A" * 3000), (305, text(30_000))]


@pytest.mark.parametrize("size", [10**9, 3000])
def test_equals_a_plain_restatement(spark, rng, monkeypatch, size):
    monkeypatch.setattr(M, "BLOCK_BYTES", size)
    rows = _rows(rng)
    if size < 10**9:
        monkeypatch.setattr(M, "RANGE_BYTES", 400)
        monkeypatch.setattr(M, "fit_tree", lambda grams: _letters({w for i, t in rows if i is not None and _fold(i) != 1 for w in (t or "").encode().lower().split()}))  # blocks count a word once each
    docs = _docs(spark, rows)
    got = sorted(map(tuple, M.lm_query(docs.coalesce(1) if size == 10**9 else docs).collect()), key=str)
    want = sorted(_plain(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)


def test_what_is_kept_grows_with_the_corpus_and_beats_the_base(spark, rng):
    kept, above = [], []
    for n in (150, 600):
        chain = {w: rng.choice(WORDS, 3) for w in WORDS}
        rows = []
        for i in range(n):
            out = [rng.choice(WORDS)]
            for _ in range(120):
                out.append(rng.choice(chain[out[-1]]) if rng.random() < 0.8 else f"x{rng.integers(n)}")
                if out[-1] not in chain:
                    out.append(rng.choice(WORDS))
            rows.append((i, " ".join(out)))
        docs = _docs(spark, rows).select("doc_id", "text")
        totals = M._totals(M._counted(M._blocks(docs), 16), 16).where("block IS NULL")
        kept.append({r.kind: (r.v, r.n) for r in totals.groupBy("kind").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()})
        train = [t.split() for i, t in rows if _fold(i) != 1]
        assert kept[-1][0][1] == kept[-1][1][1] == kept[-1][2][1] == sum(len(t) + 1 for t in train)
        assert kept[-1][1][0] == len({p for t in train for p in zip(["", *t], [*t, ""], strict=True)})
        held = [r for r in M.lm_query(docs).collect() if r.held_out]
        above.append(sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held))
    assert kept[1][2][0] > 2 * kept[0][2][0] and min(above) > 0.3


def test_probabilities_after_a_context_sum_to_at_most_one(rng):
    for _ in range(20):
        p = rng.dirichlet(np.full(50, 0.3)) * 0.95 + 1e-12
        n = rng.integers(0, 4, 50) * (rng.random(50) < 0.3)
        out = M.smoothed(p, n, np.full(50, max(1, n.sum())), 0.8)
        assert 0.3 < out.sum() <= 1 + 1e-9 and (out > 0).all()
        assert (M.smoothed(p, n, np.zeros(50, int), 0.8) == p).all()


def test_counts_travel_as_they_are(rng):
    for top in (2, 300, 70_000, 1 << 40):
        n = rng.integers(0, top, 99)
        n[0] = top - 1
        assert (M._large(M._small(n), 99) == n).all()
    assert len(M._large(M._small(np.zeros(0, int)), 0)) == 0
    keys = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    for parts in (8, 51, 1000):
        of = M._ranges(keys, parts)
        assert (np.diff(of.astype(int)) >= 0).all() and of.max() < parts
        assert all(M._low(i, parts) <= keys[of == i].min() for i in np.unique(of).tolist())
        near = (keys - np.array([M._low(i, parts) for i in of.tolist()], np.uint64)) >> M._shift(parts)
        assert near.max() < 1 << 33
    for keys in (np.array([5], np.uint64), np.array([0, 0, 3, 1 << 62], np.uint64), np.sort(rng.integers(0, 1 << 32, 300).astype(np.uint64)), np.zeros(0, np.uint64)):
        assert (M._numbers(M._steps(keys)) == keys).all()


def test_empty_table(spark):
    assert M.lm_query(_docs(spark, [])).count() == 0
    only = M.lm_query(_docs(spark, [(next(i for i in range(99) if _fold(i) == 1), "a b")])).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.held_out) == (3, 0, 0, True) and only.score < 0 and only.base_score == pytest.approx(0.0)


def test_the_base_needs_no_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 5} word{i}") for i in range(60)] + [(60, None), (None, "no id")], "doc_id bigint, text string")
    whole = M.score_documents(docs)
    want = sorted(map(str, whole.drop("score").collect()))
    monkeypatch.setattr(M, "fit_tree", None)
    monkeypatch.setattr(M, "gram_counts", None)
    base = M.score_documents(docs, tree=False)
    assert base.columns == whole.columns[:-1] and sorted(map(str, base.collect())) == want


@pytest.mark.parametrize("new", [0, 7])
def test_a_block_is_scored_in_little_memory(rng, new):
    """Whole arrays of 64 bits, three orders side by side, took 145 bytes a token."""
    words = np.array([f"w{i}" for i in range(3000)])
    raws = [" ".join(rng.choice(words, int(k))).encode() for k in (*rng.integers(1, 1000, 300), 300_000)] + [b""]
    hashes = M._Words()
    own = [hashes.tokens(r)[1] for r in raws]
    sizes = [len(t) for t in own]
    counts = {}
    for kind, key in enumerate(M._runs(np.concatenate(own), M._heads(sizes))):
        n = np.unique(key, return_counts=True)[1]
        n[:new] = 0
        counts[kind] = [M._as_sent(M._small(x), len(x)) for x in np.array_split(n, 5)]
    tree = M.build_tree([{b"": {s: 1 for s in (*b"w0123456789", M.END)}}, *({} for _ in range(M.DEPTH))])
    tracemalloc.start()
    tokens, known, base, score = M.block_scores(raws, counts, hashes, sum(sizes), len(raws), 6.0, 0.1, tree)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens.tolist() == sizes and (known.sum() < sum(sizes)) == (new > 0) and np.isfinite(base).all() and (score < 0).all()
    assert peak < 70 * sum(sizes)
