"""The classifier's query against a plain restatement with dense matrices."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from clademill.llm import toxicity as T

WORDS = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]


def _features(text):
    out = set()
    for w in T.WORD.findall((text or "").lower()):
        padded = f"^{w}$"
        out |= {f"w:{w}", f"w:{w.translate(T.LOOKALIKES)}"} | {padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)}
    return out


def _swap(text):
    after = {t: g[(i + 1) % len(g)] for g in T.IDENTITY_GROUPS for i, t in enumerate(g)}
    return T.WORD.sub(lambda m: after.get(m[0].lower(), m[0]), text)


def _plain(texts, labels, l2=0.02, steps=600, rate=0.05):
    y = np.array(labels, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    own = [_features(t) for t in texts]
    ones, zeros = (Counter(f for x, v in zip(own, labels, strict=True) if v == k for f in x) for k in (1, 0))
    gains = {}
    for f, a in ones.items():
        b = zeros[f]
        if a >= 4 and a / n1 > 2 * b / n0:
            log = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
            g = log(a, n1, a / n1) + log(b, n0, b / n0) - log(a + b, len(y), min((a + b) / len(y), 1 - 1e-12))
            if g > 6:
                gains[f] = g
    names = sorted(gains, key=lambda f: (-gains[f], f))[:3000]
    row = lambda s: np.array([float(f in s) for f in names])
    x = np.array([row(s) for s in own])
    pairs = [i for i, t in enumerate(texts) if _swap(t) != t]
    change = np.array([x[i] - row(_features(_swap(texts[i]))) for i in pairs]).reshape(-1, len(names))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(names)), math.log(n1 / n0)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y) * weight
        grad = np.append(x.T @ g + l2 * w / len(names) ** 0.5 + (change.T @ (change @ w) * 2 / len(pairs) if pairs else 0), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    z = x @ w + b
    best, cut = -1.0, 0.0
    for c in sorted(set(z), reverse=True):
        f1 = 2 * y[z >= c].sum() / ((z >= c).sum() + n1)
        if f1 > best + 1e-15:
            below = z[z < c]
            best, cut = f1, (c + (below.max() if len(below) else c - 1)) / 2
    return dict(zip(names, w, strict=True)), b - cut


def test_query_equals_a_plain_restatement(spark):
    rng = np.random.default_rng(61)
    bad = ["vile", "brute", "v1le"]
    rows, labels = [], []
    for i in range(260):
        words = list(rng.choice(WORDS, int(rng.integers(3, 40))))
        toxic = i % 3 == 0
        if toxic:
            words.insert(int(rng.integers(len(words))), bad[i % 2 if i % 7 else 2])
        if i % 6 == 0 or i % 11 == 0:
            words.append(str(rng.choice(["women", "muslims", "gay"])))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "vile"), (902, "VILE " * 20_000)]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    train = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=False) if zlib.crc32(str(i).encode()) % 5]
    weights, bias = _plain([t for t, _ in train], [y for _, y in train])
    for r in T.toxicity_query(docs, marks).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        z = bias + sum(weights.get(f, 0.0) for f in _features(text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3) and r.predicted == (r.score >= 0.5)
    assert sum(w > 0 for w in weights.values()) > 5
