"""Memory of the toxicity fit, and content-defined chunks of a text's own lines."""

import tracemalloc

import numpy as np

from clademill.llm import line_dedup as L
from clademill.llm import toxicity as T


def test_features_without_a_column_take_no_memory():
    rng = np.random.default_rng(2)
    per = [np.sort(rng.choice(200_000, 5_000, replace=False)).astype(np.int32) for _ in range(400)]
    column = np.full(200_000, -1)
    column[rng.choice(200_000, 300, replace=False)] = np.arange(300)
    tracemalloc.start()
    row, col = T._rows(per, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [(i, int(column[f])) for i, own in enumerate(per) for f in own if column[f] >= 0]
    assert list(zip(row.tolist(), col.tolist(), strict=True)) == want
    assert peak < 4_000_000  # two million features, a few thousand of them known


def test_own_lines_have_hashed_boundaries_and_their_pairs_once():
    rng = np.random.default_rng(4)
    text = "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 999, 5)) for _ in range(200)).encode()
    _, spans, _, pieces = L.chunks([text])
    own = [(s >> 32, (s & 0xFFFFFFFF) >> 1) for s in spans if s & 1]
    lines = sorted((e - s) // 5 for s, e in own)
    assert lines[-1] > 2 and len(own) == len(set(own))  # chunks between boundaries, each once
    assert {(5 * i, 5 * i + 10) for i in range(199)} <= set(own)  # and each two lines that follow one another
