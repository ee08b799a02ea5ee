"""Toxicity: a counterfactual-regularised linear classifier.

Features are presence indicators of words and of character n-grams inside words.
The model is fitted on a bounded sample of labelled rows, on the driver; for each
training text in which an identity term occurs, a copy with the term swapped for
another of its group is made, and the squared change of the logit is penalised.
Scores of all rows are one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.llm.common import fold, fresh, save, tidy

#: Bounds of the training sample: labelled rows, and code points of their whole texts.
MAX_TRAINING_ROWS = 8_000
MAX_TRAINING_CHARS = 30_000_000
#: Words whose features are remembered while fitting, and while scoring.
FIT_MEMO, SCORE_MEMO = 200_000, 200_000

#: Groups of identity terms, each in one language and number: terms of a group are swapped for one another.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["mothers", "fathers"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab", "african"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["old", "young"], ["disabled", "deaf", "blind"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]

#: The term that takes each one's place.
AFTER = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
GRAM_SIZES = (3, 4, 5)


def word_features(word: str) -> set[str]:
    """Features of one lower-case word: itself, its n-grams, and its look-alike reading."""
    padded = f"^{word}$"
    found = {f"w:{word}"} | {padded[i : i + n] for n in GRAM_SIZES for i in range(len(padded) - n + 1)}
    plain = word.translate(LOOKALIKES)
    return found | {f"w:{plain}"} if plain != word else found


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class ToxicityModel:
    """Weights of features; a text's logit sums them over its distinct features."""

    weights: dict[str, float]
    bias: float
    report: dict[str, float] = field(default_factory=dict)

    def logit(self, text: str | None, seen: dict[str, tuple] | None = None) -> float:
        seen = {} if seen is None else seen
        present: set[str] = set()
        for w in set(words(text)):
            hit = seen.get(w)
            if hit is None:
                if len(seen) >= SCORE_MEMO:
                    seen.clear()
                hit = seen[w] = tuple(f for f in word_features(w) if f in self.weights)
            present.update(hit)
        return self.bias + math.fsum(self.weights[f] for f in present)

    def score(self, text: str | None, seen: dict[str, tuple] | None = None) -> float:
        z = self.logit(text, seen)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _swapped(text: str) -> str | None:
    """The text with each identity term replaced by the next of its group; None if it has none."""
    found = False

    def put(m: re.Match) -> str:
        nonlocal found
        other = AFTER.get(m[0].lower())
        found |= other is not None
        return m[0] if other is None else other

    out = WORD.sub(put, text)
    return out if found else None


def _rows(per_text: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones of a sparse indicator matrix; features without a column are left out."""
    # text by text, since most features have no column and the long arrays of all of them would be held several times
    kept = [c[c >= 0] for c in (column[x] for x in per_text)]
    return np.repeat(np.arange(len(kept)), [len(x) for x in kept]), np.concatenate([np.zeros(0, column.dtype), *kept])


def fit(texts: list[str], labels: list[int], *, features: int = 3000, least: int = 4, l2: float = 0.02, counterfactual: float = 1.0, steps: int = 600, rate: float = 0.05) -> ToxicityModel:
    """Fit on texts with 0/1 labels. Without both classes the model is a constant.

    ``features`` of the largest likelihood ratio are kept, of those in ``least``
    texts and more and more frequent in class 1; features of class 0 are left out,
    since they would let long or ordinary text hide an insult. The loss is the
    class-balanced logistic loss, plus ``l2``, plus ``counterfactual`` times the
    mean squared logit change under identity swaps.
    """
    y = np.asarray(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        return ToxicityModel({}, 6.0 if mean > 0.5 else -6.0)
    held = [set(words(t)) for t, v in zip(texts, labels, strict=True) if v]
    seen = Counter(f for own in held for f in set().union(*map(word_features, own)))
    known = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    del held, seen
    memo: dict[str, np.ndarray] = {}

    def feats(own: set[str]) -> np.ndarray:
        """Sorted numbers of the features in ``known`` that the words have."""
        found = [np.zeros(0, np.int64)]
        for w in own:
            hit = memo.get(w)
            if hit is None:
                if len(memo) >= FIT_MEMO:
                    memo.clear()
                hit = memo[w] = np.array([known[f] for f in word_features(w) if f in known], np.int64)
            found.append(hit)
        return np.unique(np.concatenate(found))

    per: list[np.ndarray] = []
    pairs: list[int] = []
    other: list[np.ndarray] = []
    for i, t in enumerate(texts):
        own = set(words(t))
        per.append(feats(own).astype(np.int32))
        if not own.isdisjoint(AFTER) and (swap := _swapped(t)) is not None:
            pairs.append(i)
            other.append(feats(set(words(swap))).astype(np.int32))
    memo.clear()
    n1, n0 = y.sum(), len(y) - y.sum()
    of_class = [np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)]
    for own, v in zip(per, labels, strict=True):
        of_class[int(v > 0)][own] += 1

    def gain(a: int, b: int) -> float:
        if a / n1 <= 2 * b / n0:
            return 0.0
        p, q, m = a / n1, b / n0, (a + b) / len(y)
        term = lambda k, n, x: (k * math.log(x) if k else 0) + ((n - k) * math.log(1 - x) if n > k else 0)
        return term(a, n1, p) + term(b, n0, q) - term(a + b, len(y), min(m, 1 - 1e-12))

    gains = {f: g for f, i in known.items() if (g := gain(int(of_class[1][i]), int(of_class[0][i]))) > 6.0}
    names = sorted(gains, key=lambda f: (-gains[f], f))[:features]
    column = np.full(len(known), -1)
    column[[known[f] for f in names]] = np.arange(len(names))
    rows, cols = _rows(per, column)
    r2, c2 = _rows([np.setdiff1d(per[i], o, assume_unique=True) for i, o in zip(pairs, other, strict=True)], column)
    r3, c3 = _rows([np.setdiff1d(o, per[i], assume_unique=True) for i, o in zip(pairs, other, strict=True)], column)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(names)), math.log(n1 / n0)
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        gw = np.bincount(cols, g[rows], minlength=len(names)) + l2 * w / len(names) ** 0.5
        if pairs:
            change = np.bincount(r2, w[c2], minlength=len(pairs)) - np.bincount(r3, w[c3], minlength=len(pairs))
            change = change * 2.0 * counterfactual / len(pairs)
            gw += np.bincount(c2, change[r2], minlength=len(names)) - np.bincount(c3, change[r3], minlength=len(names))
        grad = np.append(gw, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0.0), b - move[-1]
    z = b + np.bincount(rows, w[cols], minlength=len(y))
    # the threshold of 0.5 is put where the training F1 is largest
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + n1)
    last = np.append(z[order][1:] != z[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    low = z[order][k + 1] if k + 1 < len(y) else z[order][k] - 1
    cut = (z[order][k] + low) / 2
    return ToxicityModel({f: float(x) for f, x in zip(names, w, strict=True) if x > 1e-6}, float(b - cut), {"train_f1": float(f1[k]), "rows": float(len(y)), "pairs": float(len(pairs))})


def training_sample(documents: DataFrame, labels: DataFrame, held_out: int = 0) -> tuple[list[str], list[int]]:
    """At most ``MAX_TRAINING_ROWS`` labelled rows outside the held-out fold.

    Chosen by a hash of the id, so alike at every input size; null labels and
    texts are left out, and of a repeated id the largest label and text count.
    The labels' side is bounded first and the join returns no more rows.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != held_out))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING_ROWS)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = save(rows, "sample")  # bounded by the labels' side
    along = W.orderBy("at", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.df.select("doc_id", F.xxhash64("doc_id").alias("at"), F.length("text").cast("bigint").alias("size"))
    taken = sizes.withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0))).where(F.col("before") < MAX_TRAINING_CHARS)
    chosen = rows.df.join(F.broadcast(taken.select("doc_id", "at")), "doc_id").orderBy("at", "doc_id")
    out: tuple[list[str], list[int]] = ([], [])
    for r in chosen.select("text", "toxic").toLocalIterator():
        out[0].append(r.text)
        out[1].append(int(r.toxic > 0))
    rows.drop()
    return out


def fit_from_tables(documents: DataFrame, labels: DataFrame, held_out: int = 0) -> ToxicityModel:
    """The model of the labelled rows outside the held-out fold."""
    return fit(*training_sample(documents, labels, held_out))


def score_documents(docs: DataFrame, model: ToxicityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_column`` (0 to 1), in one pass.

    Null and empty texts get the score of a text without features. The model has
    a bounded number of weights and travels with the task. A column of ``docs`` that
    has the score's name is replaced.
    """
    docs = docs.drop(score_column)
    at = docs.columns.index(text_column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for batch in batches:
            scores = pa.array([model.score(t.as_py(), seen) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score_column])

    return docs.mapInArrow(tidy(run), f"{schema}, `{score_column}` double")


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows of op3. Repeated rows are scored each."""
    model = fit_from_tables(documents, labels)
    scored = score_documents(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; all columns as given, one named ``score`` too."""
    columns, score = docs.columns, fresh("score", docs.columns)
    return score_documents(docs, model, score_column=score).where(F.col(score) < threshold).select(*columns)
