"""Decontamination against a plain restatement, and the cases that a window count alone gets wrong."""

from collections import defaultdict

import numpy as np
import pytest
import regex

from clademill.llm import decontaminate as D

WORDS = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
MARKS = D.NAME + D.NUMBER + D.UNIT


@pytest.fixture()
def rng():
    return np.random.default_rng(41)


def _marked(text):
    text = text.translate({ord(c): None for c in MARKS})
    text = regex.sub(r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})", lambda m: D.NAME + m[0], text)
    text = regex.sub(r"\d(?<![^\s(\[$€£+-]\d)[\d.,:/]*(?![\p{L}\p{N}])", lambda m: D.NUMBER + m[0], text)
    text = regex.sub(rf"(?i)(\d )({D.UNITS})(?![\p{{L}}\p{{N}}])", lambda m: m[1] + D.UNIT + m[2], text)
    return regex.sub(D.PUNCTUATION, "", text)


def _tokens(text):
    return [t for t in regex.split(D.SPACE, _marked(text)) if t]


def _kind(t):
    return regex.sub(rf"({D.MARK})\S*", r"\1", t.lower())


def _bare(t):
    return regex.sub(D.MARK, "", t.lower())


def _poor(window):
    return 2 * sum(bool(regex.search(D.MARK, t)) for t in window) > len(window)


def _brute(rows, bench):
    items = {(i, t) for i, t in bench if t is not None}
    every = {(i, t) for i, t in rows if t is not None}
    out = set()
    for item, source in items:
        raw = _tokens(source)
        kinds, bare = [*map(_kind, raw)], [*map(_bare, raw)]
        width = min(D.WINDOW, len(raw))
        if not raw:
            continue
        n = len(raw) - width + 1
        rich = [width >= D.SHORTEST and not _poor(kinds[i : i + width]) for i in range(n)]
        hits = defaultdict(set)
        for doc, text in every:  # every row by itself, whatever its id
            own = _tokens(text)
            if width < D.LINE:
                at = 0
                for line in text.split("\n"):
                    of_line = _tokens(line)
                    if [*map(_bare, of_line)] == bare:
                        out.add((doc, item, len(_tokens("\n".join(text.split("\n")[:at]))), len(_tokens("\n".join(text.split("\n")[:at]))) + width, 1, True))
                        break
                    at += 1
                continue
            k, b = [*map(_kind, own)], [*map(_bare, own)]
            for d in range(len(own) - width + 1):
                for i in range(n):
                    if k[d : d + width] == kinds[i : i + width] if rich[i] else (width < D.SHORTEST or _poor(k[d : d + width])) and b[d : d + width] == bare[i : i + width]:
                        hits[doc, text, d - i].add(i)
        for (doc, text, diagonal), at in hits.items():
            run = best = 0
            for i in range(n):
                run = run + 1 if i in at else 0
                best = max(best, run)
            some = [i for i in at if rich[i]]
            if not (best + width - 1 >= D.RUN or 2 * len(at) >= n or some and 2 * len(some) >= sum(rich)):
                continue
            own = _tokens(text)
            pairs = [(raw[i], own[i + diagonal]) for i in sorted({i + j for i in at for j in range(width)}) if i + diagonal < len(own)]
            exact = all(_bare(x) == _bare(y) for x, y in pairs)
            slots = {(x, y) for x, y in pairs if regex.match(D.MARK, x)}
            if exact or all(_kind(x) == _kind(y) or _bare(x) == _bare(y) for x, y in pairs) and len({x for x, _ in slots}) == len(slots):
                out.add((doc, item, min(at) + diagonal, max(at) + diagonal + width, len(at), exact))
    return out


def test_equals_a_plain_restatement_however_rows_are_dealt(spark, rng):
    def text(n):
        out = []
        for w in rng.choice(WORDS, n):
            r = rng.random()
            out.append(str(rng.integers(1, 60)) if r < 0.12 else rng.choice(["Ada", "Bob", "Cleo"]) if r < 0.2 else f"{rng.integers(1, 9)} km" if r < 0.24 else w + rng.choice(["", "", ",", "."]))
        return " ".join(out)

    bench = [(i, text(int(rng.integers(1, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (None, text(20)), (3, text(12))]
    rows = []
    for i in range(120):
        base = bench[int(rng.integers(0, 40))][1]
        words = base.split()
        for _ in range(int(rng.integers(0, 4))):  # other numbers, names and words
            k = int(rng.integers(0, len(words)))
            words[k] = str(rng.integers(1, 60)) if words[k][0].isdigit() else rng.choice(["Dora", "wakk", words[k]])
        rows.append((i, rng.choice(["\n", " "]).join([text(15), " ".join(words), text(10)])))
    rows += [(5, text(30)), rows[6], (None, bench[0][1]), (300, None), (301, ""), (302, bench[1][1].lower())]
    want = _brute(rows, bench)
    frame = lambda r, names: spark.createDataFrame(r, names)
    for parts in (1, 4, 13):
        docs = frame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, width int, words string").repartition(parts)
        got = D.contamination(docs, frame(bench, "item_id bigint, text string"))
        assert {tuple(r) for r in got.select("doc_id", "item_id", "start", "end", "n_windows", "exact").collect()} == want, parts
    assert len({w[0] for w in want}) > 40 and any(not w[5] for w in want)


def test_gaps_short_items_and_literals(spark, rng):
    text = lambda n: " ".join(rng.choice(WORDS, n))
    long, foreign = text(70).split(), text(34).split()
    gapped = " ".join([*long[:11], *foreign, *long[45:55]])  # runs of 11 and 10 words on one diagonal
    bench = [(1, " ".join(long)), (2, "Alice Bob Carol Dave has 5 10 20 30 40"), (3, "the secret answer"), (4, "Forty two"), (5, text(6) + " 5 km")]
    rows = [(1, gapped), (2, f"{text(9)} {' '.join(long[20:33])} {text(9)}"), (3, f"{text(9)} {' '.join(long[20:32])} {text(9)}"), (4, f"{text(20)} Alice Bob Carol Dave has 5 10 20 30 40 {text(5)}"), (5, f"{text(20)} the secret answer, {text(5)}"),
            (6, f"{text(5)} forty two {text(5)}"), (7, f"{text(5)}\nforty two.\n{text(5)}"), (8, f"{text(5)} {bench[4][1].replace('5', '8')}"), (9, f"{text(5)} the secret question")]
    got = D.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.exact) for r in got.collect()} == {(2, 1, True), (4, 2, True), (5, 3, True), (7, 4, True), (8, 5, False)}


def test_very_long_texts(spark, rng):
    item = " ".join(rng.choice(WORDS, 30))
    long = " ".join(rng.choice(WORDS, 200_000))
    got = D.decontaminate_query(spark.createDataFrame([(1, long), (2, long + " " + item), (3, "7 " * 50_000)], "doc_id bigint, text string"), spark.createDataFrame([(1, item), (2, "a 7 7 7 7 7 7 7 8")], "item_id bigint, text string"))
    assert {r.doc_id: r.contaminated for r in got.collect()} == {1: False, 2: True, 3: False}


def test_every_row_counts_whatever_its_id(spark):
    """Two texts of one document id, rows without one, two texts of one item id, and an item without one."""
    item, other, third = ("Which of the seven rivers that cross the old city of Varn was dammed first and why", "Name the chemist who first isolated the violet salt of mount Ker in winter", "Explain how the two clocks of Elm tower came to disagree by an hour each spring")
    bench = spark.createDataFrame([(1, item), (1, other), (None, third)], "item_id bigint, text string")
    own = "Some words of its own that no item has, before "
    rows = [(1, own + item), (1, own + "nothing else at all"), (None, own + other), (None, "clean words only, and no id"), (2, own + third), (3, None), (3, own)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, _doc int")
    assert sorted(r._doc for r in D.drop_contaminated(docs, bench).collect()) == [1, 3, 5, 6]
    told = sorted((str(r.doc_id), r.contaminated, r.n_items) for r in D.decontaminate_query(docs, bench).collect())
    assert told == [("1", False, 0), ("1", True, 1), ("2", True, 1), ("3", False, 0), ("3", False, 0), ("None", False, 0), ("None", True, 1)]
