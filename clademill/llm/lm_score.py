"""Language-model scores: a probabilistic suffix tree over words, with one over letters for new words, beside a unigram base.

Contexts are the up to ``ORDER`` words before a token. A next word is kept in a context where its count diverges
from what the shorter context gives, and the probability is smoothed along the suffixes, so the longest one that
training has decides most. The tree's counts grow with the corpus: blocks of documents send the sorted
hashes of their word runs to ranges of hashes and get back the corpus counts of just these. Words that training has not
seen are spelled by a suffix tree over the bytes of the training words, with contexts of up to ``DEPTH`` bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import WordHashes, fold, mix, release, save, tidy

DEPTH = 5
#: The letters' resolution: a context of bytes is kept only where its share of all places reaches this. Contexts of words have no such bound.
MIN_SHARE = 5e-5
#: Least gain of a context of bytes in nats, and as a share of all places.
MIN_GAIN, MIN_GAIN_SHARE = 12.0, 2e-7
#: Least divergence of a word from the shorter context's probability, in nats over its occurrences.
MIN_DIVERGENCE = 0.5
#: Weight of the shorter context's distribution.
BACKOFF = 6.0
#: Byte that UTF-8 never has: the text's end, and the places before its start.
END = 0xFF
SYMBOLS = 256
#: UTF-8 bytes of text in a block, and of those that are read at once; blocks to a task where there are many.
BLOCK_BYTES, TASK_BLOCKS = 12_000_000, 4
#: Tokens that are scored at a time, and new words that are spelled at a time.
SLICE, SPELLED = 65_536, 50_000
#: Bytes of text to a range of hashes, and the most ranges.
RANGE_BYTES, MOST_RANGES = 8_000_000, 65_536
#: Words of a context, and the power of a context's count that is the weight of the shorter one, by their number.
ORDER = 2
WEIGHTS = (0.9, 0.8)
#: What stands for a word at a text's start and end. Words are hashes of 63 bits.
START, STOP = 2, 3
#: The kind of a row of byte grams, and of a text; others are a context's number of words.
BYTES, TEXT = 50, 100


def stream_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each as DEPTH ends, the text, an end; and where texts begin."""
    pad, end = bytes([END]) * DEPTH, bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + DEPTH + 1 for t in texts])]).astype(np.int64)
    return data, starts


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all (DEPTH + 1)-byte windows that end in a text or at its end."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, starts = stream_of(texts)
    n = len(data) - DEPTH
    code = np.zeros(n, np.int64)
    for j in range(DEPTH + 1):
        code = (code << 8) | data[j : j + n]
    valid = np.ones(len(data), bool)
    for k in range(DEPTH):
        valid[starts[:-1] + k] = False
    return np.unique(code[valid[DEPTH:]], return_counts=True)


@dataclass
class SuffixTree:
    """Automaton of the kept contexts. ``lp`` holds log10 probabilities by state and symbol class."""

    classes: np.ndarray  # byte -> symbol class; the last class stands for any one unseen byte
    step: np.ndarray  # state, class -> state
    lp: np.ndarray  # state, class -> log10 probability
    contexts: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end, in lockstep over equal lanes."""
        if not texts:
            return np.zeros(0)
        data, starts = stream_of(texts)
        width, n = self.step.shape[1], len(data)
        length = int(min(4096, max(256, math.isqrt(n))))
        lanes = -(-n // length)
        symbols = np.full(lanes * length + DEPTH, self.classes[END], np.int32)
        symbols[DEPTH : DEPTH + n] = self.classes[data]
        at = np.arange(lanes, dtype=np.int64) * length
        state = np.zeros(lanes, np.int64)
        step, lp = self.step.ravel(), self.lp.ravel()
        out = np.empty((length, lanes), np.float32)
        for t in range(DEPTH + length):
            place = state * width + symbols[at + t]
            if t >= DEPTH:
                out[t - DEPTH] = lp[place]
            state = step[place].astype(np.int64)
        flat = out.T.ravel()[:n].astype(np.float64)
        for k in range(DEPTH):
            flat[starts[:-1] + k] = 0.0
        return np.add.reduceat(flat, starts[:-1])


def build_tree(tables: list[dict[bytes, dict[int, int]]]) -> SuffixTree:
    """The tree from ``tables[d]``: next-byte counts of the candidate contexts of length d.

    Every suffix of a candidate is a candidate. A context is kept if its counts
    gain at least the bounds over its parent's smoothed distribution, or if a
    longer one that ends in it is kept.
    """
    root = tables[0].get(b"", {})
    total = max(1, sum(root.values()))
    seen = sorted(root)
    classes = np.full(SYMBOLS, len(seen), np.int32)
    classes[seen] = np.arange(len(seen))
    if END not in root:  # nothing was learned
        classes[END] = len(seen)
    width = len(seen) + 1

    def dense(counts: dict[int, int]) -> np.ndarray:
        v = np.zeros(width)
        for s, n in counts.items():
            v[classes[s]] += n
        return v

    uniform = np.full(width, 1 / SYMBOLS)  # the last class is one of the unseen bytes
    probs: dict[bytes, np.ndarray] = {}
    mine = dense(root)
    probs[b""] = (mine + BACKOFF * uniform) / (mine.sum() + BACKOFF)
    kept: set[bytes] = {b""}
    need = max(MIN_GAIN, MIN_GAIN_SHARE * total)
    for d in range(1, DEPTH + 1):
        for context in sorted(tables[d]):
            counts = dense(tables[d][context])
            n, parent = counts.sum(), probs[context[1:]]
            probs[context] = (counts + BACKOFF * parent) / (n + BACKOFF)
            some = counts > 0
            if (counts[some] * np.log(counts[some] / n / parent[some])).sum() >= need:
                kept.update(context[i:] for i in range(d + 1))
    # the automaton over all prefixes of kept contexts, breadth first
    nodes = sorted({c[:i] for c in kept for i in range(len(c) + 1)}, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(nodes)}
    step = np.zeros((len(nodes), width), np.int32)
    lp = np.zeros((len(nodes), width))
    longest: dict[bytes, bytes] = {}
    children: dict[bytes, list[bytes]] = {}
    for c in nodes[1:]:
        children.setdefault(c[:-1], []).append(c)
    for c in nodes:
        i = number[c]
        fail = next((c[k:] for k in range(1, len(c) + 1) if c[k:] in number), b"")
        longest[c] = c if c in kept else longest[fail]
        if c:
            step[i] = step[number[fail]]
        for child in children.get(c, []):
            step[i, classes[child[-1]]] = number[child]
        lp[i] = np.log10(probs[longest[c]])
    step[:, len(seen)] = 0
    return SuffixTree(classes, step, lp, len(kept))


def _blocks(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, train, held, block)``: rows in the order they are read, dealt to blocks of about BLOCK_BYTES.

    A block is the rows that one task reads in turn, so no id or text can make one large.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(fold() != 1, F.lit(False)).alias("train"), (fold() == 1).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + (size + sizes) // BLOCK_BYTES)], names=[*batch.schema.names, "block"])
            size += int(sizes[-1]) if len(sizes) else 0

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, train boolean, held boolean, block bigint"
    return rows.mapInArrow(tidy(run), schema)


class _Words(WordHashes):
    """63-bit hashes of words, none of which is a mark."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = max(xxhash.xxh3_64_intdigest(word) >> 1, STOP + 1)
        return value

    def tokens(self, raw: bytes) -> tuple[list[bytes], np.ndarray]:
        """A lower-case text's words, and their hashes with the end's."""
        words = raw.split()
        return words, np.fromiter((*map(self.__getitem__, words), STOP), np.int64, len(words) + 1)


def _runs(word: np.ndarray, heads: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
    """For 0 to ``order`` words of context in turn, one 63-bit number for each token with that context; texts begin at ``heads``."""
    key = word.view(np.uint64)
    yield key
    before = key.copy()
    for _ in range(order):
        before[1:] = before[:-1]
        before[heads] = START
        longer = np.empty_like(key)
        for s in range(0, len(key), SLICE):
            part = slice(s, s + SLICE)
            longer[part] = mix(key[part] * np.uint64(0x9E3779B97F4A7C15) + mix(before[part])) >> np.uint64(1)
        key = longer
        del longer
        yield key


def _heads(sizes: list[int]) -> np.ndarray:
    """Where texts of so many tokens begin."""
    return np.cumsum([0, *sizes[:-1]])


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of each 63-bit number, of ``parts`` equal ones."""
    return ((keys >> np.uint64(31)) * np.uint64(parts)) >> np.uint64(32)


def _low(part: int, parts: int) -> np.uint64:
    """The least number of a range."""
    return np.uint64((-(-(part << 32) // parts)) << 31)


def _shift(parts: int) -> np.uint64:
    """How far numbers in a range are shifted to be of 32 bits."""
    return np.uint64(max(0, 63 - (parts.bit_length() - 1) - 32))


def _steps(keys: np.ndarray) -> bytes:
    """Sorted numbers as their differences, in as few bytes each as the largest takes; that width comes first."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    """The numbers that :func:`_steps` wrote."""
    whole = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    whole[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    return np.cumsum(whole.view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes."""
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _as_sent(raw: bytes, size: int) -> np.ndarray:
    """The counts that :func:`_small` wrote, as wide as it wrote them."""
    return np.frombuffer(raw, np.dtype(f"u{len(raw) // size}")) if size else np.zeros(0, np.uint8)


def _large(raw: bytes, size: int) -> np.ndarray:
    """The counts that :func:`_small` wrote."""
    return _as_sent(raw, size).astype(np.int64)


def _placed(key: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """Each number's count, of ``counts`` in the order of the distinct numbers. ``counts`` is emptied."""
    known = np.concatenate(counts)
    counts.clear()
    order = np.argsort(key)
    key = key[order]
    rank = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.cumsum(rank, dtype=np.int32 if len(rank) < 1 << 31 else np.int64)
    if len(known) != rank[-1]:
        raise ValueError("a block's counts are not those of its texts")
    rank -= 1
    out = np.empty(len(order), known.dtype)
    out[order] = known[rank]
    return out


COUNTED = "part int, kind int, block bigint, size int, keys binary, counts binary"


def _counted(blocks: DataFrame, parts: int, tree: bool = True) -> DataFrame:
    """Sorted distinct runs of each block with their counts in training texts, by kind and range; and byte grams of its training words.

    Words are sent whole, longer runs as 32 bits within their range of about a million runs, so that about one in
    some thousands counts with another. Sorted, they go as differences of about three bytes. Without ``tree``
    only words go, all that the base needs.
    """
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shift = _Words(), _shift(parts)

        def told(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of numbers that are sorted by range."""
            cuts = np.searchsorted(of, np.arange(parts + 1, dtype=of.dtype))
            some = np.nonzero(cuts[1:] > cuts[:-1])[0].tolist()
            packed = []
            for i in some:
                own = keys[cuts[i] : cuts[i + 1]]
                packed.append(_steps(own if kind in (0, BYTES) else (own - _low(i, parts)) >> shift))
            sizes = [int(cuts[i + 1] - cuts[i]) for i in some]
            small = [_small(counts[cuts[i] : cuts[i + 1]]) for i in some]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(small, pa.binary())], names=names)

        def given(block: int, tokens: list[np.ndarray], train: list[bool], words: set[bytes]) -> Iterator[pa.RecordBatch]:
            sizes = [len(t) for t in tokens]
            learned, word = np.repeat(np.array(train, bool), sizes), np.concatenate(tokens)
            tokens.clear()
            for kind, key in enumerate(_runs(word, _heads(sizes), ORDER if tree else 0)):
                both = key << np.uint64(1)
                both |= learned
                both.sort()
                ones = (both & np.uint64(1)).astype(bool)
                both >>= np.uint64(1)
                first = np.nonzero(np.concatenate([[True], both[1:] != both[:-1]]))[0]
                keys = both[first]
                del both
                yield from told(kind, block, keys, np.add.reduceat(ones, first, dtype=np.int64), _ranges(keys, parts))
            if not tree:
                return
            codes, n = gram_counts(sorted(words))
            of = _ranges(mix(codes.view(np.uint64)) >> np.uint64(1), parts)
            order = np.argsort(of, kind="stable")
            yield from told(BYTES, block, codes[order].view(np.uint64), n[order], of[order])

        now, tokens, train, seen = None, [], [], set()
        for batch in batches:
            for text, learned, block in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if tokens and block != now:
                    yield from given(now, tokens, train, seen)
                    tokens, train, seen = [], [], set()
                now = block
                words, own = hashes.tokens(text.as_py().encode().lower())
                tokens.append(own)
                train.append(learned)
                if learned and tree:
                    seen.update(words)
        if tokens:
            yield from given(now, tokens, train, seen)

    return blocks.mapInArrow(tidy(run), COUNTED)


TOTALS = "kind int, block bigint, part int, size int, counts binary, keys binary, n bigint, v bigint, once bigint"


def _totals(counted: DataFrame, parts: int) -> DataFrame:
    """Each row of :func:`_counted` with corpus counts in its place; and per range one row without a block: sum, number, those of 1, and byte grams themselves."""
    names = [x.split()[0] for x in TOTALS.split(", ")]

    def one(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        sizes = table.column("size").to_numpy()
        key = np.concatenate([_numbers(raw) for raw in table.column("keys").to_pylist()])
        n = np.concatenate([_large(raw, size) for raw, size in zip(table.column("counts").to_pylist(), sizes.tolist(), strict=True)])
        order = np.argsort(key, kind="stable")
        first = np.nonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))[0]
        total = np.add.reduceat(n[order], first)
        whole = [kind, None, part, len(first), _small(total) if kind == BYTES else None, key[order][first].tobytes() if kind == BYTES else None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum())]
        rows = [whole]
        if kind != BYTES:
            each = np.empty(len(key), np.int64)
            each[order] = np.repeat(total, np.diff(np.append(first, len(key))))
            for block, part_, own in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), np.split(each, np.cumsum(sizes)[:-1]), strict=True):
                rows.append([kind, block, part_, len(own), _small(own), None, None, None, None])
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return counted.groupBy("part", "kind").applyInArrow(one, TOTALS)


def _grams(totals: DataFrame) -> DataFrame:
    """``(gram, n)`` of the byte grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, counts, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(_large(counts, size))], names=["gram", "n"])

    return totals.where(f"kind = {BYTES}").select("size", "counts", "keys").mapInArrow(tidy(run), "gram bigint, n bigint")


def fit_tree(grams: DataFrame) -> SuffixTree:
    """The letters' tree of a gram table ``(gram, n)``; only counts of frequent contexts reach the driver."""
    counts = save(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counts.df.agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(total * MIN_SHARE))
    tables: list[dict[bytes, dict[int, int]]] = [{} for _ in range(DEPTH + 1)]
    for d in range(DEPTH + 1):
        per = counts.df.groupBy(F.col("gram").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("g")).agg(F.sum("n").alias("n"))
        # contexts come as one row each: at most 1 / MIN_SHARE rows of at most 256 counts
        context = per.groupBy(F.shiftrightunsigned("g", 8).alias("context")).agg(F.sum("n").alias("n"), F.collect_list(F.struct((F.col("g") % 256).cast("int").alias("s"), F.col("n").alias("n"))).alias("next"))
        for r in context.where(F.col("n") >= (least if d else 0)).toLocalIterator():
            tables[d][int(r.context).to_bytes(d, "big")] = {x.s: x.n for x in r.next}
    counts.drop()
    return build_tree(tables)


def smoothed(p: np.ndarray, n: np.ndarray, context: np.ndarray, power: float) -> np.ndarray:
    """Probabilities one context longer: of words that occur ``n`` times after contexts that occur ``context`` times.

    A word is kept in the context where its count diverges enough from ``p``, the
    shorter context's probability, whose weight is a power of the context's count.
    """
    out = p.copy()
    some = context > 0
    p, n, context = p[some], n[some].astype(float), context[some].astype(float)
    share = np.where(n > 0, n, 1.0) / context
    n = np.where((n > 0) & (n * np.log(share / p) >= MIN_DIVERGENCE), n, 0.0)
    weight = context**power
    out[some] = (n + weight * p) / (context + weight)
    return out


def _spelled(raws: list[bytes], at: np.ndarray, places: np.ndarray, new: float, letters: SuffixTree) -> np.ndarray:
    """The probabilities of the new words at ``places`` among all tokens, spelled by ``letters``."""
    out = np.empty(len(places))
    text = np.searchsorted(at, places, side="right") - 1
    cuts = [0, *(np.nonzero(np.diff(text))[0] + 1).tolist(), len(places)] if len(places) else []
    done, novel = 0, []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        i = int(text[s])
        own = [*raws[i].split(), b""]
        for first in range(s, e, SPELLED):
            last = min(e, first + SPELLED)
            novel += [own[j] for j in (places[first:last] - at[i]).tolist()]
            if len(novel) >= SPELLED or last == len(places):
                names = sorted(set(novel))
                lp = dict(zip(names, letters.scores(names).tolist(), strict=True))
                out[done:last] = new * 10.0 ** np.array([max(lp[x], -290.0) for x in novel])
                done, novel = last, []
    return out


def block_scores(raws: list[bytes], counts: dict[int, list[np.ndarray]], hashes: _Words, tokens: int, learned: int, under: float, new: float, letters: SuffixTree | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Numbers of tokens and of known ones, base and score of a block's lower-case texts, by its ``counts``, which are used up.

    ``tokens`` and ``learned`` are the numbers of training tokens and texts, ``under`` the base's logarithm of the
    share of one, ``new`` the share of words met for the first time. Counts of tokens stay as narrow as they were
    sent, and all else goes by slices of tokens, so memory is some tens of bytes a token. Without ``letters`` there is no score.
    """
    own = [hashes.tokens(r)[1] for r in raws]
    sizes = [len(t) for t in own]
    word, at = np.concatenate(own), _heads(sizes)
    del own
    of = [_placed(key, counts.pop(kind)) for kind, key in enumerate(_runs(word, at, ORDER if letters else 0))]
    total = len(word)
    del word
    each = np.empty(total)
    for s in range(0, total, SLICE):
        each[s : s + SLICE] = np.log10(of[0][s : s + SLICE] + 0.5) - under
    base, known = np.add.reduceat(each, at), np.add.reduceat(of[0] > 0, at, dtype=np.int64)
    if letters is None:
        return np.array(sizes), known, base, None
    places = np.nonzero(of[0] == 0)[0]
    spelled = _spelled(raws, at, places, new, letters)
    for s in range(0, total, SLICE):
        e = min(total, s + SLICE)
        p = of[0][s:e] * ((1 - new) / max(tokens, 1))
        low, high = np.searchsorted(places, (s, e))
        p[places[low:high] - s] = spelled[low:high]
        heads = at[slice(*np.searchsorted(at, (s, e)))] - s
        for k in range(ORDER):  # a context's count is that of the run which ends in the token before
            context = np.empty(e - s, np.int64)
            context[1:], context[0] = of[k][s : e - 1], of[k][s - 1] if s else 0
            context[heads] = learned
            p = smoothed(p, of[k + 1][s:e], context, WEIGHTS[k])
        each[s:e] = np.log10(np.maximum(p, 1e-300))
    return np.array(sizes), known, base, np.add.reduceat(each, at)


def score_documents(docs: DataFrame, tree: bool = True) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from the rows whose fold is not 1. A null id is in no fold: it is not learned
    from, and its ``held_out`` is null. Null texts are empty; repeated rows are counted and scored
    each. With nothing to learn from, all words are spelled by a uniform tree and the base has one class.

    Documents are dealt to blocks in the order in which tasks read them, and go to the shared folder so. A block's
    sorted runs are the rows that it sends and the order in which it reads the counts that come
    back, so neither the vocabulary nor a frequent word gathers in one place. The
    probabilities of the words after a context sum to at most 1. Without ``tree`` there is no ``score``, and
    nothing is counted, sent or fitted for it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_RANGES, max(8, -(-size // RANGE_BYTES)))
    blocks = save(_blocks(docs), "blocks").df
    totals = save(_totals(_counted(blocks, parts, tree), parts), "totals").df
    row = totals.where("kind = 0 AND block IS NULL").agg(*(F.sum(c).alias(c) for c in ("n", "v", "once"))).first()
    tokens, distinct, once, learned = row.n or 0, row.v or 0, row.once or 0, blocks.where("train").count()
    letters = spark.sparkContext.broadcast(fit_tree(_grams(totals))) if tree else None
    release(spark)  # the exchange of all runs is done with
    new = min(max(once, 1) / tokens, 0.5) if tokens else 1.0  # the share of words that are met for the first time
    under = math.log10(tokens + 0.5 * (distinct + 1))
    n = blocks.select("block").distinct().count()
    tasks = max(-(-n // TASK_BLOCKS), min(n, 8 * spark.sparkContext.defaultParallelism), 1)
    # one exchange deals a block's counts and texts, in this order
    id_type = docs.schema["doc_id"].dataType.simpleString()
    empty = lambda kind: F.lit(None).cast(kind)
    model = totals.where("block IS NOT NULL").select("block", "kind", "part", "size", "counts", empty(id_type).alias("doc_id"), empty("string").alias("text"), empty("boolean").alias("held"))
    texts = blocks.select("block", F.lit(TEXT).alias("kind"), empty("int").alias("part"), empty("int").alias("size"), empty("binary").alias("counts"), "doc_id", "text", "held")
    dealt = model.unionByName(texts).repartition(tasks, "block").sortWithinPartitions("block", "kind", "part")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", *(["score"] if tree else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        now: int | None = None
        counts: dict[int, list[np.ndarray]] = {}
        held: list[pa.RecordBatch] = []
        raws: list[bytes] = []

        def scored() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            n, known, base, score = block_scores(raws, counts, hashes, tokens, learned, under, new, letters and letters.value)
            columns = [rows.column("doc_id").combine_chunks(), rows.column("held").combine_chunks(), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(score)] if tree else columns, names=names)

        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.nonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1]))[0] + 1).tolist(), len(block)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                if block[s] != now:
                    if held:
                        yield scored()
                    now, counts, held, raws = block[s], {}, [], []
                rows = batch.slice(s, e - s)
                if kind[s] == TEXT:  # copies, since a slice would keep the whole batch
                    held.append(rows.select(["doc_id", "held"]).take(pa.array(np.arange(e - s))))
                    raws.extend(t.as_py().encode().lower() for t in rows.column("text"))
                else:
                    counts.setdefault(int(kind[s]), []).extend(_as_sent(raw.as_py(), n) for raw, n in zip(rows.column("counts"), rows.column("size").to_pylist(), strict=True))
            batch = rows = None
        if held:
            yield scored()

    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double{', score double' if tree else ''}"
    return dealt.mapInArrow(tidy(run), schema)


def lm_query(documents: DataFrame) -> DataFrame:
    """Contract rows of op9."""
    return score_documents(documents.select("doc_id", "text"))
