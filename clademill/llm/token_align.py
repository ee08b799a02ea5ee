"""Alignment of two tokenizers over the same texts, by interval joins in DuckDB.

Each task puts its texts' tokens into two interval tables over bytes, one for the
byte-level BPE (A) and one for the pieces (B). An ASOF join finds the B token at which an
A token ends, windows turn that into the range of B tokens that an A token overlaps and
sum the shared ends into group numbers, and a join with the unrolled ranges lists the links. A
document leaves its task with its digest and how often it links which pair of ids. Spark merges
the pairs' counts of all tasks and brings them back to the documents.

Tokens of A are those of a space and the text; B adds that space itself. A text that is
null or empty, or whose tokens' bytes are not those of space and text in either
tokenizer, has no tokens: zeros, and an empty digest. Rows count one by one, whatever their
ids. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import SharedTable, bounded, save, tidy

#: So many code points, or one longer text, are aligned at a time.
CHUNK = 1_000_000
#: Runs of white space from this length on overflow the faster encoder's stack.
LONG_SPACE = re.compile(r"\s{20000}")
# Fixed value: the pattern of byte-level pre-tokenizing.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids and bytes of a byte-level BPE file of the ``tokenizers`` library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @functools.cached_property
    def _slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def __call__(self, text: str) -> list[int]:
        return self._slow.encode(text, add_special_tokens=False).ids if LONG_SPACE.search(text) else self._encode(text)


class Pieces:
    """Ids and bytes of a ``sentencepiece`` model, which adds a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.many = functools.partial(model.encode, num_threads=1)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_word = model.normalize(" ﬁ①  A ") == "▁▁ﬁ①▁▁A▁" and not any("▁" in p.lstrip("▁") for p in pieces)

    def __call__(self, text: str) -> list[int]:
        return self.many(text)


class Words:
    """Ids of texts by both tokenizers, put together from those of their words, which are remembered up to a bound.

    Where B takes texts as they are and no piece goes on past a space, words have the same pieces alone as in a
    text with one space between them. So have A's tokens, whose pattern begins anew at such a space unless other white space stands on both
    sides of it. Other texts are encoded whole. New words are encoded many at a time.
    """

    LIMIT, LONGEST = 150_000, 40

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.wide = [np.array([len(x) for x in side.bytes], np.int64) for side in (a, b)]
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._chars = 0
        # of each side: the ids of all words, one after another, and where a word's begin
        self._ids, self._from = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2
        # of each word: whether either side's bytes are a space and the word, and whether it begins or ends with white space
        self._same = self._opens = self._ends = np.zeros(0, bool)

    def _of_a(self, spaced: list[str], rough: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of words with their space, and where a word's end; all but the ``rough`` last go as one text."""
        flat = np.array(self.a("".join(spaced)), np.int32)
        at = np.cumsum(self.wide[0][flat])
        ends = np.searchsorted(at, np.cumsum(sizes), side="right")
        each = [self.a(w) for w in rough]
        if len(spaced) and not np.array_equal(at[ends - 1], np.cumsum(sizes)):
            raise ValueError("a token of A goes on past a space")
        more = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate([flat, np.fromiter(chain.from_iterable(each), np.int32)]), np.concatenate([ends, len(flat) + more])

    def _learn(self, new: set[str]) -> None:
        rough = [w for w in new if w[0].isspace() or w[-1].isspace()]
        words = [*new.difference(rough), *rough]
        self._known.update(zip(words, range(len(self._known), len(self._known) + len(words)), strict=True))
        self._chars += sum(map(len, words))
        spaced = [f" {w}" for w in words]
        raw = [w.encode() for w in spaced]
        whole, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        n, same = len(words) - len(rough), np.ones(len(words), bool)
        of_b = self.b.many(words)
        ids_b = np.fromiter(chain.from_iterable(of_b), np.int32), np.cumsum(np.fromiter(map(len, of_b), np.int64, len(of_b)))
        for i, (side, (flat, ends)) in enumerate(((self.a, self._of_a(spaced[:n], spaced[n:], sizes[:n])), (self.b, ids_b))):
            bounds = np.concatenate([[0], np.cumsum(self.wide[i][flat])])[np.concatenate([[0], ends])]
            of, ids = side.bytes.__getitem__, flat.tolist()
            if not np.array_equal(np.diff(bounds), sizes) or b"".join(map(of, ids)) != whole:
                same &= np.fromiter((b"".join(map(of, ids[s:e])) == w for s, e, w in zip([0, *ends.tolist()], ends.tolist(), raw, strict=False)), bool, len(raw))
            self._from[i] = np.concatenate([self._from[i], self._from[i][-1] + ends])
            self._ids[i] = np.concatenate([self._ids[i], flat])
        self._same = np.concatenate([self._same, same])
        self._opens = np.concatenate([self._opens, np.fromiter((w[0].isspace() for w in words), bool, len(words))])
        self._ends = np.concatenate([self._ends, np.fromiter((w[-1].isspace() for w in words), bool, len(words))])

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = f" {text}"
        ids = self.a(raw), self.b(text)
        same = all(b"".join(map(side.bytes.__getitem__, x)) == raw.encode() for side, x in zip((self.a, self.b), ids, strict=True))
        return tuple(np.array(x if same else [], np.int32) for x in ids)

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text on either side, none if one side's bytes are not those of a space and the text."""
        none = np.zeros(0, np.int32)
        out = [none] * len(texts), [none] * len(texts)
        places, parts, apart = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.b.by_word or "  " in text or text[0] == " " or text[-1] == " ":
                apart.append(i)
            else:
                places.append(i)
                parts.append(text.split(" "))
        if parts:
            if len(self._known) > self.LIMIT or self._chars > self.LIMIT * self.LONGEST:
                self._clear()
            if new := set(chain.from_iterable(parts)).difference(self._known):
                self._learn(new)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            last = np.cumsum(sizes)
            word = np.fromiter(map(self._known.__getitem__, chain.from_iterable(parts)), np.int64, int(last[-1]))
            mixed = np.zeros(len(word), bool)
            mixed[:-1] = self._ends[word[:-1]] & self._opens[word[1:]]
            mixed[last - 1] = False
            ok, cut = np.logical_and.reduceat(self._same[word], last - sizes), np.logical_or.reduceat(mixed, last - sizes)
            for side in range(2):
                first = self._from[side][word]
                n = self._from[side][word + 1] - first
                ends = np.cumsum(n)
                flat = self._ids[side][np.arange(ends[-1]) + np.repeat(first - (ends - n), n)]
                bounds = [0, *ends[last - 1].tolist()]
                for i, s, e, told in zip(places, bounds[:-1], bounds[1:], (ok & ~cut).tolist(), strict=True):
                    if told:
                        out[side][i] = flat[s:e]
            apart += [i for i, x in zip(places, cut.tolist(), strict=True) if x]
        for i in apart:
            out[0][i], out[1][i] = self._whole(texts[i])
        return out


class Aligner:
    """Aligns texts of one task; ``a`` and ``b`` are paths of the two tokenizers."""

    def __init__(self, a: str, b: str):
        import duckdb

        self.a, self.b = ByteLevel(a), Pieces(b)
        self.words = Words(self.a, self.b)
        # an id's text after each mark that may stand before it in the digest
        mark = lambda side, marks: np.array([f"{m}{i}" for m in marks for i in range(len(side.bytes))], object)
        self.text_a, self.text_b = mark(self.a, ",;"), mark(self.b, ",|")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})

    @staticmethod
    def _table(ids: list[np.ndarray], wide: np.ndarray) -> pa.Table:
        flat = np.concatenate(ids)
        end = np.cumsum(wide[flat])
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
        return pa.table({"i": np.arange(len(flat), dtype=np.int32), "doc": doc, "id": flat, "s": end - wide[flat], "e": end})

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        """Per text ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``a_ids``, ``b_ids``, ``a_sizes``, ``b_sizes``, ``pairs`` and ``times``."""
        a, b = (self._table(ids, wide) for ids, wide in zip(self.words(texts), self.words.wide, strict=True))
        n = len(texts)
        none = np.zeros(0, np.int64)
        if not a.num_rows:
            zeros = [0] * n
            return {"n_a": zeros, "n_b": zeros, "n_groups": zeros, "n_links": zeros, "groups": [""] * n} | {k: [none] * n for k in ("a_ids", "b_ids", "a_sizes", "b_sizes", "pairs", "times")}
        db = self.db
        db.register("a", a)
        db.register("b", b)
        # one thread, and the windows follow the order of i without a sort of their own
        db.execute("CREATE OR REPLACE TEMP TABLE reach AS SELECT a.i, a.doc, a.id, b.i AS last, b.id AS last_id, b.e = a.e AS shut FROM a ASOF JOIN b ON a.e <= b.e")
        db.execute("""CREATE OR REPLACE TEMP TABLE spans AS SELECT *, lag(last + shut::INT, 1, 0) OVER () AS first,
            (sum(shut::INT) OVER (ROWS UNBOUNDED PRECEDING))::INT - shut::INT AS grp FROM (SELECT * FROM reach ORDER BY i)""")
        pairs = db.sql("""SELECT doc, code, count(*)::INT AS n FROM (
            SELECT doc, id::BIGINT * 4294967296 + last_id AS code FROM spans
            UNION ALL SELECT x.doc, x.id::BIGINT * 4294967296 + b.id FROM (SELECT doc, id, unnest(range(first, last)) AS i FROM spans WHERE first < last) x JOIN b USING (i)
            ) GROUP BY ALL ORDER BY doc, code""").to_arrow_table()
        told = db.sql("SELECT i, last, first, grp FROM spans ORDER BY i").to_arrow_table()
        db.unregister("a")
        db.unregister("b")
        last, first, grp = (told[c].to_numpy() for c in ("last", "first", "grp"))
        heads = np.flatnonzero(np.diff(grp, prepend=-1))  # the A token that opens a group
        a_size, b_from = np.diff(heads, append=len(grp)), first[heads]
        b_size = np.diff(b_from, append=b.num_rows)
        # groups one after another, in each its A tokens and then its B tokens
        line = np.empty(a.num_rows + b.num_rows, object)
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        marked_a, marked_b = ids_a.copy(), ids_b.copy()
        marked_a[heads] += len(self.a.bytes)
        marked_b[b_from] += len(self.b.bytes)
        line[np.arange(a.num_rows) + np.repeat(b_from, a_size)] = self.text_a[marked_a]
        line[np.arange(b.num_rows) + np.repeat(heads + a_size, b_size)] = self.text_b[marked_b]
        at = lambda doc: np.searchsorted(doc, np.arange(n + 1))
        in_a, in_b, in_g, in_p = at(a["doc"].to_numpy()), at(b["doc"].to_numpy()), at(a["doc"].to_numpy()[heads]), at(pairs["doc"].to_numpy())
        code, times = pairs["code"].to_numpy(), pairs["n"].to_numpy()
        cut = lambda values, bounds: [values[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        out = {"n_a": np.diff(in_a), "n_b": np.diff(in_b), "n_groups": np.diff(in_g), "pairs": cut(code, in_p), "times": cut(times, in_p)}
        out["n_links"] = [int(x.sum()) for x in out["times"]]
        out |= {"a_ids": cut(ids_a, in_a), "b_ids": cut(ids_b, in_b), "a_sizes": cut(a_size, in_g), "b_sizes": cut(b_size, in_g)}
        parts, bounds = line.tolist(), (in_a + in_b).tolist()
        out["groups"] = ["".join(parts[x:y])[1:] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return out


@functools.lru_cache(1)
def _aligner(a: str, b: str) -> Aligner:
    """One for each worker process, which keeps it from task to task."""
    return Aligner(a, b)


#: A document's groups as arrays: the ids in order, and how many of them each group has.
GROUPS = ("a_ids", "b_ids", "a_sizes", "b_sizes")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, a: str, b: str, groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``, one row per row of ``docs``.

    ``pairs`` are the linked ids, A's times 2**32 plus B's, and ``times`` how often the document
    links them. With ``groups`` the groups themselves follow, as :data:`GROUPS`.
    """
    lists = ("pairs", "times", *(GROUPS if groups else ()))
    schema = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS), "groups_sha256 string", *(f"{c} array<{'bigint' if c == 'pairs' else 'int'}>" for c in lists)])

    def lists_of(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in values])])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(kind.to_pandas_dtype())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(a, b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            start, size = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1] or "")
                if size >= CHUNK or end == len(texts):
                    found = own(texts[start:end])
                    digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found["groups"]]
                    columns = [ids.slice(start, end - start), *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(digest, pa.string())]
                    columns += [lists_of(found[c], pa.int64() if c == "pairs" else pa.int32()) for c in lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "groups_sha256", *lists])
                    start, size = end, 0

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: how many links of all documents hold a pair, and whether no other pair of its B id has more.

    There are at most as many highest counts as B has ids, so those are broadcast.
    """
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = save(counts, "pair-counts").df
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(of_b.alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most), of_b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def scored(aligned: SharedTable) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` over each row's links, by the counts of all rows.

    A document has one row for each of its pairs, so no pair has more rows than there are
    documents. The counts are broadcast up to a checked number of pairs, beyond it joined by a shuffle.
    """
    rows = aligned.df
    counts = save(pair_counts(rows), "pair-best").df
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("bigint").alias("times"))
    links = links.join(bounded(counts), "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")


def align_query(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Per document its tokens, groups and links, its links whose pair is the most frequent of its B id, and the sum of its links' counts."""
    import public_tokenizers

    a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    rows = align(docs, a, b).withColumn("row", F.monotonically_increasing_id())
    return scored(save(rows, "aligned"))
