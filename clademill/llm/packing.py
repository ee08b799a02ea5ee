"""Packing: cutting-stock column generation over the histogram of piece lengths.

Documents longer than a sequence are cut into whole sequences and a rest. The
rests' lengths, rounded up to size classes, form a bounded histogram; a linear
program over fill patterns is solved by column generation, with a knapsack
dynamic program as the pricing step. Rounded patterns are then laid out over the
ranks that pieces have in their class.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.llm.common import save, tidy

END_ID = 0
#: Pieces are rounded up to so many tokens in the linear program.
QUANTUM = 4


# ---------------------------------------------------------------- tokenizing


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
    Where the file's vocabulary is also expressible as byte ranks with the usual
    pattern, plain texts take that faster way; texts that hold an added token's
    string, and any failure, go to ``tokenizers``.
    """

    # Fixed value: the pattern of byte-level pre-tokenizing.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PROBES = ("", "a", " Hello,  wörld's\n\n 123\t!! ", "日本語 text x", "aaaaaaaaaaaaaaaaaaaaaaaa  \n  b")
    LONGEST = 2_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranked(spec)
        if self.fast and any(self.fast(p).tolist() != self._slow(p).tolist() for p in self.PROBES):
            self.fast = None

    def _ranked(self, spec: dict):
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"].get("type") != "BPE":
            return None
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        try:
            ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        except KeyError:
            return None
        encode = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: np.array(encode(text), dtype="<u4")

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) > self.LONGEST or any(t in text for t in self.added):
            return self._slow(text)
        try:
            return self.fast(text)
        except Exception:
            return self._slow(text)


# ------------------------------------------------------------------ planning


@dataclass
class Plan:
    """Patterns with how often each is used: ``uses[p]`` times ``fills[p]``, ``{class: copies}``."""

    fills: list[dict[int, int]]
    uses: list[int]
    lp_bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(self.uses)


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        k = np.searchsorted(sizes, w, side="right")
        if k:
            total = values[:k] + best[w - sizes[:k]]
            i = int(np.argmax(total))
            if total[i] > best[w] + 1e-12:
                best[w], took[w] = total[i], i
    copies, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            copies[took[w]] += 1
            w -= sizes[took[w]]
    return best[capacity], copies


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A vector-matrix or matrix-vector product without a threaded library, which small sizes only slow down."""
    return np.einsum("i,ij->j", a, b) if a.ndim == 1 else np.einsum("ij,j->i", a, b)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse with partial pivoting."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        k = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0.0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def plan_patterns(demand: dict[int, int], capacity: int, gap: float = 1e-3, patience: int = 400) -> Plan:
    """Patterns that hold at least ``demand[class]`` pieces of each size class.

    Revised simplex over generated columns of the covering program. Prices are
    smoothed towards those of the best Lagrangian bound, which start at each
    class's share of the capacity; pivoting stops once the bound is within
    ``gap``, or ``patience`` pivots have not lowered the cost (degenerate cycles
    of small inputs). Floors leave under one pattern per class, which is filled first-fit
    decreasing. Stopping early only costs fill, never validity.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return Plan([], [])
    b = np.array([demand[c] for c in sizes], dtype=float)
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))  # one column per basic pattern
    cost = np.ones(m)  # 0 for a surplus column
    inverse = np.diag(1 / np.diag(columns))
    x = _times(inverse, b)
    near, bound = sizes / capacity, 0.0
    pivot, least, since = -1, np.inf, 0
    while since < patience:
        pivot += 1
        if (now := float(cost @ x)) < least * (1 - 1e-9):
            least, since = now, 0
        else:
            since += 1
        y = _times(cost, inverse)
        if y.min() < -1e-9:
            column, price = np.zeros(m), 0.0
            column[int(np.argmin(y))] = -1.0
        else:
            price = 1.0
            for share in (0.8, 0.0):
                mixed = share * near + (1 - share) * np.maximum(y, 0.0)
                value, column = _price(mixed, sizes, capacity)
                if (low := mixed @ b / max(value, 1.0)) > bound:
                    near, bound = mixed, low
                if y @ column > 1 + 1e-7:
                    break
            else:
                break
            if cost @ x <= bound * (1 + gap):
                break
        d = _times(inverse, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-7, x / d, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[:, out], cost[out] = column, price
        if pivot % 200 == 199:
            inverse = _inverse(columns)
        else:
            row = inverse[out] / d[out]
            inverse = inverse - d[:, None] * row
            inverse[out] = row
        x = np.maximum(_times(inverse, b), 0.0)
    columns, x = columns[:, cost > 0], x[cost > 0]
    uses = np.floor(x + 1e-7).astype(np.int64)
    left = np.maximum(b - _times(columns, uses), 0).astype(np.int64)
    fills = [{int(sizes[i]): int(columns[i, p]) for i in np.nonzero(columns[:, p])[0]} for p in range(len(uses)) if uses[p]]
    counts = [int(u) for u in uses if u]
    bins: list[tuple[int, dict[int, int]]] = []
    for i in range(m - 1, -1, -1):
        size, need = int(sizes[i]), int(left[i])
        for k, (room, held) in enumerate(bins):
            if not need:
                break
            put = min(need, room // size)
            if put:
                bins[k] = (room - put * size, held | {size: held.get(size, 0) + put})
                need -= put
        per = capacity // size
        while need:
            put = min(per, need)
            bins.append((capacity - put * size, {size: put}))
            need -= put
    return Plan(fills + [h for _, h in bins], counts + [1] * len(bins), float(bound))


# -------------------------------------------------------------------- packing


def pieces_of(docs: DataFrame, tokenizer_path: str, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows: whole sequences, then the rest, with a rank in (task, class).

    One pass, no shuffle. A null text is empty: its only id is the end id.
    ``cls`` is the piece's length in quanta, rounded up; ``part`` the task.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "part", "rank"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = Encoder(tokenizer_path), TaskContext.get().partitionId()
        ranks = [0] * (length // QUANTUM + 2)
        for batch in batches:
            at, starts, lengths, crcs, totals, classes, order, held = [], [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for s in range(0, len(ids), length):
                    piece = ids[s : s + length]
                    cls = -(-len(piece) // QUANTUM)
                    for col, v in zip((at, starts, lengths, crcs, totals, classes, order), (i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids), cls, ranks[cls]), strict=True):
                        col.append(v)
                    ranks[cls] += 1
                    if with_ids:
                        held.append(piece)
            cols = [batch.column(0).take(pa.array(at, pa.int32()))]
            cols += [pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals)]
            cols += [pa.array(classes, pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array(order, pa.int64())]
            if with_ids:
                cols.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, cls int, part int, rank bigint"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there, gapless from 0.

    The pieces go to the shared folder once; a rank within a class is the task's
    own count plus those of earlier tasks, so no class is gathered in one place.
    Only the histogram (``length / QUANTUM`` rows) reaches the driver. Repeated
    rows are packed each; an empty table gives no pieces.
    """
    if length % QUANTUM:
        raise ValueError(f"length must be a multiple of {QUANTUM}")
    pieces = save(pieces_of(docs, tokenizer_path, length, with_ids), "pieces").df
    per_task = pieces.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))
    demand = {r.cls: r.n for r in per_task.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    plan = plan_patterns(demand, length // QUANTUM)
    # for each class: the first rank, uses, first sequence and first slot of each pattern that holds it
    laid: dict[int, list[tuple[int, int, int, int]]] = {}
    given, sequence = dict.fromkeys(demand, 0), 0
    for fill, uses in zip(plan.fills, plan.uses, strict=True):
        slot = 0
        for cls in sorted(fill, reverse=True):
            laid.setdefault(cls, []).append((given[cls], uses, sequence, slot))
            given[cls] += uses * fill[cls]
            slot += fill[cls]
        sequence += uses
    tables = {c: np.array(rows, dtype=np.int64).T for c, rows in laid.items()}
    before = W.partitionBy("cls").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_task.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["cls", "part"])
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                own = cls == c
                first, uses, start, low = tables[int(c)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                i = rank[own] - first[k]
                seq[own], slot[own] = start[k] + i % uses[k], low[k] + i // uses[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(seq), pa.array(slot)], names=[*keep, "sequence_id", "slot"])

    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, " + "ids array<int>, " * with_ids + "sequence_id bigint, slot bigint"
    placed = ranked.mapInArrow(tidy(place), schema)
    along = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(*keep, "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packing_query(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Contract rows of op4."""
    return pack(documents, tokenizer_path or default_tokenizer())
