"""Token alignment against overlaps counted one by one."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clademill.llm import token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def spans(self, text):
        """Ids with where they begin and end, by either tokenizer."""
        sides = []
        a = self.a.encode(f" {text}", add_special_tokens=False)
        b = self.b.encode(text)
        of_b = [self.b.id_to_piece(i) for i in b]
        for ids, parts in ((a.ids, [bytes(self.byte[c] for c in t) for t in a.tokens]), (b, [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, of_b, strict=True)])):
            if b"".join(parts) != f" {text}".encode():
                return [], []
            ends, at = [], 0
            for i, part in zip(ids, parts, strict=True):
                ends.append((i, at, at := at + len(part)))
            sides.append(ends)
        return sides

    def rows(self, texts):
        told, counts = [], Counter()
        for text in texts:
            a, b = self.spans(text) if text else ([], [])
            links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
            shared, groups, start = sorted({e for *_, e in a} & {e for *_, e in b}), [], 0
            for end in shared:
                groups.append("|".join(",".join(str(i) for i, _, e in side if start < e <= end) for side in (a, b)))
                start = end
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            told.append((len(a), len(b), len(groups), links, digest))
            counts.update(links)
        most = {}
        for (_, j), n in counts.items():
            most[j] = max(n, most.get(j, 0))
        return [(x, y, g, len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), d) for x, y, g, links, d in told]


TEXTS = ["Hello world, hello words", None, "", " ", "  two  spaces ", "a<|endoftext|>b <s> </s> <0x41>", "naïve café 東京都 🦜🦜", "tab\tand\nline\r\n", "▁ under", "x" * 300, "über " * 40, "Hello world, hello words", "1234567890 12,5 %", "\u0000 nul", "fin ﬁn ①", "don't we'll I'M"]


def _got(docs, **options):
    rows = token_align.align_query(docs, **options).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in rows)


def test_alignment_equals_counting_one_by_one(spark, plain):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").repartition(3)
    assert _got(docs) == [(False, i, *r) for i, r in enumerate(plain.rows(TEXTS))]


def test_rows_without_or_of_one_id_and_clashing_columns(spark, plain):
    texts = ["one text", "another text", "one text", "no id", "no id"]
    ids = [7, 7, 7, None, None]
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, row string, pairs string, n int")
    want = sorted((i is None, i or 0, *r) for i, r in zip(ids, plain.rows(texts), strict=True))
    assert _got(docs) == want


def test_no_documents_and_only_texts_without_tokens(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_align.align_query(none).collect() == []
    bare = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert _got(bare) == [(False, 1, 0, 0, 0, 0, 0, 0, ""), (False, 2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_and_a_shuffle_of_counts_change_nothing(spark, plain, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    want = _got(docs)
    monkeypatch.setattr("clademill.llm.common.BROADCAST_IDS", 3)
    assert _got(docs) == want
    own = token_align.Aligner(A, B)
    one, all_at_once = [own([t]) for t in TEXTS], own(TEXTS)
    for key, values in all_at_once.items():
        for i, x in enumerate(one):
            assert list(map(str, values[i])) == list(map(str, x[key][0])) if hasattr(values[i], "__len__") else values[i] == x[key][0], key


def test_very_long_texts(spark, plain):
    texts = ["word and other words " * 30_000, " " * 60_000 + "end", "a" * 200_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = _got(docs)
    for (_, _, n_a, n_b, n_groups, n_links, *_), text in zip(got, texts, strict=True):
        a, b = plain.spans(text)
        assert (n_a, n_b) == (len(a), len(b)) and n_groups == len({e for *_, e in a} & {e for *_, e in b})
        assert n_links == len({e for *_, e in a} | {e for *_, e in b})


def test_groups_as_arrays(spark, plain):
    docs = spark.createDataFrame([(1, "naïve café 東京都"), (2, None)], "doc_id bigint, text string")
    one, none = sorted(token_align.align(docs, A, B, groups=True).collect(), key=lambda r: r.doc_id)
    a, b = plain.spans("naïve café 東京都")
    assert one.a_ids == [i for i, *_ in a] and one.b_ids == [i for i, *_ in b]
    assert sum(one.a_sizes) == one.n_a and sum(one.b_sizes) == one.n_b and len(one.a_sizes) == one.n_groups
    assert none.a_ids == [] and none.pairs == []


def test_new_words_are_encoded_together_and_equal_whole_texts(plain, monkeypatch):
    monkeypatch.setattr(token_align.Words, "LIMIT", 60)
    texts = [f"word{i} w{i % 7}, it's\tx{i} {i * 977} é{i}" for i in range(300)]
    texts += ["a\n \nb", "a \n b", "x\n y", "q \n\n z\n", "\n \n", "a\t \tb it's", "n\n", "\x1c \x1d", "a　 　b"]
    a, b = token_align.ByteLevel(A), token_align.Pieces(B)
    calls = []
    words = token_align.Words(a, b)
    monkeypatch.setattr(type(a), "__call__", lambda self, text, own=type(a).__call__: calls.append(text) or own(self, text))
    for part in (texts[:150], texts[150:], texts[:150]):
        for text, *got in zip(part, *words(part), strict=True):
            assert [x.tolist() for x in got] == [[i for i, *_ in side] for side in plain.spans(text)]
    assert len(calls) < 30  # a text each before
