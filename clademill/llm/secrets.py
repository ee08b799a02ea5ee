"""Secret scans: base patterns, and literals that a lexer of assignments leads to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from clademill.llm.common import tidy

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # AKIA[A-Z0-9]+ of 18 characters and more
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

#: Span kinds, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "literal")
#: Parts of names that mark a sensitive target, with their weights.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "private": 1.5, "key": 1.5, "auth": 1.5, "access": 1.0, "signing": 1.0, "bearer": 2.0, "webhook": 1.0, "salt": 1.5, "cookie": 1.0, "session": 1.0, "dsn": 1.0}
#: A literal whose weighted score reaches this is a secret.
THRESHOLD = 4.0
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\)s|your[-_ ].*|change[-_ ]?me.*|example.*|placeholder|redacted|none|null|true|false|todo)$")

# The lexer's patterns. Repeats are possessive and what one pattern consumes is not read again by it, so a text takes linear time.
BLANK = re.compile(r"(?:[^\S\n]++|\\\r?\n)*+")
OPERATOR = r"(?::=|=>|=(?![=~])|:(?![:]))"
#: What the lexer stops at: an escape, quotes, a comment, a tag, a flag, or a name before an operator.
EVENT = re.compile(
    rf"""(?P<escape>\\[\s\S])|(?P<quote>\"{{3}}|'{{3}}|(?<!\w)'|["`])|(?P<comment>(?<!\S)\#|(?<![:\w])//|/\*|<!--)|<(?P<tag>[A-Za-z][\w:.\-]*+)
    |(?<!\S)--?(?P<flag>[A-Za-z][\w\-]*+)|(?<![\w$])(?P<name>[^\W\d][\w$]*+(?:[.\-][\w$]++)*+)(?=[\])]*+[^\S\n]*+{OPERATOR})""",
    re.VERBOSE,
)
AFTER_NAME = re.compile(rf"[\])]*+[^\S\n]*+(?P<op>{OPERATOR})")
STRINGS = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\[\s\S])*+){q}") for q in "\"'"} | {"`": re.compile(r"`((?:[^`\\]|\\[\s\S])*+)`")}
PREFIX = re.compile(r"[A-Za-z@$]{0,2}(?=[\"'`])")
JOIN = re.compile(r"[^\S\n]*+(?:(?:\+|\.{1,2}|&|\\\r?\n)\s*+)?(?=[A-Za-z@$]{0,2}[\"'`]|[A-Za-z_$])")
#: A type between a name and its value, as in ``name: str = ``.
ANNOTATION = re.compile(r"[^\S\n]*+[\w.\[\], |?]++=(?![=>~])")
HEREDOC = re.compile(r"""(?:\$\([^\S\n]*+cat[^\S\n]++)?<<[-~]?[^\S\n]*+(["']?)([A-Za-z_]\w*+)\1[^\n]*+\n""")
BLOCK = re.compile(r"[^\S\n]*+[|>][+\-\d]*+[^\S\n]*+\r?\n")
REFERENCE = re.compile(r"\$?\{?([^\W\d][\w$]*+(?:[.\-][\w$]++)*+)\}?(?![\w(+/=@:%^&*!?~])")
CALL = re.compile(r"[^\W\d][\w$.:]*+\(")
BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>=]++(?:={1,2}(?![\w=]))?+")
ATTRIBUTE = re.compile(r"""([\w:.\-]++)\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)')""")
TAG_END = re.compile(r"[^<>]*+>")
TAG_TEXT = re.compile(r"[^<]*+(?=</)")
PAIR = re.compile(r"\s*+,\s*+(?=[\"'])")
PAIRED_STRINGS = re.compile(r"[\"'][^\S\n]*+,\s*+[\"']")
#: A bare word of this kind is a literal and no name; names of constants are no secrets.
LIKE_LITERAL = re.compile(r"(?=.*\d)[\w.\-]{20,}")
#: A bare word that no statement binds is a literal if it has two runs of digits and letters of both cases.
UNBOUND = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*\d.*[A-Za-z].*\d)[A-Za-z0-9]{10,}")
CONSTANT = re.compile(r"[A-Z][A-Z_]*$")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass(frozen=True)
class Span:
    """A secret's place in its text, in code points, end exclusive."""

    kind: str
    start: int
    end: int
    name: str = ""
    score: float = 0.0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping in each kind."""
    found = [Span("assign", *m.span(), m[1]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [Span("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


@lru_cache(maxsize=20_000)
def name_score(name: str) -> float:
    """Summed weights of the sensitive parts of a name, once each."""
    parts = {p.lower() for p in CAMEL.findall(name)}
    joined = re.sub(r"[^a-z0-9]", "", name.lower())
    return sum(w for p, w in SENSITIVE.items() if p in parts) or max((w for p, w in SENSITIVE.items() if len(p) > 4 and p in joined), default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks random: length, entropy and mixed classes. Lines of one literal are joined."""
    value = "".join(x.strip() for x in value.splitlines()) if "\n" in value else value.strip()
    if len(value) < 8 or " " in value or PLACEHOLDER.match(value) or CONSTANT.match(value):
        return 0.0
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(len(value), 32) / 16 + max(0.0, entropy(value) - 2.0) + 0.25 * (classes - 1)


@dataclass
class Binding:
    """A name bound, at a place of the text, to literals ``(start, end)`` and to other names at such places."""

    name: str
    at: int
    literals: list[tuple[int, int]] = field(default_factory=list)
    refs: list[tuple[int, int]] = field(default_factory=list)


class Lexer:
    """Name-literal pairs of source and configuration syntax, with the names that names are bound to.

    Reads assignments, JSON and YAML entries with block scalars, keyword arguments,
    typed declarations, hash entries, call arguments ``("name", "literal")``, XML
    attributes and elements, heredocs, command flags, strings over lines and joined
    strings. Comments and the contents of strings are read in the same way. A
    statement's comment is not its value.
    """

    def __init__(self, text: str):
        self.text = text
        self.bindings: list[Binding] = []
        self._open: set[str] = set()  # kinds of quotes without a further end
        self._read(0, len(text))

    def _string(self, at: int, end: int) -> tuple[int, int, int] | None:
        """Start and end of a literal's content, and the end with its quotes, of a string that begins at ``at``."""
        text = self.text
        quote = text[at : at + 3] if text.startswith(('"""', "'''"), at) else text[at]
        if len(quote) == 3:
            stop = text.find(quote, at + 3, end) if quote not in self._open else -1
            while stop > 0 and text[stop - 1] == "\\":  # an escaped quote
                stop = text.find(quote, stop + 1, end)
            if stop >= 0:
                return at + 3, stop, stop + 3
            self._open.add(quote)
            quote = quote[0]
        if quote == "`" and quote in self._open:
            return None
        m = STRINGS[quote].match(text, at, end)
        if m is None:
            self._open.update({"`"} & {quote})
            return None
        return m.start(1), m.end(1), m.end()

    def _inside(self, start: int, end: int) -> None:
        """Pairs in the content of a string."""
        if end - start > 3 and any(c in self.text[start:end] for c in "=:"):
            before, self._open = self._open, set()
            self._read(start, end)
            self._open = before

    def _value(self, b: Binding, at: int, end: int, op: str, line: int) -> int:
        """Reads what a name is bound to; returns where to read on."""
        text = self.text
        if op == ":":
            m = BLOCK.match(text, at, end)
            if m:  # lines indented deeper than the name's
                deep = at_line = m.end()
                own = len(text[line:at]) - len(text[line:at].lstrip(" -"))
                while at_line < end:
                    stop = text.find("\n", at_line, end)
                    stop = end if stop < 0 else stop
                    row = text[at_line:stop]
                    if row.strip() and len(row) - len(row.lstrip(" ")) <= own:
                        break
                    deep, at_line = stop, stop + 1
                if deep > m.end():
                    b.literals.append((m.end(), deep))
                return m.end()
            typed = ANNOTATION.match(text, at, end)
            at = typed.end() if typed else at
        at = start = BLANK.match(text, at, end).end()
        opened = 0
        while text.startswith("(", at) and at < end:  # a value in brackets may begin on a later line
            opened += 1
            at += 1
            while at < end and text[at].isspace():
                at += 1
        m = HEREDOC.match(text, at, end)
        if m:
            stop = re.compile(rf"^[ \t]*+{m[2]}\b", re.MULTILINE).search(text, m.end(), end) if m[2] not in self._open else None
            if stop:
                b.literals.append((m.end(), max(m.end(), stop.start() - 1)))
                return stop.end()
            self._open.add(m[2])
            return m.end()
        read = at
        while at < end:
            quoted = PREFIX.match(text, at, end)
            found = self._string(quoted.end(), end) if quoted and quoted.end() < end else None
            if found:
                if found[1] > found[0]:
                    b.literals.append(found[:2])
                    self._inside(*found[:2])
                at = read = found[2]
            elif quoted:
                break
            elif CALL.match(text, at, end):
                return at if at > start else start
            elif m := REFERENCE.match(text, at, end):
                if LIKE_LITERAL.fullmatch(m[1]):
                    b.literals.append(m.span(1))
                    read = m.end()
                else:
                    b.refs.append(m.span(1))
                    read = at if not b.literals and len(b.refs) == 1 else m.end()
                at = m.end()
            elif not b.literals and not b.refs and (m := BARE.match(text, at, end)):
                if text.startswith("#", at) or text.startswith("//", at):
                    return at
                b.literals.append(m.span())
                return m.end()
            else:
                break
            if opened:
                while at < end and text[at].isspace():
                    at += 1
            m = JOIN.match(text, at, end)
            if not m or not opened and m.end() == at and text[at : at + 1].isalpha():
                break
            if text[m.end()].isalpha() and m[0].strip() == "":
                break  # two words are no joined value
            at = m.end()
        return max(read, start)

    def _read(self, at: int, end: int) -> None:
        text, bindings = self.text, self.bindings
        while m := EVENT.search(text, at, end):
            at, kind = m.end(), m.lastgroup
            if kind == "quote":
                found = self._string(m.start(), end)
                if found is None:
                    at = m.start() + 1
                    continue
                start, stop, at = found
                name = text[start:stop]
                after = AFTER_NAME.match(text, at, end)
                if after and "\n" not in name:
                    b = Binding(name, m.start())
                    bindings.append(b)
                    at = self._value(b, after.end(), end, after["op"], text.rfind("\n", max(0, start - 200), start) + 1)
                    continue
                self._inside(start, stop)
                pair = PAIR.match(text, at, end)
                if pair and name_score(name) > 0:
                    b = Binding(name, m.start())
                    if given := self._string(pair.end(), end):
                        b.literals.append(given[:2])
                        bindings.append(b)
            elif kind == "name" or kind == "flag" and AFTER_NAME.match(text, at, end):
                after = AFTER_NAME.match(text, at, end)
                b = Binding(m[kind], m.start())
                bindings.append(b)
                at = max(self._value(b, after.end(), end, after["op"], text.rfind("\n", max(0, m.start() - 200), m.start()) + 1), after.end())
            elif kind == "flag" and name_score(m["flag"]) > 0:
                blank = BLANK.match(text, at, end).end()
                if blank > at and blank < end and text[blank] not in "-\n":
                    b = Binding(m["flag"], m.start())
                    bindings.append(b)
                    at = self._value(b, at, end, "=", 0)
            elif kind == "tag":
                self._tag(m["tag"], at, end)

    def _tag(self, tag: str, at: int, end: int) -> None:
        """``<name>literal</name>``, and ``name`` or ``key`` beside ``value`` or text. Its attributes are read as assignments too."""
        text = self.text
        close = TAG_END.match(text, at, end)
        if not close:
            return
        told = {a[1].lower(): (a[2] or a[3] or "", a.span(2) if a[2] is not None else a.span(3)) for a in ATTRIBUTE.finditer(text, at, close.end())}
        name = next((told[k][0] for k in ("name", "key", "id") if k in told and name_score(told[k][0]) > 0), tag)
        if name_score(name) <= 0:
            return
        if "value" in told:
            self.bindings.append(Binding(name, at, [told["value"][1]]))
        body = TAG_TEXT.match(text, close.end(), end)
        if body and body[0].strip():
            self.bindings.append(Binding(name, at, [body.span()]))


def lexed_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through other names.

    A name that is used as a value stands for its last binding before that place,
    or for its first one where there is none before; a bare word that is bound nowhere
    and looks random is a literal. From every sensitive name, the
    most sensitive first, bindings are followed through any number of names; each is
    visited once.
    """
    if not any(c in text for c in "=:<") and "--" not in text and not PAIRED_STRINGS.search(text):
        return []
    bindings = sorted(Lexer(text).bindings, key=lambda b: b.at)
    known: dict[str, list[int]] = {}
    for i, b in enumerate(bindings):
        known.setdefault(b.name, []).append(i)
        if (last := re.split(r"[.\]]", b.name)[-1]) != b.name:
            known.setdefault(last, []).append(i)

    def bound(name: str, before: int) -> int | None:
        own = known.get(name) or known.get(name.rpartition(".")[2])
        if not own:
            return None
        k = bisect_left(own, before)
        return own[k - 1] if k else next((i for i in own if i != before), None)

    scored = sorted(((name_score(b.name), -i) for i, b in enumerate(bindings)), reverse=True)
    found: dict[tuple[int, int], Span] = {}
    seen: set[int] = set()
    for target, i in scored:
        if target <= 0:
            break
        todo = [-i]
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            b = bindings[k]
            own = literal_score("".join(text[s:e] for s, e in b.literals))
            if own and target + own >= THRESHOLD:
                for start, end in b.literals:
                    found.setdefault((start, end), Span("literal", start, end, bindings[-i].name, round(target + own, 3)))
            for start, end in b.refs:
                if (to := bound(text[start:end], k)) is not None:
                    todo.append(to)
                elif UNBOUND.fullmatch(text[start:end]) and target + (own := literal_score(text[start:end])) >= THRESHOLD:
                    found.setdefault((start, end), Span("literal", start, end, bindings[-i].name, round(target + own, 3)))
    return sorted(found.values(), key=lambda s: (s.start, s.end))


def scan(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind; null and empty texts have none.

    A lexed literal inside a base span is not repeated.
    """
    if not text:
        return []
    base = sorted(base_spans(text), key=lambda s: s.start)
    starts, reach = [b.start for b in base], list(accumulate((b.end for b in base), max))
    more = [s for s in lexed_spans(text) if not (k := bisect_right(starts, s.start)) or reach[k - 1] < s.end]
    return sorted([*base, *more], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, spans)`` for every row of ``docs``, in one pass without a shuffle.

    Null and empty texts have no spans; repeated rows and null ids are answered
    row by row; other columns are not read.
    """
    ids = docs.schema[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            spans = [[vars(s) for s in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_column, "spans"])

    return docs.select(id_column, text_column).mapInArrow(tidy(run), f"`{id_column}` {ids.dataType.simpleString()}, spans {SPANS}")


def secrets_query(documents: DataFrame) -> DataFrame:
    """Contract rows of op2, derived from :func:`find_secrets`."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if s["kind"] != "literal"]
                told = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x) for x in (base, spans)]
                counts = [sum(s["kind"] == k for s in base) for k in KINDS[:3]]
                for col, v in zip(out, [*counts, hashlib.sha256(told[0].encode()).hexdigest(), told[1]], strict=True):
                    col.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find_secrets(documents).mapInArrow(tidy(digest), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
