"""HTML main text by consensus host paths.

Every page's containers are scored; pages of a host vote, in Spark, on the
generalised tag-class path of their best container; each page is then extracted
again from the container at its host's winning path. Names of classes are evidence
that is weighed against the text an element holds; they never remove an article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import BROADCAST_IDS, save, tidy

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements whose content is never main text; a form may wrap a whole page and is weighed.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe svg canvas object embed audio video dialog menu map xmp noembed noframes label datalist".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Open elements that a start tag closes, up to the nearest scope element.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
MARKED = frozenset(x for d in (CLOSES, SCOPES) for s in d.values() for x in s)
CONTAINERS = frozenset(["", *"body article main section div td form".split()])  # the page itself where it names no body

#: Where markup begins; any other "<" is text.
MARKUP = re.compile(r"<(?:/?[a-zA-Z]|[!?/])")
#: A tag by the rules for attributes. All repeats are possessive, so a match takes linear time.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+)*+)>""")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
NAMED = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII) for t in RAW}
#: Words of class, id and role names that speak for content beside the article, of which some for readers' comments.
BESIDE = re.compile(r"ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|foot|masthead|siteheader|pageheader|topbar|share|sharing|social|related|recommend\w*|newsletter|subscribe\w*|signup|login|widgets?|pagination|pager|toolbar|search\w*|copyright|legal|skiplink|complementary|contentinfo")
COMMENT = re.compile(r"comments?|commentlist|replies|respond|disqus")
GOOD = re.compile(r"article|content|main|post|entry|story|body|text")
#: Names that tell of a state or a layout, such as ``has-sidebar``; and, on the page and its article themselves, such as ``comments-open``.
STATE = re.compile(r"(?:has|no|with|without|is|supports)[-_].*")
STATE_OF_PAGE = re.compile(r".*[-_](?:open|closed|enabled|disabled|on|off|visible|active|left|right|layout)|(?:show|hide)[-_].*")
PAGE = frozenset("html body main article".split())
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
PAIRED = re.compile(r"(?i)(site|page)[-_]?(header)|(skip)[-_]?(link)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"[\s\xa0]+")
#: Shares of a page's text: what an element with names of both kinds, one with a heading, and any other must hold to stay against its names.
MIXED, HEADED, MOST, THREAD = 0.15, 0.25, 0.5, 0.9


class Names:
    """What an element's attributes tell: its generalised classes, and evidence for and against."""

    __slots__ = ("bad", "comment", "general", "good", "hidden")

    def __init__(self, attributes: str, page: bool = False):
        self.general, self.hidden = "", False
        self.bad = self.comment = self.good = 0
        if not NAMED.search(attributes):
            return
        seen: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in seen:  # the first of an attribute holds
                continue
            seen.add(name)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                self.hidden = True
            elif name in ("class", "id", "role"):
                words = value.split()
                if name == "class":
                    self.general = "".join(f".{DIGITS.sub('#', c.lower())}" for c in sorted(set(words)))
                for word in words:
                    if not STATE.fullmatch(word.lower()) and not (page and STATE_OF_PAGE.fullmatch(word.lower())):
                        self._weigh(word)

    def _weigh(self, name: str) -> None:
        parts = [x.lower() for x in PARTS.findall(PAIRED.sub(lambda m: "".join(x.lower() for x in m.groups() if x), name))]
        if any(COMMENT.fullmatch(x) for x in parts):
            self.comment += 1
        elif any(BESIDE.fullmatch(x) for x in parts):
            self.bad += 1
        elif any(GOOD.fullmatch(x) for x in parts):
            self.good += 1


class Node:
    """One element: its direct parts in page order, and measures of what it holds."""

    __slots__ = ("block", "core", "depth", "gone", "inside", "links", "main", "marks", "names", "parent", "parts", "path", "tag", "text")

    def __init__(self, tag: str, path: int, names: Names, parent: Node | None):
        self.tag, self.path, self.names, self.parent, self.parts = tag, path, names, parent, []
        self.text = self.links = self.core = self.main = 0
        self.gone = self.inside = False
        if parent is None:
            self.depth, self.block, self.marks = 0, self, {}
            return
        self.depth = parent.depth + 1
        self.block = self if tag in BLOCKS else parent.block
        self.marks = {**parent.marks, tag: self} if tag in MARKED else parent.marks


class Page:
    """The element tree of a page, tolerant of unclosed, stray and cut-off tags.

    Linear in the page: nothing scans the open elements but what it closes, and a
    path is a hash of the parent's path and the element's tag and classes.
    """

    #: Attribute strings whose names are remembered by a worker.
    MEMO = 20_000
    _known: dict[str, Names] = {}

    def __init__(self, source: str):
        self.root = Node("", 0, Names(""), None)
        self.nodes = [self.root]
        self._parse(source)
        self._measure()

    def _named(self, attributes: str, page: bool) -> Names:
        known = f"{attributes}\0" if page else attributes
        found = self._known.get(known)
        if found is None:
            if len(self._known) >= self.MEMO:
                self._known.clear()
            found = self._known[known] = Names(attributes, page)
        return found

    def _child(self, node: Node, tag: str, attributes: str) -> Node:
        names = self._named(attributes, tag in PAGE)
        child = Node(tag, xxhash.xxh3_64_intdigest(f"{tag}{names.general}".encode("utf-8", "replace"), node.path) >> 1, names, node)
        node.parts.append(child)
        self.nodes.append(child)
        return child

    def _parse(self, source: str) -> None:
        node, at, size = self.root, 0, len(source)
        opened: dict[str, int] = {}  # open elements by tag

        def up_to(to: Node) -> Node:
            nonlocal node
            while node is not to:
                opened[node.tag] -= 1
                node = node.parent
            return to

        while at < size:
            m = MARKUP.search(source, at)
            text = source[at : m.start() if m else size]
            if text:
                node.parts.append(text)
            if not m:
                return
            at = m.start()
            tag = TAG.match(source, at) if m[0][-1].isalpha() else None
            if tag is None:
                if m[0][-1].isalpha():
                    return  # a tag that the page's end cuts off
                close = "-->" if source.startswith("<!--", at) else ">"
                end = source.find(close, at + 2)
                if end < 0:
                    return
                at = end + len(close)
                continue
            at, name, attributes = tag.end(), tag[2].lower(), tag[3]
            if tag[1]:
                if opened.get(name):
                    up = node
                    while up.tag != name:
                        up = up.parent
                    up_to(up.parent)
                elif name in ("br", "p"):
                    self._child(node, name, "")
                continue
            # start tags that end open elements
            if name in BLOCKS and node.block.tag == "p":
                up_to(node.block.parent)
            if name in CLOSES:
                floor = max((node.marks[t].depth for t in SCOPES[name] if t in node.marks), default=-1)
                ends = [node.marks[t] for t in CLOSES[name] if t in node.marks and node.marks[t].depth > floor]
                if ends:
                    up_to(min(ends, key=lambda x: x.depth).parent)
            child = self._child(node, name, attributes)
            if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW:
                continue
            if name in RAW:
                end = ENDS[name].search(source, at) if name != "plaintext" else None
                child.parts.append(source[at : end.start() if end else size])
                close = source.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else size
                continue
            node = child
            opened[name] = opened.get(name, 0) + 1

    def _measure(self) -> None:
        """Text, link text and cores below every element; then, from the top, what is beside the article."""
        for node in reversed(self.nodes):
            text = sum(len(x) - x.count(" ") - x.count("\n") for x in node.parts if isinstance(x, str))
            node.text += text
            if node.tag == "a":
                node.links = node.text
            elif node.tag in ("article", "h1"):
                node.core += 1
            elif node.tag == "main":
                node.core, node.main = node.core + 1, node.main + 1
            up = node.parent
            if up is not None and not node.names.hidden and (node.tag == "form" or node.tag not in DROPPED):
                up.text += node.text
                up.links += node.links
                up.core += node.core
                up.main += node.main
        for node in self.nodes[1:]:
            up = node.parent
            node.gone = up.gone or self._beside(node, up.inside)
            node.inside = up.inside or node.tag in ("article", "main")

    def _beside(self, node: Node, inside: bool) -> bool:
        """Whether an element is beside the article; a page's header is, an article's own is not."""
        names, tag, whole = node.names, node.tag, self.root
        if names.hidden or tag in DROPPED and tag != "form":
            return True
        if not (names.bad or names.comment or tag == "form" or tag == "header" and not inside):
            return False
        if tag in ("html", "body", "main"):
            return False
        if tag == "article" and (not inside or names.good):
            return False
        share = node.text / whole.text if whole.text else 0.0
        linked = node.links / node.text if node.text else 1.0
        if node.main or share >= THREAD:
            return False
        if names.comment and not names.bad:
            return not (node.core and node.core == whole.core and share >= HEADED and names.good)
        if share >= MOST and linked < 0.5 and node.core == whole.core:
            return False
        if node.core and share >= HEADED and linked < 0.5:
            return False
        return not (names.good and share >= MIXED and linked < 0.3)

    def containers(self) -> list[tuple[Node, float]]:
        """Containers with scores: own and near text, less links, by tag and names.

        A paragraph counts for its parent in full and for the grandparent by half.
        """
        own: dict[int, list] = {}  # by the block's number: its text and link text through inline elements
        link: set[int] = set()
        scores: dict[int, tuple[Node, float]] = {}
        over: dict[int, Node | None] = {}  # the nearest container at or above a node
        for node in self.nodes:
            up = node.parent
            over[id(node)] = node if node.tag in CONTAINERS else over[id(up)] if up is not None else None
            if node.gone:
                continue
            if node.tag == "a" or up is not None and id(up) in link and node.tag not in BLOCKS:
                link.add(id(node))
            text = sum(len(x) - x.count(" ") for x in node.parts if isinstance(x, str))
            if text:
                got = own.setdefault(id(node.block), [node.block, 0, 0])
                got[1] += text
                got[2] += text if id(node) in link else 0
        for block, text, links in own.values():
            if text <= 2 * links:
                continue
            at = block if block.tag in CONTAINERS else block.parent
            for share in (1.0, 0.5):
                at = over[id(at)] if at is not None else None
                if at is None:
                    break
                scores[id(at)] = (at, scores.get(id(at), (at, 0.0))[1] + share * (text - 2 * links))
                at = at.parent
        bonus = {"article": 1.6, "main": 1.4}
        return [(n, s * bonus.get(n.tag, 1.2 if n.names.good else 1.0) * (0.9 if n.tag in ("", "body") else 1.0)) for n, s in scores.values()]

    def best(self) -> tuple[Node | None, float]:
        """A page's best container and its score, the first of the page on ties."""
        return max(self.containers(), key=lambda x: x[1], default=(None, 0.0))

    def at(self, path: int) -> list[Node]:
        """The outermost elements with the path, in page order."""
        out, below = [], set()
        for node in self.nodes:
            if node.parent is not None and id(node.parent) in below:
                below.add(id(node))
            elif node.path == path and not node.gone:
                out.append(node)
                below.add(id(node))
        return out


def blocks_of(top: Node) -> list[str]:
    """The text blocks of a container in page order, white space folded, without empty ones."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = SPACE.sub(" ", html.unescape("".join(line))).strip()
            if text:
                out.append(text)
            line.clear()

    # depth first without recursion, since pages may nest deeply
    stack: list = [(iter(top.parts), True)]
    while stack:
        parts, block = stack[-1]
        for part in parts:
            if isinstance(part, str):
                line.append(part)
                continue
            if part.tag in ("br", "wbr"):
                line.append(" " if part.tag == "br" else "")
                continue
            is_block = part.tag in BLOCKS
            if part.gone:
                flush() if is_block else line.append(" ")
                continue
            if is_block:
                flush()
            stack.append((iter(part.parts), is_block))
            break
        else:
            if block:
                flush()
            stack.pop()
    flush()
    return out


def best_path(source: str) -> tuple[int | None, float]:
    """Path and score of a page's best container, the first on ties; null if it has none."""
    node, score = Page(source).best()
    return (None if node is None else node.path), score


def extract(source: str | None, path: int | None = None) -> str:
    """Main text of a page from the containers at ``path``, or from its own best container.

    A path that the page lacks falls back to its own best container and then to the
    whole body; so does one at which it has less than half of its text, where that
    gives more. Blocks are joined by line feeds.
    """
    if not source:
        return ""
    page = Page(source)
    told = lambda nodes: "\n".join(b for n in nodes for b in blocks_of(n))
    where = page.at(path) if path is not None else []
    text = told(where)
    if text and sum(n.text for n in where) * 2 >= page.root.text:
        return text
    node, _ = page.best()
    own = told([node]) if node is not None else ""
    return max(text, own, key=len) or told([page.root])


def host_of(url: str):
    """The lower-case host of a url column without a leading ``www.`` or ``m.``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def winning_paths(pages: DataFrame) -> DataFrame:
    """``(host, path, votes, pages)``: per host the path most pages vote for; then the higher score, then the path.

    Votes are counted before anything is ranked, so a host with any number of
    pages gives one row per path. ``path`` is the hash of a generalised path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_path(h.as_py()) if h.is_valid and h.as_py() else (None, 0.0) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in best], pa.int64()), pa.array([s for _, s in best], pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host_of("url").alias("host"), "html").mapInArrow(tidy(run), "host string, path bigint, score double")
    counted = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("score"))
    best = F.max_by("path", F.struct("votes", "score", "path"))
    return counted.groupBy("host").agg(best.alias("path"), F.max("votes").alias("votes"), F.sum("votes").alias("pages"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages``.

    Null and empty pages give the empty text; a null url has the empty host;
    repeated rows are answered each; other columns are not read. The winning paths
    go to a table of one row per host. Up to ``BROADCAST_IDS`` hosts it is broadcast
    and no page is shuffled; beyond, those of the most pages are broadcast, and only
    pages of the others are shuffled by host.
    """
    page_id = pages.schema["page_id"].dataType.simpleString()
    winners = save(winning_paths(pages), "winning-paths").df
    keyed = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    if winners.count() <= BROADCAST_IDS:
        joined = keyed.join(F.broadcast(winners.select("host", "path")), "host", "left")
    else:
        large = save(winners.orderBy(F.desc("pages"), "host").limit(BROADCAST_IDS), "large-hosts").df
        small = winners.join(large, "host", "left_anti").select("host", "path")
        named = keyed.join(F.broadcast(large.select("host", "path")), "host", "left")
        joined = named.where("path IS NOT NULL").unionByName(named.where("path IS NULL").drop("path").join(small, "host", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(tidy(run), f"page_id {page_id}, url string, text string")


def html_query(pages: DataFrame) -> DataFrame:
    """Contract rows of op8."""
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
