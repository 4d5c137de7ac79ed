"""Main text of web pages by removal of site templates.

Every page becomes a tree.  Its block subtrees are hashed over tag, class, text
and children; Spark counts on how many pages of its host each hash occurs;
blocks that recur on a share of their host's pages are deleted, within declared
content (``article`` or ``main``) only at a high share.  Pages with the same
content count once, so an article that is published again and again stays whole;
declared content that would be deleted to the last word stays as it is.
Headings, cells, items and inline elements go only with the block around them.
Parts that HTML itself marks as other than content (menus, footers, asides,
forms, scripts, and boxes whose class, id or role says advert, notice, comments
and so on, and nothing else) are deleted on every page, also on hosts with few
pages.

What is left is the text of the content elements, or of the body where a page
declares none: character references decoded, white space in a block one blank,
blocks joined by a line feed in page order.

A null page is an empty one and has an empty text.  A null or odd URL is a host
of its own (the empty one).  Repeated page ids are pages of their own.  Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import bisect
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: a subtree is a template on at least this many different pages of its host ...
MIN_PAGES = 3
#: ... and on this share of them; within declared content on this one
SHARE, ROOT_SHARE = 0.2, 0.5

#: templates that are sent to all executors, at most; more are joined
FEW_TEMPLATES = 1 << 18

# Fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
#: blocks that may be templates on their own; headings, items and cells are parts of what is around them
COUNTED = BLOCK - frozenset("body caption dd dt figcaption h1 h2 h3 h4 h5 h6 head hr html legend li option optgroup summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - frozenset("body head html caption tbody td tfoot th thead tr option optgroup legend".split())
#: an element that ends open ones of these kinds, up to the nearest of its containers
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: not content by their element
DROPPED = frozenset("head nav footer aside form button select input textarea dialog menu search script style noscript template iframe svg math title object embed audio video canvas".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: boxes are not content by a word of their class or id that is made of these ...
BOXES = frozenset("center details div dl figure ol section table ul".split())
DROPPED_WORDS = re.compile(
    r"ads?|advert(?:s|isement|ising)?|sponsor(?:ed|s)?|promo(?:s|tion)?|banner|cookie(?:s|bar|notice|banner)?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup"
    r"|(?:top)?nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|footer|masthead|share|sharing|social|related|recommended|comment(?:s|list|section|area)?|disqus|replies|pagination|pager|toolbar|widget",
    re.I,
)
#: ... and of these, which say nothing of what a box holds
PLAIN_WORDS = re.compile(r"area|articles|bar|block|bottom|box|buttons?|container|form|inner|items?|left|links|list|outer|posts|right|section|site|top|wrap(?:per)?|[0-9]+|", re.I)
ROOTS = frozenset(("article", "main"))

_TAG = re.compile(
    r"<!--(?:(?:-?>)|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("children", "digest", "dropped", "holds", "in_root", "kind", "mark", "root", "tag")

    def __init__(self, tag: str, kind: str, dropped: bool, root: bool, in_root: bool):
        self.tag, self.kind, self.dropped, self.root, self.in_root = tag, kind, dropped, root, in_root
        self.children: list[Node | str] = []
        self.digest: int | None = None  # of what is left of it; None if it has no text
        self.mark: int | None = None  # its digest, with the lowest bit for in_root, if it may be a template
        self.holds = root and not dropped  # it is a content root or has one in it


def _named_no_content(names: str) -> bool:
    """Whether a word of a class or id says that its box is no content, and nothing else."""
    return any(any(map(DROPPED_WORDS.fullmatch, parts)) and all(DROPPED_WORDS.fullmatch(p) or PLAIN_WORDS.fullmatch(p) for p in parts) for parts in (re.split("[_-]", w) for w in names.split()))


def _describe(tag: str, attrs: str, in_root: bool) -> tuple[str, bool, bool]:
    """Class of an element, whether it is no content, whether it is a content root."""
    cls, dropped, root = "", tag in DROPPED or tag == "header" and not in_root, tag in ROOTS
    if attrs.strip("/ \t\r\n"):
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        cls, role = named.get("class", ""), named.get("role", "").lower()
        if "hidden" in named or named.get("aria-hidden") == "true" or role in DROPPED_ROLES or re.search(r"display\s*:\s*none", named.get("style", "")):
            dropped = True
        elif tag in BOXES and (cls or named.get("id")) and (_named_no_content(cls) or _named_no_content(named.get("id", ""))):
            dropped = True
        root = root or role in ("main", "article")
    return cls, dropped, root


#: end tags that don't end declared content they stand in
INLINE = frozenset("p b i em strong a span div li".split())
#: a paragraph beyond one of these stays open
WALLS = ("td", "th", "caption", "table", "button", "object")


class Open:
    """The open elements, and where those of each tag stand among them, so that no
    step takes longer on a deep page."""

    def __init__(self, top: Node):
        self.stack, self.ended = [top], []
        self.at: dict[str, list[int]] = {}

    def push(self, x: Node) -> None:
        self.at.setdefault(x.tag, []).append(len(self.stack))
        self.stack.append(x)

    def last(self, *tags: str) -> int:
        """Where the innermost open element of some tags stands; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def end(self, depth: int) -> None:
        while len(self.stack) > depth:
            x = self.stack.pop()
            self.at[x.tag].pop()
            self.ended.append(x)

    def end_tag(self, tag: str) -> None:
        k = self.last(tag)
        if k and not (tag in INLINE and self.last(*ROOTS) > k):
            self.end(k)

    def make_room(self, tag: str) -> None:
        """End what a start tag ends: a paragraph, or the item or cell before it."""
        if tag in CLOSES_P:
            p = self.last("p")
            if p > self.last(*WALLS):
                self.end(p)
        elif tag in IMPLIED:
            ends, within = IMPLIED[tag]
            box = self.last(*within)
            above = [self.at[t][k] for t in ends if self.at.get(t) and (k := bisect.bisect_right(self.at[t], box)) < len(self.at[t])]
            if above:
                self.end(min(above))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree, and its elements in the order in which they end; in linear time."""
    top = Node("", "", False, False, False)
    now = Open(top)
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            now.stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            now.stack[-1].children.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                now.stack[-1].children.append(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            now.end_tag(tag)
            continue
        attrs = m[3] if m[2] else m[6]
        now.make_room(tag)
        up = now.stack[-1]
        cls, dropped, root = _describe(tag, attrs, up.in_root)
        node = Node(tag, cls, dropped or up.dropped, root, up.in_root or root)
        up.children.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            now.ended.append(node)
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            node.children.append(page[at : stop.start()] if stop else page[at:])
            now.ended.append(node)
            close = page.find(">", stop.end()) if stop else -1
            at = close + 1 if close >= 0 else n
        else:
            now.push(node)
    now.end(1)
    return top, now.ended


def _digest(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x01".join(parts)) - (1 << 63)


def mark_subtrees(ended: list[Node]) -> set[int]:
    """Digest every element with text, without what is no content; mark the blocks that
    may be templates, so none that holds declared content; returns the marks."""
    for x in ended:
        if x.dropped:
            continue
        parts = [x.tag, x.kind]
        for c in x.children:
            if c.__class__ is str:
                c = " ".join(c.split())
                if c:
                    parts.append(c)
            elif not c.dropped:
                x.holds = x.holds or c.holds
                if c.digest is not None:
                    parts.append(f"\x00{c.digest}")
        if len(parts) > 2:
            x.digest = _digest(parts)
            if x.tag in COUNTED and not x.root and (x.in_root or not x.holds):
                x.mark = x.digest | 1 if x.in_root else x.digest & ~1
    return {x.mark for x in ended if x.mark is not None}


def roots_of(top: Node) -> list[Node]:
    """The outermost elements that are declared content."""
    roots: list[Node] = []
    todo = [top]
    while todo:
        x = todo.pop()
        if x.dropped:
            continue
        if x.root:
            roots.append(x)
            continue
        todo += [c for c in reversed(x.children) if c.__class__ is not str]
    return roots


def content_digest(top: Node) -> int:
    """Equal for pages with the same content, after :func:`mark_subtrees`."""
    return _digest([f"\x00{c.digest}" if c.__class__ is not str else " ".join(c.split()) for c in roots_of(top) or top.children])


def main_text(top: Node, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of what is left, one line a block."""
    roots = roots_of(top)
    if not roots:
        return _text([top], templates)
    return _text(roots, templates) or (_text(roots, frozenset()) if templates else "")


def _text(roots: list[Node], templates: frozenset[int] | set[int]) -> str:
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            line = " ".join(html_lib.unescape("".join(run)).split())
            if line:
                lines.append(line)
            run.clear()

    for r in roots:
        work: list[Node | str | None] = [r]
        while work:
            x = work.pop()
            if x is None:
                flush()
            elif x.__class__ is str:
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif not (x.dropped or x.mark is not None and x.mark in templates):
                if x.tag in BLOCK:
                    flush()
                    work.append(None)
                work += reversed(x.children)
        flush()
    return "\n".join(lines)


def host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url and text of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hosts, contents, marks = [], [], [], []
            for i, h, p in zip(b.column(key).to_pylist(), b.column("host").to_pylist(), b.column(page).to_pylist(), strict=True):
                top, ended = parse(p or "")
                # a page without marks counts as one of its host's pages
                found = sorted(mark_subtrees(ended)) or [None]
                ids += [i] * len(found)
                hosts += [h] * len(found)
                contents += [content_digest(top)] * len(found)
                marks += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(key).type), pa.array(hosts, pa.int64()), pa.array(contents, pa.int64()), pa.array(marks, pa.int64())], names=[key, "host", "content", "mark"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, marks in zip(b.column(page).to_pylist(), b.column("marks").to_pylist(), strict=True):
                top, ended = parse(p or "")
                if marks:
                    mark_subtrees(ended)
                out.append(main_text(top, set(marks or ())))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(url), pa.array(out, pa.string())], names=[key, url, "text"])

    base = pages.select(key, url, page)
    hosted = base.withColumn("host", F.xxhash64(host(F.col(url))))
    marks = common.staged(hosted.select(key, "host", page).mapInArrow(hashes, f"{key} {kind}, host long, content long, mark long"), "marks")
    sizes = marks.groupBy("host").agg(F.countDistinct("content").alias("pages"))
    held = marks.where("mark IS NOT NULL")
    often = held.groupBy("host", "mark").agg(F.countDistinct("content").alias("n")).where(F.col("n") >= MIN_PAGES)
    share = F.when(F.col("mark").bitwiseAND(1) == 1, ROOT_SHARE).otherwise(SHARE)
    templates = common.join_salted(often, sizes, ["host"], ["mark"]).where(F.col("n") >= share * F.col("pages")).select("host", "mark")
    templates = common.staged(templates, "templates")
    # 16 bytes a template; where they are too many, the marks of a hot host are dealt to many tasks
    few = templates.count() <= FEW_TEMPLATES
    own = held.join(F.broadcast(templates), ["host", "mark"]) if few else common.join_salted(held, templates, ["host", "mark"], [key])
    own = own.groupBy(key).agg(F.collect_set("mark").alias("marks"))
    return base.join(own.hint("shuffle_hash"), key, "left").select(key, url, page, "marks").mapInArrow(cut, f"{key} {kind}, {url} string, text string")
