"""Main text of web pages, with the templates of each site removed.

First pass: every element subtree of a page is hashed (tag, attributes that name it, text) and counted once a page;
the counts are added up by host in Spark. Second pass: subtrees that recur on many pages of their host are cut, then
what the page itself marks as no content (navigation, forms, notices, comments and so on), and the text of the
article that is left is read block by block.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeline.llm.common import stored
from quakeline.llm.urls import host_of

#: A subtree is template if it recurs on this many pages of its host and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: On large hosts this many times the square root of their pages is enough, if that is less than the share.
ROOTS = 10
#: Elements that hold a page's content; they, and what they stand in, are no template.
CONTENT = frozenset("html body main article".split())
#: Templates of this many hashes together (8 bytes each) are broadcast to the pages; more are joined by a shuffle.
BROADCAST_HASHES = 2_000_000
#: Pages that a worker reads at a time.
TOGETHER = 64

# Elements of HTML by what a reader of text needs to know of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
DROPPED = frozenset("script style textarea title noscript iframe template xmp head nav footer aside form button select option svg canvas object audio video dialog menu input label fieldset".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose start closes an open one of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"div", "article", "section", "td", "th", "li", "body", "main", "aside", "footer", "header", "nav", "form", "blockquote"}}
#: Words in class, id or role that mark what is no content, if all other words of the same name are NEUTRAL: `share` and
#: `share-buttons` mark, `share-price` does not.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay "
    "sidebar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc footer masthead topbar toolbar header "
    "comment comments commentlist respond disqus replies reply share sharing social related recommended recommendations teaser teasers widget widgets login search searchbox complementary contentinfo dialog form skip".split()
)
NEUTRAL = frozenset(
    "area articles bar block body bottom box btn button buttons col container content copyright desktop fixed global group holder icon icons inner item items left legal link links list main mobile outer page panel post posts "
    "primary right row secondary section site slot sticky stories text title to top unit wrap wrapper".split()
)
#: Inside an article these may hold its own title.
TITLES = frozenset(["header", "masthead", "banner"])
#: Open elements that a page can nest; deeper ones are read as text of the innermost.
DEPTH = 1024

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag. Quotes count after = only, as browsers read them; nothing is tried twice, so the time is linear.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "marks", "named", "tag")

    def __init__(self, tag: str, named: str = "", marks: frozenset[str] = frozenset()) -> None:
        self.tag, self.named, self.marks = tag, named, marks  # no way up: a tree without cycles is freed at once
        self.children: list = []


def _marks(value: str) -> set[str]:
    """The marking words of the names in an attribute's value."""
    out: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if (own := words & MARKS) and words <= MARKS | NEUTRAL:
            out |= own
    return out


def _naming(attributes: str) -> tuple[str, frozenset[str]]:
    """The attributes that name an element, and the marks in them; 'hidden' for what isn't shown."""
    if not attributes or attributes.isspace():
        return "", frozenset()
    named, words = [], set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        if key in ("class", "id", "role"):
            named.append(value)
            words |= _marks(value)
        elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _HIDES.search(value)):
            words.add("hidden")
    return " ".join(named), frozenset(words)


def parse(page: str) -> Node:
    """Tree of elements and text of any markup, however broken: unclosed elements end with their parent. Takes linear time."""
    root = Node("#root")
    open_, names, flat = [root], Counter(), Counter()
    at, end, quotes = 0, len(page), True
    while at < end:
        start = page.find("<", at)
        while 0 <= start and not (page[start + 1 : start + 2] in ("!", "?") or _NAME.match(page, start + 1 + (page[start + 1 : start + 2] == "/"))):
            start = page.find("<", start + 1)  # a sign, no tag
        if start < 0:
            open_[-1].children.append(page[at:])
            break
        if start > at:
            open_[-1].children.append(page[at:start])
        if page[start + 1] in "!?":
            close = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
            stop = page.find(close, start + 2)
            at = end if stop < 0 else stop + len(close)
            continue
        name = _NAME.match(page, start + 1 + (page[start + 1] == "/"))
        tag, attributes = name[0].lower(), ""
        rest = _REST.match(page, name.end()) if quotes and page[start + 1] != "/" else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            if page[start + 1] != "/":
                quotes = False  # a quote was never closed: from here on they mean nothing
            stop = page.find(">", name.end())
            if stop < 0:
                open_[-1].children.append(page[start:])
                break
            attributes, at = page[name.end() : stop], stop + 1
        if page[start + 1] == "/":
            if flat[tag]:
                flat[tag] -= 1
            elif names[tag]:
                _close(open_, names, next(i for i in range(len(open_) - 1, 0, -1) if open_[i].tag == tag))
            continue
        if tag in ENDS_P:
            _end(open_, names, {"p"}, FENCES["p"])
        if tag in CLOSES:
            _end(open_, names, CLOSES[tag], FENCES.get(tag, set()))
        new = Node(tag, *_naming(attributes))
        open_[-1].children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            new.children.append(page[at : close.start() if close else end])
            stop = page.find(">", close.end()) if close else -1
            at = end if stop < 0 else stop + 1
        elif tag not in VOID and not attributes.endswith("/"):
            if len(open_) < DEPTH:
                open_.append(new)
                names[tag] += 1
            else:
                flat[tag] += 1
    return root


def _close(open_: list[Node], names: Counter, i: int) -> None:
    names.subtract(n.tag for n in open_[i:])
    del open_[i:]


def _end(open_: list[Node], names: Counter, tags: set[str], fences: set[str] | frozenset[str]) -> None:
    """Close the innermost of the open elements that has one of the tags, unless a fence stands before it."""
    if not any(names[t] for t in tags):
        return
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag in fences:
            return
        if open_[i].tag in tags:
            _close(open_, names, i)
            return


def subtree_hashes(root: Node) -> dict[int, list[Node]]:
    """Hash of every block's subtree that holds text, and the elements that have it; marked-up words are no template,
    nor is what holds the content. Iterative: pages nest deeply."""
    found: dict[int, list[Node]] = {}
    content: dict[int, bytes] = {}
    holds: set[int] = set()
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if isinstance(c, Node) and c.tag not in RAW)
            continue
        parts, has = [f"<{node.tag} {node.named}>".encode()], False
        if node.tag in CONTENT or any(id(c) in holds for c in node.children):
            holds.add(id(node))
        for c in node.children:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    has = True
                    parts.append(text.encode("utf-8", "surrogatepass"))
            elif id(c) in content:
                parts.append(content[id(c)])
                has = True
        if has and node.tag != "#root":
            digest = hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()
            content[id(node)] = digest
            if node.tag in BLOCK and id(node) not in holds:
                found.setdefault(int.from_bytes(digest, "little", signed=True), []).append(node)
    return found


def _unwanted(node: Node, inside: bool) -> bool:
    if node.tag in DROPPED or "hidden" in node.marks:
        return True
    if inside and node.tag not in ("div", "section", "ul", "ol", "article", "span", "p", "table", "header"):
        return False
    if node.tag == "header":
        return not inside
    marks = node.marks
    return bool(marks - TITLES if inside else marks) and node.tag not in ("html", "body", "main", "article") or (node.tag == "article" and bool(node.marks & {"comment", "comments", "reply", "related", "teaser", "ad", "promo"}))


def _text_parts(node: Node, cut: set[int], inside: bool) -> list[str]:
    """Character data in order; blocks are set apart by a line end."""
    out: list[str] = []
    stack: list = [(node, inside)]
    while stack:
        item, within = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if id(item) in cut or (item is not node and _unwanted(item, within)):
            continue
        within = within or item.tag in ("article", "main")
        if item.tag in BLOCK:
            out.append("\n")
            stack.append(("\n", within))
        stack.extend((c, within) for c in reversed(item.children))
    return out


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the article: references decoded, white space and block ends as one space each; empty for null.

    The article is all main elements if there are any, else all outermost article elements that are no comment or
    teaser, else the body, each in the order of the page. A template that would take more than half of an article or
    main, or all text of a page, is content that recurs, and stays.
    """
    if not page:
        return ""
    root = parse(page)
    cut = set()
    if template:
        for h, nodes in subtree_hashes(root).items():
            if h in template:
                cut.update(map(id, nodes))
    articles, mains, stack = [], [], [(root, False)]
    while stack:
        node, within = stack.pop()
        if id(node) in cut or (node is not root and _unwanted(node, False)):
            continue
        if node.tag == "main":
            mains.append(node)
            continue
        if node.tag == "article" and not within:
            articles.append(node)
        stack.extend((c, within or node.tag == "article") for c in reversed(node.children) if isinstance(c, Node))
    read = lambda n, inside, cut: " ".join(html.unescape("".join(_text_parts(n, cut, inside))).split())

    def kept(n: Node) -> str:
        text = read(n, True, cut)
        whole = read(n, True, set()) if cut else text
        return whole if 2 * len(text) < len(whole) else text

    if articles or mains:
        text = " ".join(filter(None, map(kept, mains or articles)))
    else:
        text = read(root, False, cut)
    return text or (main_text(page) if cut else "")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, TOGETHER):
            part, counts = batch.slice(lo, TOGETHER), Counter()
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if page:
                    counts.update((host, h) for h in subtree_hashes(parse(page)))
            yield pa.record_batch([pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["host", "subtree", "n"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(lo, TOGETHER)
            texts = [main_text(page, frozenset(own or ())) for page, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _host() -> Column:
    """The host, hashed; null for none."""
    host = host_of(F.col("url"))
    return F.when(host != "", F.xxhash64(host))


def _once(named: DataFrame) -> DataFrame:
    """host, html of each page content of a host; only what recurs is shuffled."""
    keys = ["host", "h1", "h2"]
    twice = stored(named.groupBy(*keys).count().filter("count > 1").select(*keys))
    twice = F.broadcast(twice) if 3 * twice.count() <= BROADCAST_HASHES else twice
    again = named.join(twice, keys, "left_semi").dropDuplicates(keys)
    return named.join(twice, keys, "left_anti").unionByName(again).select("host", "html")


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host (hashed), template: hashes of the subtrees that recur on the host's pages; pages of equal html count once.

    So many pages can hold but so many subtrees each, so a template has at most the larger of 1 / least_share and
    sqrt(pages) / ROOTS times the elements of an average page.
    """
    named = pages.filter("html is not null").select(_host().alias("host"), "html").filter("host is not null")
    named = _once(named.select("host", F.xxhash64("html").alias("h1"), F.xxhash64(F.lit(1), "html").alias("h2"), "html"))
    sizes = named.groupBy("host").agg(F.count("*").alias("pages"))
    counts = named.mapInArrow(_counted, "host long, subtree long, n long").groupBy("host", "subtree").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") >= least_pages).join(sizes, "host").filter(F.col("n") >= F.least(least_share * F.col("pages"), ROOTS * F.sqrt("pages")))
    return often.groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Pages without a host have no template. Null and empty pages have an empty text. Repeated rows get equal answers
    and count once as pages of their host. Long pages are read whole, in linear time; other columns don't matter, and
    an empty table gives an empty result.
    """
    templates = stored(site_templates(pages))
    size = templates.agg(F.coalesce(F.sum(F.size("template") + 8), F.lit(0))).first()[0]
    templates = F.broadcast(templates) if size <= BROADCAST_HASHES else templates
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    rows = rows.join(templates, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "template")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
