"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of tags. The ratio of a path is its text length outside links, over the
root of the number of its blocks, times one and the marks of punctuation in a block; ratios are smoothed over neighbouring blocks and fused: the
path's own, the smoothed one and a prior of its tags and class words. Paths whose fused score reaches ``SHARE`` of the page's best are content.
The content element is the smallest one around all their blocks, widened to the article or main element it is in. Its text
is that of the content paths and of all other blocks in it that nothing speaks against; a page's last heading of first order before the
element belongs to it if it has none of its own.

Priors are mild: a tag like nav, or a class that consists of such words, halves a score, and a word in a longer class takes less. Halves
break ties, but no more, on pages with text enough for ratios to tell; the less text there is (below ``FEW`` characters), the more
they count. Words do not count on headings and paragraphs. Readers' comments alone go by their name: no ratio tells their prose from an
article's. What is never shown is left out unread.

Defined cases: null, empty or unparsable html gives an empty text; pages of any length are read whole, in time that does not depend on
how deep elements nest; white space, also no-break spaces and line breaks (``<br>``), becomes one space; an unclosed element ends with
its parent; equal blocks are all kept, in page order; repeated rows each give a row; an empty table gives no rows; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import bounded_batches, slices

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--|!\[CDATA\[|[!?]))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>""")
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|$)|[。，、；：！？]")
_RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are never shown as text, and elements that speak against content.
NEVER = {"head", "button", "select", "option", "template", "svg", "math", "canvas", "audio", "video", "object", "map"} | _RAW
AGAINST = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "label", "header"}
#: Words of classes, ids and roles: of readers' comments, of what is not content, and of what may be its subject.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies"}
NAMED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar",
    "complementary", "footer", "contentinfo", "masthead", "cookie", "cookies", "consent", "gdpr", "paywall", "newsletter", "subscribe", "signup", "popup", "modal", "share", "sharing", "social", "login",
    "skip", "pagination", "pager", "toolbar", "widget",
}
AMBIGUOUS = {
    "banner", "notice", "notices", "notification", "alert", "disclaimer", "promotion", "subscription", "overlay", "related", "recommended", "recommendations", "search", "discussion", "responses", "respond",
}
#: A class that begins so tells what is beside or inside an element, not what it is.
_BESIDE = {"has", "with", "without", "no", "is"}
#: Words that say where or how something stands; with one of ``NAMED`` they make a class that says what it is.
PLACES = {"main", "site", "page", "top", "bottom", "left", "right", "inner", "outer", "box", "wrapper", "wrap", "container", "area", "section", "block", "list", "item", "bar", "link", "links", "text", "global", "primary", "secondary"}
#: What remains of a score below elements that are commented, that something speaks against, or may speak against.
_COMMENTED, _UNLIKELY, _DOUBTFUL = 0.005, 0.5, 0.7
#: Characters of text on a page below which priors count for more than once.
FEW = 2000
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = {"html", "body", "table", "td", "th", "article", "section", "div", "main", "ul", "ol", "dl", "blockquote", "aside", "nav", "header", "footer", "form"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LEAVES = _HEADINGS | {"p", "li", "dt", "dd", "pre", "td", "th", "tr", "figcaption", "caption", "summary", "address"}
#: Blocks on each side over which ratios are smoothed, their weights by distance, the smoothed ratio's part in the fused one, the
#: share of the best score that a content path reaches, and the share that is enough inside the content element for what may be content.
SPAN = 2
_WEIGHTS = (0.4, 0.24, 0.06)
SMOOTH = 0.3
SHARE, SHARE_INSIDE = 0.5, 0.25
LINKED = 0.5


class Element:
    """``start`` and ``end`` are the numbers of the page's blocks before it was opened and closed: its own lie between them."""

    __slots__ = ("tag", "parent", "path", "prior", "never", "linked", "article", "around", "start", "end")

    def __init__(self, tag: str, parent: Element | None, path: int, prior: float, never: bool, start: int) -> None:
        self.tag, self.parent, self.path, self.prior, self.never, self.start, self.end = tag, parent, path, prior, never, start, 1 << 60
        self.linked = tag == "a" or parent is not None and parent.linked
        self.article = tag in ("article", "main") or parent is not None and parent.article
        # the nearest element that makes blocks
        self.around = parent.around if tag in _INLINE and parent is not None else self


class Block:
    __slots__ = ("element", "parts", "linked")

    def __init__(self, element: Element) -> None:
        self.element, self.parts, self.linked = element, [], 0


def judged(tag: str, attributes: str, parent: Element) -> tuple[float, bool]:
    """What remains of a score below an element, and whether it is never shown."""
    if tag in NEVER:
        return 0.0, True
    prior = _UNLIKELY if tag in AGAINST and not (tag == "header" and parent.article) else 1.0
    if not attributes:
        return prior, False
    bare = tag in _HEADINGS or tag in ("html", "body", "article", "main", "p") or tag in _INLINE - {"span", "a"}
    for name, *values in _NAMES.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 0.0, True
        if name in ("class", "id", "role") and not bare:
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if not parts or parts[0] in _BESIDE:
                    continue
                if not COMMENTS.isdisjoint(parts):
                    prior = min(prior, _COMMENTED)
                elif not NAMED.isdisjoint(parts) and NAMED | AMBIGUOUS | PLACES >= set(parts) or parts[0] == "header" and not parent.article:
                    prior = min(prior, _UNLIKELY)
                elif not (NAMED | AMBIGUOUS).isdisjoint(parts):
                    prior = min(prior, _DOUBTFUL)
    return prior, False


class Scanner:
    """The markup of a page, found in time linear in its length: what has no end is looked for once."""

    def __init__(self, html: str) -> None:
        self.html, self.last = html, html.rfind(">")
        #: whether a > in quotes does not end a tag: until a tag has no end that way
        self.quotes = True

    def next(self, at: int) -> tuple[int, int, str, str, str, str] | None:
        """(start, end, "/" of an end tag, name, attributes, text of a CDATA section) of the first markup from ``at`` on. A tag
        without end is text; a comment or section without end goes to the end of the page."""
        html = self.html
        while m := _OPEN.search(html, at):
            start, at = m.span()
            if m[3] in ("!--", "![CDATA["):
                mark = "-->" if m[3] == "!--" else "]]>"
                found = html.find(mark, at)
                end = found + 3 if found >= 0 else len(html)
                return start, end, "", "", "", html[at : found if found >= 0 else end] if mark == "]]>" else ""
            if start > self.last:
                continue
            if m[3]:
                return start, html.index(">", at) + 1, "", "", "", ""
            rest = _REST.match(html, at) if self.quotes else None
            if rest is None:
                self.quotes = False
            end = rest.end() if rest else html.index(">", at) + 1
            return start, end, m[1], m[2].lower(), html[at : end - 1], ""
        return None

    def after(self, tag: str, at: int) -> int:
        """Where the end tag of an element begins whose content is not markup, or the end of the page."""
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.html, at)
        return found.start() if found else len(self.html)


def blocks(html: str) -> tuple[Element, list[Block]]:
    """The root and the blocks of text of a page in page order, without those that are never shown."""
    root = Element("", None, 0, 1.0, False, 0)
    stack, found, open_block, at = [root], [], None, 0
    paths: dict[tuple[int, str, float], int] = {}
    # where in the stack the open elements of each tag are, and those that end the search for a paragraph or item to close
    places: dict[str, list[int]] = defaultdict(list)
    scopes = [0]

    def close(upto: int) -> None:
        for element in stack[upto:]:
            element.end = len(found)
            places[element.tag].pop()
            if element.tag in _SCOPE:
                scopes.pop()
        del stack[upto:]

    def text(raw: str) -> None:
        nonlocal open_block
        here = stack[-1]
        if here.never or not raw or open_block is None and raw.isspace():
            return
        if open_block is None:
            open_block = Block(here.around)
            found.append(open_block)
        raw = unescape(raw) if "&" in raw else raw
        open_block.parts.append(raw)
        if here.linked:
            open_block.linked += len(raw)

    scanner = Scanner(html)
    while markup := scanner.next(at):
        start, end, closing, tag, attributes, section = markup
        text(html[at:start])
        at = end
        if not tag:
            text(section)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in _INLINE:
            open_block = None
        if closing:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P or tag in _SAME:
            ends = max((places[t][-1] for t in _SAME.get(tag, ("p",)) if places[t]), default=0)
            if ends > scopes[-1]:
                close(ends)
        parent = stack[-1]
        prior, never = judged(tag, attributes, parent)
        prior = min(prior, parent.prior)
        path = parent.path if tag in _INLINE and prior == parent.prior else paths.setdefault((parent.path, tag, prior), len(paths) + 1)
        places[tag].append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(Element(tag, parent, path, prior, never or parent.never, len(found)))
        if tag in _RAW and not attributes.rstrip().endswith("/"):
            at = scanner.after(tag, at)
    text(html[at:])
    close(1)
    root.end = len(found)
    return root, found


def path_scores(found: list[Block], texts: list[str]) -> dict[int, float]:
    """The fused score of each path: its ratio, that of its blocks' neighbourhoods, and its prior."""
    total: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0])
    for block, text in zip(found, texts):
        sums = total[block.element.path]
        sums[0] += max(0, len(text) - block.linked)
        sums[1] += len(_PUNCTUATION.findall(text))
        sums[2] += 1
    ratio = {path: length / n**0.5 * (1 + marks / n) for path, (length, marks, n) in total.items()}
    # halves count once, or more on pages of little text
    more = max(1.0, FEW / max(1, sum(length for length, _, _ in total.values())))
    row = [ratio[b.element.path] for b in found]
    smooth: dict[int, float] = defaultdict(float)
    prior = {}
    for i, block in enumerate(found):
        near = [(row[j], _WEIGHTS[abs(i - j)]) for j in range(max(0, i - SPAN), min(len(row), i + SPAN + 1))]
        smooth[block.element.path] += sum(r * w for r, w in near) / sum(w for _, w in near)
        own = block.element.prior
        prior[block.element.path] = own if own > _UNLIKELY else own**more
    return {path: ratio[path] ** (1 - SMOOTH) * (smooth[path] / total[path][2]) ** SMOOTH * prior[path] for path in ratio}


def _content_element(root: Element, found: list[Block], content: list[int]) -> Element:
    """The smallest element around all content blocks, or the article or main element that it is in."""
    if not content:
        return root
    here = found[content[0]].element
    if here.tag in _LEAVES and here.parent is not None:
        here = here.parent.around
    while here.parent is not None and not (here.start <= content[0] and content[-1] < here.end):
        here = here.parent.around
    widest = here
    while here is not None:
        if here.tag in ("article", "main"):
            widest = here
        here = here.parent
    return widest


def main_text(html: str | None) -> str:
    """The text of the content element's blocks, joined by two line ends."""
    root, found = blocks(html or "")
    texts = [" ".join("".join(b.parts).split()) for b in found]
    scores = path_scores(found, texts)
    best = max((scores[b.element.path] for b, t in zip(found, texts) if t), default=0.0)

    def reaches(i: int, share: float) -> bool:
        return bool(texts[i]) and scores[found[i].element.path] >= max(share * best, 1e-9)

    reached = [reaches(i, SHARE) for i in range(len(found))]
    content = [i for i, r in enumerate(reached) if r]
    element = _content_element(root, found, content)
    first, last = element.start, min(element.end, len(found))
    chosen = []
    told = element.tag in ("article", "main")
    for i in range(first, last):
        block, text = found[i], texts[i]
        prior = block.element.prior
        # links alone are content where the page itself says that all is
        plain = prior >= element.prior and (told or block.linked <= LINKED * len(text) or block.element.tag in _HEADINGS | {"p"})
        if text and (reached[i] or plain or prior > _UNLIKELY and reaches(i, SHARE_INSIDE)) and prior > _COMMENTED:
            chosen.append(i)
    if chosen and not any(found[i].element.tag == "h1" for i in chosen):
        chosen[:0] = next(([i] for i in range(first - 1, -1, -1) if texts[i] and found[i].element.tag == "h1" and found[i].element.prior >= element.prior), [])
    return "\n\n".join(texts[i] for i in chosen)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), "html")
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
