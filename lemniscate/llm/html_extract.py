"""Main text of web pages by line-block distribution.

Markup is stripped into blocks (the lines of the method).  Elements that
never hold the article (menus, headers, footers, side bars, notices, adverts,
forms, scripts, styles, reader comments) are left out by tag, role, class and
id.  Every other block counts with the length of its text outside links, and
lengths are summed over a sliding window of lines.  The main text lies between
the point where these sums surge and the point where they dive.  Where the page
marks its article, they decide inside it: the bar is lower there, everything
between the first surge and the last dive is one region, and the region is
widened by all lines next to it whose text isn't mostly links, so that short
paragraphs and lists at its ends stay and link lists go.  Each further marked
article has its own surge and dive at a higher bar, that of unmarked pages where
its heading is a link; one whose sums never reach it is a teaser.

A class or id leaves an element out by its head word: ``cookie-bar`` and
``user-reviews`` go, ``notice-of-claims`` and ``movie-reviews`` stay.

Cases: a null html is an empty page; comments, script and unclosed elements
are read as browsers read them; repeated rows come back repeated; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from typing import Any

from pyspark.sql import DataFrame

#: Lines in the sliding window.
WINDOW = 3
#: The sums surge above, and dive below, this share of the page's largest sum.
SURGE = 0.2
#: The share inside a marked article, which is mostly text.
MARKED_SURGE = 0.05
#: The share in further marked articles.
FURTHER_SURGE = 0.1
#: A line counts at most so many characters towards that largest sum, so that one huge block doesn't raise the bar.
LINE = 300
#: Regions that this many lines or fewer part are one.
GAP = 6

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: A tag's end, or where a quoted value begins, which may hold ">".  As in browsers, other quotes are only characters.
_STOP = re.compile(r">|=[ \t\n\f\r]*+[\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Their content is text up to their own end tag.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(
    (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
)
_OUT = frozenset(
    (
    "head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "fieldset", "button", "select", "option", "input",
    "textarea", "label", "iframe", "svg", "canvas", "object", "embed", "audio", "video", "map", "dialog", "menu", "title", "xmp", "noembed", "noframes",
)
)
_OUT_ROLES = frozenset((
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist",
    "note", "status",
))
_OUT_NAMES = frozenset(
    (
    "ad", "ads", "adslot", "adunit", "adbanner", "adsense", "adbox", "banner", "sponsor", "sponsors", "sponsored", "promo", "promotion", "promotions",
    "sidebar", "sidebars", "menu", "menus", "nav", "navs", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "footers", "header", "headers",
    "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "commentlist", "discussion", "disqus", "respond", "replies",
    "related", "recommended", "recommendations", "widget", "widgets", "toolbar", "pagination", "pager", "copyright", "legal", "disclaimer", "search", "form",
    "skip", "hidden", "announcement", "reviews", "responses",
)
)
#: Words at a name's end that only say how or where its head word is shown.
_HOLDERS = frozenset(
    (
        "area", "articles", "bar", "block", "blocks", "body", "bottom", "box", "boxes", "btn", "button", "buttons", "card", "cards", "carousel", "col", "column",
        "container", "content", "desktop", "fixed", "grid", "group", "holder", "icon", "icons", "image", "inline", "inner", "item", "items", "large", "layout",
        "left", "link", "links", "list", "main", "media", "message", "mobile", "more", "news", "outer", "page", "panel", "posts", "primary", "results", "right",
        "row", "secondary", "section", "slot", "small", "stories", "sub", "text", "this", "title", "toggle", "top", "unit", "wrap", "wrapper", "zone",
    )
)
#: Words that name what readers write, and also what an article is about; whose they are tells.
_READERS = frozenset(("discussion", "replies", "respond", "responses", "reviews"))
_WHOSE = frozenset(("all", "community", "customer", "customers", "guest", "latest", "member", "post", "public", "reader", "readers", "recent", "user", "users", "visitor"))
#: The same wherever they stand in a name.
_OUT_STEMS = ("advert", "banner", "comment", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor", "topnav", "subnav", "sidenav")
#: Never left out by name: they hold the page or the article.
_KEPT = frozenset(("html", "body", "main", "article"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that hold other blocks as a page's parts; what stands in any other block lies in the part around it.
_PARTS = frozenset(("address", "article", "center", "div", "main", "section"))
#: An open p ends where one of these begins.
_ENDS_P = _BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "body", "html", "head", "caption"}


@dataclass
class _Block:
    pieces: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    article: int = 0
    heading: bool = False
    #: The innermost part of the page around the block, and the parts around that one; 0 is the page.
    part: int = 0


@dataclass
class _Open:
    tag: str
    out: bool
    article: bool
    inside_header: bool = False
    part: int = 0


class _Reader:
    """Tags and comments of a page, in order; every stretch of markup is read a bounded number of times.

    A comment or CDATA section without an end reaches to the page's end.  A
    tag whose quotes don't close is read up to its first ">"; without one,
    "<" is text.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        #: Up to here reading quotes has led nowhere.
        self.plain = 0

    def _end(self, at: int) -> tuple[bool, int]:
        """From inside a tag: whether its quotes close, and the place of its ">" or up to where none was found."""
        while m := _STOP.search(self.html, at):
            if m[0] == ">":
                return True, m.start()
            opened = m.end() - 1
            if opened >= self.last_quote[self.html[opened]]:
                return False, opened
            at = self.html.index(self.html[opened], opened + 1) + 1
        return False, len(self.html)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next one from ``at``: start, end, whether an end tag, name ("" for comments and the like), attributes."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            for opened, closed in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(opened, at):
                    end = html.find(closed, at + len(opened))
                    return at, len(html) if end < 0 else end + 3, False, "", ""
            if at < self.last:
                if html[at + 1] in "!?":
                    return at, html.index(">", at) + 1, False, "", ""
                m = _NAME.match(html, at)
                if m:
                    end = -1
                    if at >= self.plain:
                        closed, end = self._end(m.end())
                        if not closed:
                            self.plain, end = end, -1
                    if end < 0:
                        end = html.find(">", m.end())
                    if end >= 0:
                        return at, end + 1, html[at + 1] == "/", m[1].lower(), html[m.end() : end].strip()
            at += 1
        return None

    def stripped(self, at: int, end: int) -> str:
        """Text from ``at`` to ``end`` without markup."""
        out = []
        while at < end:
            found = self.next(at)
            out.append(self.html[at : min(found[0], end) if found else end])
            at = found[1] if found else end
        return "".join(out)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}


def _left_out(tag: str, raw: str) -> bool:
    if tag in _OUT:
        return True
    if not raw or tag in _KEPT:
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if a.get("role", "").lower() in _OUT_ROLES:
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = re.split(r"[-_:]+", name)
        if parts[0] in ("has", "no", "with", "is", "not"):
            continue
        if _listed(parts) or any(x in name for x in _OUT_STEMS):
            return True
    return False


def _listed(parts: list[str]) -> bool:
    """Whether the head word of a name is one that never holds the article."""
    parts = [x for x in parts if x]
    while len(parts) > 1 and (parts[-1] in _HOLDERS or parts[-1][0].isdigit()):
        parts.pop()
    if not parts:
        return False
    if parts[-1] in _READERS and len(parts) > 1:
        return not (_OUT_NAMES | _WHOSE).isdisjoint(parts[:-1])
    return parts[-1] in _OUT_NAMES


def _is_article(tag: str, raw: str) -> bool:
    if tag in ("article", "main"):
        return True
    if "main" not in raw and "articleBody" not in raw:
        return False
    a = _attributes(raw)
    return bool(re.match(r"main\b", a.get("role", "")) or re.match(r"articleBody\b", a.get("itemprop", "")))


def blocks(html: str, around: list[int] | None = None) -> list[_Block]:
    """The page's blocks in order, without what is left out.

    ``around``: gets, for every part of the page, the part around it.
    """
    around = [] if around is None else around
    around.append(0)
    out: list[_Block] = [_Block()]
    stack: list[_Open] = []
    hidden = linked = articles = headers = at = 0
    article_no = 0
    opened: Counter[str] = Counter()
    reader = _Reader(html)

    def text(s: str) -> None:
        if s and not hidden:
            (out[-1].links if linked else out[-1].pieces).append(s)
            if linked:
                out[-1].pieces.append(s)

    def cut(heading: bool = False) -> None:
        if out[-1].pieces:
            out.append(_Block())
        out[-1].article = article_no if articles else 0
        out[-1].heading = heading
        out[-1].part = stack[-1].part if stack else 0

    def close(k: int) -> None:
        nonlocal hidden, articles, headers
        while len(stack) > k:
            x = stack.pop()
            opened[x.tag] -= 1
            hidden -= x.out
            articles -= x.article
            headers -= x.inside_header

    n = len(html)
    while at < n:
        found = reader.next(at)
        if not found:
            text(html[at:])
            break
        start, after, end, tag, raw = found
        text(html[at:start])
        at = after
        if not tag:
            continue
        if end:
            if tag == "a":
                linked = 0
            if opened[tag]:
                while stack[-1].tag != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            if tag in _BLOCK:
                cut()
            continue
        if tag in _RAW:
            closing = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = closing.end() if closing else n
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "hr":
            cut()
        if tag in _VOID:
            continue
        if tag in _ENDS_P and stack and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in ("li", "option", "dd", "dt", "tr", "td", "th") and stack and stack[-1].tag == tag:
            close(len(stack) - 1)
        if tag == "a":
            linked = 1
        article = _is_article(tag, raw)
        # Inside an article a header holds its title: headings stay, the rest goes.
        titled = tag == "header" and bool(articles)
        shown = tag in _HEADINGS and headers > 0
        left = _left_out(tag, raw) and not titled
        if article and not articles and not hidden and not left:
            article_no += 1
        if tag in _BLOCK or left or article or titled:
            part = stack[-1].part if stack else 0
            if tag in _PARTS:
                around.append(part)
                part = len(around) - 1
            stack.append(_Open(tag, left or titled, article, titled, part))
            opened[tag] += 1
            hidden += left or titled
            articles += article
            headers += titled
        if shown and hidden == 1:
            stack.append(_Open(tag, False, False, part=stack[-1].part))
            opened[tag] += 1
            cut(True)
            piece = re.compile(rf"</{tag}\b", re.I).search(html, at)
            inner = piece.start() if piece else n
            out[-1].pieces.append(reader.stripped(at, inner))
            at = inner
        elif tag in _BLOCK:
            cut(tag in _HEADINGS)
    return out


def _sums(lengths: list[int]) -> list[int]:
    """Of every line the sum over the window that begins there."""
    n = len(lengths)
    sums, total = [0] * n, 0
    for i in range(n - 1, -1, -1):
        total += lengths[i] - (lengths[i + WINDOW] if i + WINDOW < n else 0)
        sums[i] = total
    return sums


def _outermost(used: set[int], around: list[int]) -> list[int]:
    """Of every part the outermost one around it, or itself, that is in ``used``; the page itself is around all of them and joins none."""
    top = [0] * len(around)
    for part in range(1, len(around)):
        top[part] = top[around[part]] or (part if part in used else 0)
    return top


def _highest(lengths: list[int]) -> int:
    """The largest window sum, huge lines cut."""
    return max(_sums([min(x, LINE) for x in lengths]), default=0)


def region(lengths: list[int], parts: list[int], around: list[int], surge: float = SURGE, highest: int | None = None) -> tuple[int, int]:
    """First line and last line + 1 of the largest region between surge and dive of the window sums.

    ``highest``: the page's largest window sum, if other lines have it.

    Regions are one where few lines part them, or where they have lines in
    the same of the ``parts`` or one within the other's.
    """
    n = len(lengths)
    sums = _sums(lengths)
    bar = surge * (_highest(lengths) if highest is None else highest)
    high = [i for i in range(n) if lengths[i] and sums[i] >= bar]
    top = _outermost({parts[i] for i in high}, around)
    last = {top[parts[i]]: i for i in high}
    found: list[tuple[int, int]] = []
    reach = -1
    for i in high:
        # What lies before the last high line of a part that is open belongs to the region.
        if found and (i <= reach or i - found[-1][1] <= GAP + 1):
            found[-1] = found[-1][0], i
        else:
            found.append((i, i))
        reach = max(reach, last[top[parts[i]]])
    if not found:
        return 0, 0
    held = [0]
    for x in lengths:
        held.append(held[-1] + x)
    first, end = max(found, key=lambda x: (held[x[1] + 1] - held[x[0]], -x[0]))
    end += 1
    # The dive: lines right after the last high sum that are still in its window.
    dive = end + WINDOW - 1
    while end < n and end < dive and lengths[end]:
        end += 1
    return first, end


def main_text(html: str | None) -> str:
    """The article's text: blocks joined by one space, white space inside them turned into one space."""
    found = []
    parts: list[int] = []
    around: list[int] = []
    for b in blocks(html or "", around):
        s = " ".join(unescape("".join(b.pieces)).split())
        if s:
            found.append((s, len(s) - len(" ".join(unescape("".join(b.links)).split())), b.article, b.heading))
            parts.append(b.part)
    if not found:
        return ""
    marked: dict[int, int] = {}
    for _, own, article, _ in found:
        if article:
            marked[article] = marked.get(article, 0) + own
    if marked:
        largest = max(marked, key=lambda k: (marked[k], -k))
        # Articles of links alone have no text outside them to go by.
        weigh = (lambda x: x[1]) if marked[largest] else (lambda x: len(x[0]))
        inside = {k: [x for x in found if x[2] == k] for k in marked}
        highest = max(_highest([weigh(x) for x in own]) for own in inside.values())
        kept: list[str] = []
        for k, own in inside.items():
            lengths = [weigh(x) for x in own]
            linked = any(x[3] and 2 * x[1] < len(x[0]) for x in own)
            surge = MARKED_SURGE if k == largest else SURGE if linked else FURTHER_SURGE
            first, end = region(lengths, [0] * len(own), [0], surge, highest)
            texts = [2 * n >= len(x[0]) for n, x in zip(lengths, own)]
            if first < end or k == largest:
                while first > 0 and texts[first - 1]:
                    first -= 1
                while end < len(own) and texts[end]:
                    end += 1
            kept.extend(x[0] for x in own[first:end])
        return " ".join(kept)
    first, end = region([own for _, own, _, _ in found], parts, around)
    while first > 0 and found[first - 1][3]:
        first -= 1
    return " ".join(x[0] for x in found[first:end])


def _extract(batches: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
