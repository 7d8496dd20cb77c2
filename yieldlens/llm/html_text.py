"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one a block element, and every line gets a weight: its characters, or nothing
in containers that are never article text (scripts, styles, forms, menus, headers, footers, asides, and elements
whose class, id or role names an advert, notice, menu, sidebar or comment), in lines
that are mostly link text and, in a page that marks its article (``article`` or ``main``), outside it. Lines of the article
weigh ``BOOST`` times their characters: those in the marked element or, in other pages, in the element that holds the
strongest stretch. A container that wraps the article or the page's text is no boilerplate, whatever its tag and names: see
``_wrappers``. The weights are summed over
sliding windows of ``WINDOW`` lines; a surge is a weighted line at which the sums reach the
threshold ``SURGE``, a dive the line after which they fall to nothing. The text is that of the weighted lines from each
surge to its dive.

The page is scanned once, forwards, and elements know their parents only, so the time follows the page's length
whatever its nesting and however broken its markup.

Edge cases: a null or empty html gives an empty text; unclosed and stray tags, comments
and scripts without an end are read as browsers do; character references are decoded
once; a null page_id or url is carried; repeated rows are kept; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

WINDOW = 3               # lines whose weights are summed
SURGE = 80               # least window sum of a surge, in characters
BOOST = 80               # weight of a character in the article
LINKED = 0.6             # share of link text from which a line is a menu

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile("[\"'>]")
_RAW = {t: re.compile(rf"</{t}\s*>|$", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template",
                                                       "iframe", "svg", "math", "xmp", "noembed", "noframes")}
_SKIP = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "object", "canvas",
         "audio", "video", "figcaption", "fieldset", "label", "datalist", "map"}
_HIDDEN, _PART, _TALK, _FRAME = 4, 3, 2, 1    # how surely a container is boilerplate
_KINDS = {**dict.fromkeys(_SKIP, _HIDDEN), **dict.fromkeys(("nav", "header", "footer", "aside", "menu", "figcaption"), _PART),
          **dict.fromkeys(("form", "fieldset", "label", "object", "dialog"), _FRAME)}
_MARKED = {"article", "main"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
          "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# elements that hold an article's paragraphs, in pages that mark none
_HOLDERS = {"article", "body", "center", "div", "html", "main", "section", "td"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# what an element of these kinds closes when it opens
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_BOILER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|"
                     r"alert|popup|modal|overlay|sidebar|side-bar|widget|menu|navbar|nav|navigation|breadcrumbs?|"
                     r"footer|header|masthead|topbar|toolbar|comments?|disqus|replies|respond|related|recommend\w*|"
                     r"share|sharing|social|subscribe|newsletter|signup|login|pagination|pager|skip-link|"
                     r"copyright|legal|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
# of those, names of text that is no article, where the others may also name a page's layout
_TALKS = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|footer|"
                    r"comments?|disqus|replies|respond|related|recommend\w*|share|sharing|social|subscribe|newsletter|"
                    r"copyright|legal|contentinfo)(?:$|[_-])", re.I)
# names that say which boxes a layout has
_LAYOUT = re.compile(r"(?:has|no|not|with|without|layout)[_-].*|(?:content|main|page)[_-].*[_-](?:wrap|wrapper|container|layout)",
                     re.I)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _boilerplate(tag: str, attributes: str) -> int:
    """How surely the element is boilerplate, 0 if it is none."""
    kind = _KINDS.get(tag, 0)
    if not attributes or kind == _HIDDEN or tag in ("html", "body", "article", "main"):
        return kind
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _HIDDEN
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return _HIDDEN
        if name in ("class", "id", "role") and _BOILER.search(value):
            for token in value.split():
                if _BOILER.search(token) and not _LAYOUT.fullmatch(token):
                    kind = max(kind, _TALK if _TALKS.search(token) else _FRAME)
    return kind


class Element:
    """An open element that matters: boilerplate, a marked article or a holder of paragraphs."""
    __slots__ = ("up", "kind", "marks", "holds", "marked", "kinds")

    def __init__(self, up: Element | None, kind: int, marks: bool, holds: bool):
        self.up, self.kind, self.marks, self.holds = up, kind, marks, holds
        self.marked = self if marks else up.marked if up else None          # innermost article element
        self.kinds = max(kind, up.kinds if up else 0)                       # surest boilerplate around


class Line:
    __slots__ = ("text", "weight", "at", "marked", "menu", "plain")

    def __init__(self, text: str, at: Element | None, linked: int):
        self.text, self.at, self.weight = text, at, 0
        self.marked = at.marked if at else None
        self.menu = linked >= LINKED * len(text)
        self.plain = max(0, len(text) - linked)              # characters outside links


class Page:
    """The lines of a page and its elements, parents before children."""

    def __init__(self):
        self.lines: list[Line] = []
        self.elements: list[Element] = []

    def sums(self, amounts: list[tuple[Element | None, int]]) -> dict[Element, int]:
        """For each element the amounts in it and the elements below."""
        total = dict.fromkeys(self.elements, 0)
        for at, n in amounts:
            if at:
                total[at] += n
        for x in reversed(self.elements):
            if x.up:
                total[x.up] += total[x]
        return total

    def weigh(self, wrappers: set[Element]) -> None:
        dull: dict[Element | None, bool] = {None: False}
        for x in self.elements:
            dull[x] = dull[x.up] or (x.kind > 0 and x not in wrappers)
        for line in self.lines:
            line.weight = 0 if dull[line.at] or (line.menu and not line.marked) else len(line.text)


def _most(page: Page, found: list[Line], articles: bool) -> set[Element]:
    """The boxes, or the boxes around articles, with more than half of the unlinked text of ``found``."""
    total = sum(x.plain for x in found)
    held = page.sums([((x.marked.up if x.marked else None) if articles else x.at, x.plain) for x in found])
    return {box for box, n in held.items() if box.kind and n and 2 * n > total}


def _wrappers(page: Page) -> set[Element]:
    """Boilerplate containers that wrap the page's text. A form or a box named after a part of the layout is
    one if it holds most of the unlinked text, or of that in articles; if that leaves the page without text,
    so is any box around an article, or else a named one with most of the text. Hidden boxes never are."""
    def upto(kind: int) -> list[Line]:
        return [x for x in page.lines if (x.at.kinds if x.at else 0) <= kind]

    def around(kind: int) -> set[Element]:
        held = page.sums([(x.marked.up, 1) for x in upto(kind) if x.marked])
        return {box for box, n in held.items() if box.kind and n}

    wrappers: set[Element] = set()
    if any(x.kind == _FRAME for x in page.elements):
        frames = upto(_FRAME)
        wrappers = _most(page, frames, False) | _most(page, [x for x in frames if x.marked], True)
    for more in (lambda: around(_FRAME), lambda: around(_PART), lambda: _most(page, upto(_TALK), False)):
        page.weigh(wrappers)
        if any(x.weight for x in page.lines):
            break
        wrappers |= more()
    return wrappers


def _tags(page: str):
    """(text before, kind, name, attributes, place after) of each tag: kind '' start, '/' end, '!' none; at last the
    rest as text. Every search starts behind the last, and one that found nothing is not made again."""
    at, start = 0, 0                                         # start: of the text not yet given
    quotes = True
    missing: set[str] = set()

    def find(mark: str, place: int) -> int:
        if mark in missing:
            return -1
        k = page.find(mark, place)
        if k < 0:
            missing.add(mark)
        return k

    while (at := page.find("<", at)) >= 0:
        sign = page[at + 1:at + 2]
        if sign in ("!", "?"):
            if page.startswith("<!--", at):
                end = find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                data = ""
            else:
                end = find("]]>", at + 9) if page.startswith("<![CDATA[", at) else -1
                data = page[at + 9:end] if end >= 0 else ""
                end = end + 3 if end >= 0 else find(">", at + 2) + 1
            if not end:
                at += 1
                continue
            step = yield page[start:at] + data.replace("&", "&amp;"), "!", "", "", end
        else:
            name = _NAME.match(page, at + 1 + (sign == "/"))
            if not name:
                at += 1
                continue
            end = name.end()
            while quotes:                                    # the first > outside quotes
                m = _QUOTE.search(page, end) if ">" not in missing else None
                if m and m[0] == ">":
                    end = m.start()
                    break
                end = find(m[0], m.end()) + 1 if m else 0
                if not end:
                    quotes = False                           # they do not pair off: from here on they are plain characters
            if not quotes:
                end = find(">", name.end())
            if end < 0:
                at += 1
                continue
            step = yield page[start:at], "/" if sign == "/" else "", name[0].lower(), page[name.end():end], end + 1
            end += 1
        at = start = end if step is None else step
    yield page[start:], "!", "", "", len(page)


def read_page(page: str) -> Page:
    """The page's lines of text, weighted by the characters that may be article text."""
    out = Page()
    parts: list[str] = []
    open_tags: list[tuple] = []          # tag, whether it splits lines at its end, element around, tags so far of _SKIP and that split
    places: dict[str, list[int]] = {}    # where each tag is open
    linked = 0

    def around() -> Element | None:
        return open_tags[-1][2] if open_tags else None

    def so_far(k: int, what: int) -> int:
        return open_tags[k][what] if k >= 0 else 0

    def cut(k: int) -> None:
        while len(open_tags) > k:
            places[open_tags.pop()[0]].pop()

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.lines.append(Line(text, around(), linked))
        linked = 0

    tags, after = _tags(page), None
    while True:
        try:
            text, kind, tag, attributes, place = tags.send(after)
        except StopIteration:
            break
        after = None
        if text:
            parts.append(text)
            if places.get("a"):
                linked += len(text.strip())
        if kind == "!":
            continue
        if kind:                                             # an end tag closes down to its start, if there is one
            if tag in _BLOCK:
                end()
            top = len(open_tags) - 1
            k = places[tag][-1] if places.get(tag) else None
            if k is not None and (tag in _BLOCK or so_far(top, 3) == so_far(k, 3)):
                if so_far(top, 4) > so_far(k - 1, 4):
                    end()
                cut(k)
            continue
        if tag in _RAW:
            after = _RAW[tag].search(page, place).end()
            continue
        dull = _boilerplate(tag, attributes)
        if tag in _BLOCK or dull:
            end()
        while open_tags and open_tags[-1][0] in _CLOSES.get(tag, ()):
            cut(len(open_tags) - 1)
        if tag in _BLOCK and open_tags and open_tags[-1][0] == "p":
            cut(len(open_tags) - 1)
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            marks, holds, up, top = tag in _MARKED, tag in _HOLDERS, around(), len(open_tags) - 1
            if dull or marks or holds:
                up = Element(up, dull, marks, holds)
                out.elements.append(up)
            places.setdefault(tag, []).append(len(open_tags))
            open_tags.append((tag, bool(dull or marks), up, so_far(top, 3) + (tag in _SKIP),
                              so_far(top, 4) + bool(dull or marks)))
    end()
    out.weigh(_wrappers(out))
    return out


def stretches(weights: list[int], window: int = WINDOW, surge: int = 1) -> list[tuple[int, int]]:
    """(first, last) line of each stretch from a surge to its dive."""
    sums = [sum(weights[k:k + window]) for k in range(len(weights))]
    found, start = [], None
    for k, weight in enumerate(weights):
        if start is None and weight and sums[k] >= surge:
            start = k
        if start is not None and weight == 0 and sums[k] == 0:
            found.append((start, k - 1))
            start = None
    if start is not None:
        found.append((start, len(weights) - 1))
    return found


def _holder(page: Page, lo: int, hi: int) -> Element | None:
    """The innermost element around the weighted lines from ``lo`` to ``hi``; around a line that has
    an element of its own, the next one out."""
    lines = [x for x in page.lines[lo:hi + 1] if x.weight]
    held = page.sums([(x.at, 1) for x in lines])

    def out(x: Element | None) -> Element | None:
        while x and not (x.holds and held[x] == len(lines)):
            x = x.up
        return x

    holder = out(lines[0].at)
    if len(lines) == 1 and holder and page.sums([(x.at, 1) for x in page.lines])[holder] == 1:
        holder = out(holder.up)
    return holder


def _article_weights(page: Page) -> list[int]:
    """The weights that the windows sum: those of the article's lines boosted."""
    weights = [x.weight for x in page.lines]
    if any(x.marked and x.weight for x in page.lines):
        return [BOOST * w if x.marked else 0 for x, w in zip(page.lines, weights)]
    runs = stretches(weights, surge=1)
    if not runs:
        return weights
    lo, hi = max(runs, key=lambda r: (sum(weights[r[0]:r[1] + 1]), -r[0]))
    holder = _holder(page, lo, hi)
    inside: dict[Element | None, bool] = {None: False}
    for x in page.elements:
        inside[x] = inside[x.up] or x is holder
    return [BOOST * w if lo <= k <= hi or holder is None or inside[x.at] else w
            for k, (x, w) in enumerate(zip(page.lines, weights))]


def main_text(html: str | None, surge: int = SURGE) -> str:
    page = read_page(html or "")
    weights = _article_weights(page)
    return " ".join(page.lines[k].text for lo, hi in stretches(weights, surge=surge) for k in range(lo, hi + 1) if weights[k])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                                  F.col("html").cast("string")), run,
                     "page_id long, url string, text string, n_chars long")
