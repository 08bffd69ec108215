"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a line is the text of one block, and the start and end of every container (div, section, list, table
and the like) leaves an empty line, as tags on lines of their own do. The weight of a line is the length of its text outside
links, so a menu weighs nothing; in a menu element what is no link counts a tenth. The weights of `window` lines at a time are
summed along the page: a region surges where the sum leaves zero and dives where it falls back to zero. It is kept if some sum
in it reaches `least` (or the page's largest sum, where none does), and so are the regions between kept ones. A line in an
article or main element weighs `least` more, and a region outside counts beside such ones only if it weighs more than all of them.

What HTML or the page itself marks as no text (scripts, styles, head, hidden parts, controls) or as standing beside the article
(footer, aside, form; header unless in an article; class, id, role or label naming a notice, advert, comments, sidebar and so on
by their head word) is left out, and leaves empty lines. On a page without text in an article, such a part that holds an article,
or most of the page's text, is none, unless it is named as comments, adverts or a cookie notice.

Cases: null or empty html, or a page without text, gives an empty text; unclosed tags, comments and quotes end with the page; a
page is never cut or capped, and work is linear in its length; repeated rows give repeated results; columns beside page_id, url
and html are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import by_batch, prepare, spread

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_RAW_END: dict[str, re.Pattern] = {}

#: Fixed values of HTML: elements without content, with raw text, within a line of text, and blocks that are one line each.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
LINE = {"address", "blockquote", "caption", "dd", "details", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "legend", "li", "p", "pre", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that are no text or stand beside the article whatever they hold, and those that do unless they hold it.
NEVER = {"head", "footer", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "map", "datalist"}
BOILERPLATE = {"header", "aside", "form"}
MENU = {"nav", "menu"}
#: Words in class, id, role or label that name a part beside the article.
BESIDE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies",
    "complementary", "dialog", "discussion", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "paywall", "popup", "promo", "promoted",
    "promotion", "related", "remark", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "widget", "alert",
}
#: Those of them that no article's wrapper has.
STRICT = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "comment", "comments", "commentlist", "cookie", "cookies", "discussion", "disqus", "gdpr", "replies", "reply", "respond"}
#: Words that can follow or precede those in a name, and words that turn it into a description of something else.
PLAIN = {
    "area", "author", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "control", "controls", "date", "fixed", "form", "global", "group", "inner", "item", "items", "left", "link",
    "links", "list", "main", "meta", "mobile", "outer", "overlay", "page", "panel", "primary", "right", "secondary", "section", "site", "slot", "sticky", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
DESCRIBES = {"has", "with", "no", "without", "not", "is", "hide", "show", "enable", "enabled", "disable", "disabled", "open", "closed"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}


def _names(value: str) -> int:
    """1 if a class or id names a part beside the article, 2 if by a strict word: by its last word, or by any among plain ones."""
    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if x]
    if not parts or not DESCRIBES.isdisjoint(parts):
        return 0
    if parts[-1] in BESIDE or not BESIDE.isdisjoint(parts) and all(x in BESIDE or x in PLAIN for x in parts):
        return 1 if STRICT.isdisjoint(parts) else 2
    return 0


def _kind(name: str, attributes: str, within: bool) -> tuple[int, bool]:
    """0 for text, 1 for a part beside the article by its name, 2 for one that is no text whatever it holds; and whether it is an article."""
    if name in NEVER:
        return 2, False
    found, article = int(name in BOILERPLATE and not (name == "header" and within)), name in ("article", "main")
    if name in ("body", "html") or "=" not in attributes and "hidden" not in attributes.lower():
        return found, article
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "style" and _NONE.search(value) or key == "aria-hidden" and value.lower() == "true":
            return 2, False
        if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value == "articleBody":
            article = True
        elif name != "main" and key in ("class", "id", "role"):
            found = max([found, *(_names(x) for x in value.split() if not (within and x.lower().endswith("header")))])
        elif name != "main" and key == "aria-label":
            found = max(found, _names(value))
    return found, article and not found


class Line:
    """A line of text: its weight, and whether it is in an article or main element. Without text it is empty."""

    __slots__ = ("text", "weight", "inside")

    def __init__(self, text: str, weight: float, inside: bool):
        self.text, self.weight, self.inside = text, weight, inside


def lines(html: str) -> list[Line]:
    """The lines of the page in order."""
    out, parts, size = _lines(html, frozenset())
    if any(x.inside and x.text for x in out):
        return out
    holding = frozenset(at for at, (chars, article) in parts.items() if article or 2 * chars > size)
    return _lines(html, holding)[0] if holding else out


def _lines(html: str, holding: frozenset[int]) -> tuple[list[Line], dict[int, tuple[int, bool]], int]:
    """The lines; the characters of each part beside by its name, by its place, and whether it holds an article; all characters.

    Parts at the places in holding are taken as parts of the article.
    """
    out: list[Line] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, beside, article, menu of the open blocks, and of parts within lines that are beside
    count: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []  # text and whether it is a link's
    parts: dict[int, tuple[int, bool]] = {}
    named: list[tuple[int, int, int, int]] = []  # open parts beside by their name: depth, place, characters and articles before
    shut: list[int] = []  # depths of the open parts that are no text
    blocks: list[int] = []  # depths of the open blocks
    at = beside = inside = menu = size = articles = 0
    link = False

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(t for t, _ in held)).split())
            if text:
                own = len(text) if not any(x for _, x in held) else sum(len(" ".join(unescape(t).split())) for t, x in held if not x)
                out.append(Line(text, own / 10 if menu else own, inside > 0))
            held.clear()

    def empty() -> None:
        out.append(Line("", 0, inside > 0))

    def pop() -> None:
        nonlocal beside, inside, menu
        if open_[-1][0] not in INLINE:
            flush()
        name, b, a, m = open_.pop()
        count[name] -= 1
        if blocks and blocks[-1] == len(open_):
            blocks.pop()
        if shut and shut[-1] == len(open_):
            shut.pop()
        if named and named[-1][0] == len(open_):
            _, place, chars, seen = named.pop()
            parts[place] = (size - chars, articles > seen)
        beside -= b
        inside -= a
        menu -= m
        if name not in INLINE and (name not in LINE or b and not beside):
            empty()

    while at < len(html):
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and not shut and not link:
            size += len(" ".join(text.split()))
        if text and not beside:
            held.append((text, link))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            flush()
            link = False
        elif name == "br" and not beside:
            held.append((" ", link))
        if name == "a":
            link = not m[1] and "href" in m[3].lower()
        if m[1]:
            if count[name]:
                while open_[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            end = _RAW_END.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or m[3].endswith("/") and name not in INLINE:
            continue
        kind, article = _kind(name, m[3], inside > 0)
        if name in INLINE and not kind:
            continue
        closes = _CLOSES.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
        if blocks and open_[blocks[-1]][0] in closes:  # an open paragraph or item ends where the next begins, with what is open in it
            k = blocks[-1]
            while len(open_) > k:
                pop()
        b = kind == 2 or kind == 1 and m.start() not in holding
        a = article and not b
        if kind == 2:
            shut.append(len(open_))
        elif b and not shut:
            named.append((len(open_), m.start(), size, articles))
        articles += a and not shut
        if name not in INLINE and (name not in LINE or b and not beside):
            empty()
        if name not in INLINE:
            blocks.append(len(open_))
        open_.append((name, b, a, name in MENU))
        count[name] += 1
        beside += b
        inside += a
        menu += name in MENU
    flush()
    while open_:
        pop()
    return out, parts, size


def regions(weights: list[float], window: int) -> list[tuple[int, int, float]]:
    """Spans [first, last) of lines from each surge of the windows' sums to the dive that follows, and the largest sum in each."""
    out: list[tuple[int, int, float]] = []
    total: float = sum(weights[:window])
    start, most = None, 0.0
    for i in range(len(weights)):
        if total > 0:
            if start is None:
                start, most = i, 0.0
            most = max(most, total)
        elif start is not None:
            out.append((start, i, most))
            start = None
        total = sum(weights[i + 1 : i + 1 + window])
    if start is not None:
        out.append((start, len(weights), most))
    return out


def kept_lines(own: list[Line], window: int, least: float) -> list[str]:
    """The texts of the lines in the regions that stay."""
    found = regions([x.weight + least * (x.inside and bool(x.text)) for x in own], window)
    if not found:
        return []
    article = sum(x.weight for x in own if x.inside)
    bar = min(least, max(most for _, _, most in found))

    def stays(first: int, last: int, most: float) -> bool:
        part = own[first:last]
        return any(x.inside and x.text for x in part) or most >= bar and (not within or sum(x.weight for x in part) > article)

    within = any(x.inside and x.text for x in own)
    staying = [i for i, region in enumerate(found) if stays(*region)]
    if not within:  # what lies between two parts of the text belongs to it
        staying = list(range(staying[0], staying[-1] + 1))
    return [x.text for i in staying for x in own[found[i][0] : found[i][1]] if x.text]


def main_text(html: str | None, window: int = 2, least: int = 80) -> str:
    return "\n\n".join(kept_lines(lines(html), window, least)) if html else ""


def extract(pages: DataFrame, window: int = 2, least: int = 80) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py(), window, least) for h in batch.column(2)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(wanted).mapInArrow(by_batch(each), "page_id long, url string, text string, n_chars long")
