"""Main text of web pages by two-pass block rules.

The markup is split into blocks of text. The first pass classifies each block by
itself: by its link density, stop-word density and length, inside an article
element as well as outside. The second pass gives the short and undecided blocks
the label of their nearest decided neighbours; an article element is context for
it: its borders count as good text, and furniture in it as nothing. Pages are handled whole, in the task that scans
them; no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# fixed values: frequent function words of the languages served
STOP_WORDS = frozenset((
    "the of and to in is it that for on with as at by from this be are was or an not have had but they which you "
    "le la les de des du et un une est que qui dans pour par sur pas plus avec au ce se il elle en "
    "der die das und ist von den zu mit sich auf für im dem nicht ein eine auch als an werden aus er sie "
    "el los las y del al con por su es una para como más o se lo no"
).split())

# fixed values: elements whose content is never text of the page; only the first two go on to
# the page's end where they are not closed
_RAW = ("script", "style")
_OPAQUE = (*_RAW, "noscript", "template", "iframe", "object", "svg", "head", "canvas", "annotation", "annotation-xml")
# fixed values: elements that hold page furniture
_FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "dialog", "menu", "label",
              "fieldset", "datalist"}
# fixed values: class, id and role words of page furniture
_FURNITURE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "reply",
    "replies", "responses", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe",
    "subscription", "popup", "modal", "dialog", "overlay", "widget", "widgets", "login", "signup", "search",
    "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "contentinfo", "complementary",
}
# fixed values: words that make an article element a reader's comment
_COMMENT_WORDS = {"comment", "comments", "reply", "replies", "response", "responses"}
_FURNITURE_OUTSIDE_ARTICLE = {"header", "topbar", "site-header"}
_ARTICLE = {"article", "main"}
# fixed values: elements that begin and end a block
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead",
           "tbody", "tfoot", "tr", "td", "th", "caption", "section", "article", "main", "header", "footer", "nav",
           "aside", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address", "hr", "body", "html",
           "details", "summary", "center", "menu", "dialog", "title", "head", "legend", "select", "option", "textarea"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
# an opening tag of the key closes an open element of the value
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote delimits a value only right after the equals sign
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^=>]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>|\Z))",
    re.DOTALL)
_OPAQUE_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for t in _OPAQUE}
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/>]|\Z)""",
                   re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
# what a class like has-sidebar or no-comments names is elsewhere or missing
_ABOUT = re.compile(r"(?<![a-z0-9])(?:has|no|with)[-_]\S*+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

MAX_LINK_DENSITY = 0.33
SHORT, LONG = 70, 200            # characters
STOPS_LOW, STOPS_HIGH = 0.20, 0.30
STOPS_NONE = 0.05                # of a page's words: below, it is in no language of the list


def _is_furniture(tag: str, attrs: str, in_article: bool) -> str:
    """"yes" (by element, or hidden), "named" (by a word of class, id or role) or ""."""
    if tag in _FURNITURE or (tag == "header" and not in_article):
        return "yes"
    if tag in ("main", "body", "html") or len(attrs) < 4:
        return ""
    named = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if tag == "article":             # furniture only as a reader's comment
            if name in ("class", "id") and set(_WORDS.findall(_ABOUT.sub("", _CAMEL.sub("-", value).lower()))) & _COMMENT_WORDS:
                return "yes"
            continue
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "yes"
        if name == "style":
            if _HIDDEN.search(value.lower()):
                return "yes"
            continue
        if name in ("class", "id", "role"):
            words = set(_WORDS.findall(_ABOUT.sub("", _CAMEL.sub("-", value).lower())))
            if words & _FURNITURE_WORDS or (not in_article and words & _FURNITURE_OUTSIDE_ARTICLE):
                named = "named"
    return named


class _Block:
    __slots__ = ("pieces", "linked", "furniture", "article", "named", "breaks")

    def __init__(self, furniture: bool, article: int, named: int):
        self.pieces: list[str] = []
        self.linked = 0
        self.furniture, self.article, self.named, self.breaks = furniture, article, named, 0


def blocks(page: str) -> list[tuple[str, float, bool, int]]:
    """(text, link density, furniture, number of the outermost article element or
    0) of every block with text.

    An element with a furniture word in its class, id or role is furniture unless
    it holds an article element with no less good text than the page's article
    elements outside of such elements have or, on a page without article
    elements, most of the page's good text, in several blocks or all of it.
    """
    out: list[tuple[str, float, bool, int]] = []
    within: list[int] = []                   # of each block, the innermost named element
    outer, holds = [-1], [False]             # of each named element, the one around it; whether it has an article
    stack: list[tuple[str, bool, int]] = []  # open elements; whether each begins furniture; the named one around
    state = {"furniture": 0, "article": 0, "a": 0, "named": 0}
    opened: Counter[str] = Counter()         # open elements by name
    in_blocks: list[int] = []                # places of the open block elements in the stack
    unclosed: set[str] = set()               # opaque elements that no later tag closes
    articles = 0
    cur = _Block(False, 0, 0)

    def close_block() -> None:
        nonlocal cur
        text = " ".join("".join(cur.pieces).split())
        if text:
            out.append((text, min(1.0, cur.linked / len(text)), cur.furniture, cur.article))
            within.append(cur.named)
        cur = _Block(state["furniture"] > 0, articles if state["article"] else 0, state["named"])

    def pop(n: int) -> None:
        if len(stack) > n:
            state["named"] = stack[n][2]
        while in_blocks and in_blocks[-1] >= n:
            in_blocks.pop()
        for tag, skip, _ in stack[n:]:
            opened[tag] -= 1
            state["furniture"] -= skip
            state["article"] -= tag in _ARTICLE
            state["a"] -= tag == "a"
        del stack[n:]

    def text_at(s: int, e: int) -> None:
        if e > s:
            piece = html.unescape(page[s:e])
            cur.pieces.append(piece)
            if not piece.isspace():
                cur.breaks = 0
            if state["a"]:
                cur.linked += len(" ".join(piece.split()))

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if not m:
            text_at(pos, n)
            break
        text_at(pos, m.start())
        pos = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if opened[tag] else None
            changes = tag in _BLOCKS or (at is not None and (any(s for _, s, _ in stack[at:]) or stack[at][2] != state["named"]))
            if at is not None:
                pop(at)
            if changes:
                close_block()
            continue
        if tag in _OPAQUE:
            if not m["attrs"].rstrip(">").endswith("/") and tag not in unclosed:
                end = _OPAQUE_END[tag].search(page, pos)
                if end:
                    pos = end.end()
                elif tag in _RAW:
                    pos = n
                else:                    # read what follows as if the tag were not there
                    unclosed.add(tag)
            continue
        if tag == "br":
            cur.breaks += 1
            if cur.breaks > 1:
                close_block()
            else:
                cur.pieces.append(" ")
            continue
        if tag in _BLOCKS and stack:     # a block ends an open paragraph
            at = in_blocks[-1] if in_blocks else None
            if at is not None and (stack[at][0] == "p" or stack[at][0] in _CLOSES.get(tag, ())):
                pop(at)
        if tag in _VOID:
            if tag in _BLOCKS:
                close_block()
            continue
        kind = _is_furniture(tag, m["attrs"] or "", state["article"] > 0)
        skip = kind == "yes"
        if tag in _BLOCKS:
            in_blocks.append(len(stack))
        stack.append((tag, skip, state["named"]))
        opened[tag] += 1
        if kind == "named":
            outer.append(state["named"])
            holds.append(False)
            state["named"] = len(outer) - 1
        elif tag in _ARTICLE and not state["furniture"]:
            at = state["named"]
            while at > 0 and not holds[at]:
                holds[at] = True
                at = outer[at]
        state["furniture"] += skip
        articles += tag in _ARTICLE and not state["article"]
        state["article"] += tag in _ARTICLE
        state["a"] += tag == "a"
        if kind or tag in _BLOCKS:
            close_block()
    close_block()
    if len(outer) == 1:
        return out
    size, many = [0] * len(outer), [0] * len(outer)
    plain = not any(article and not furniture for _, _, furniture, article in out)
    weigh = plain or any(holds)
    clean = 0
    for (text, links, furniture, article), at in zip(out, within):
        if weigh and not furniture and _first_pass(text, links, False) == "good":
            size[at] += len(text)
            many[at] += 1
            clean += len(text) if article and not at else 0
    for at in range(len(outer) - 1, 0, -1):
        size[outer[at]] += size[at]
        many[outer[at]] += many[at]
    bad = [False]
    for at in range(1, len(outer)):
        main = size[at] >= clean if holds[at] else (
            plain and 2 * size[at] > size[0] and (many[at] > 1 or size[at] == size[0]))
        bad.append(bad[outer[at]] or not main)
    return [(text, links, furniture or bad[at], article) for (text, links, furniture, article), at in zip(out, within)]


def _stops(text: str) -> tuple[int, int]:
    """(stop words, words) of a text that has some."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'*#$%&|") in STOP_WORDS for w in words), len(words)


def _first_pass(text: str, links: float, article: bool) -> str:
    """good, bad, or a block still to be decided: near (rather good), low (too few
    stop words) or short."""
    if links > (0.8 if article else MAX_LINK_DENSITY):
        return "bad"
    if len(text) < SHORT:
        return "bad" if links and not article else "short"
    found, words = _stops(text)
    stops = found / words
    if stops >= STOPS_HIGH:
        return "good" if len(text) > LONG and links <= MAX_LINK_DENSITY else "near"
    return "near" if stops >= STOPS_LOW and links <= MAX_LINK_DENSITY else "low"


def _second_pass(labels: list[str], border: str = "bad") -> list[bool]:
    """Short blocks take the label of the nearest decided neighbours: if both
    sides agree that one, else that of the nearer, a tie being as beyond the
    border unless a near block stands between; near blocks are good unless both
    sides are bad."""
    n = len(labels)
    before, after = [(-1, border)] * n, [(n, border)] * n
    last = (-1, border)
    for i, x in enumerate(labels):
        before[i] = last
        if x in ("good", "bad"):
            last = (i, x)
    nxt = (n, border)
    for i in range(n - 1, -1, -1):
        after[i] = nxt
        if labels[i] in ("good", "bad"):
            nxt = (i, labels[i])
    out = []
    for i, x in enumerate(labels):
        (a, left), (b, right) = before[i], after[i]
        if x in ("good", "bad"):
            out.append(x == "good")
        elif left == right:
            out.append(left == "good" or (x == "near" and "good" not in labels))
        elif x == "near":
            out.append(True)
        else:
            out.append((left if i - a < b - i else right if b - i < i - a else border) == "good")
    return out


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by one line feed; null or no text: ''.

    The blocks of each article or main element are decided first, among
    themselves: few stop words alone make none of them bad (titles, code, terse
    prose, other languages), but those that are also full of links are, and the
    others depend on their neighbours. The blocks outside then see these as
    neighbours. On a page whose plain blocks hold next to no stop words, which is
    in no language of the list, few of them say nothing: length and links decide.
    """
    if not page:
        return ""
    found = blocks(page)
    labels = ["bad" if furniture else _first_pass(text, links, article > 0) for text, links, furniture, article in found]
    if "low" in labels and not any(x in ("good", "near") for x in labels):
        prose = [_stops(text) for (text, links, _, _), x in zip(found, labels) if x == "low" and links <= MAX_LINK_DENSITY]
        if sum(s for s, _ in prose) < STOPS_NONE * sum(n for _, n in prose):
            labels = ["good" if x == "low" and links <= MAX_LINK_DENSITY and len(text) > LONG else
                      "near" if x == "low" and links <= MAX_LINK_DENSITY else x
                      for (text, links, _, _), x in zip(found, labels)]
    inside: dict[int, list[int]] = {}
    for i, (_, _, furniture, article) in enumerate(found):
        if article and not furniture:
            inside.setdefault(article, []).append(i)
    for rows in inside.values():
        own = [labels[i] if labels[i] != "low" else "bad" if found[i][1] > MAX_LINK_DENSITY else "short" for i in rows]
        for i, good in zip(rows, _second_pass(own, "good")):
            labels[i] = "good" if good else "bad"
    labels = ["bad" if x == "low" else x for x in labels]
    return "\n".join(b[0] for b, good in zip(found, _second_pass(labels)) if good)


def extract(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points of text).

    Null or empty html gives an empty text. Character references are decoded,
    white space inside a block becomes one space; blocks come in page order.
    Repeated rows come out as often as they go in; other columns are not read;
    no rows give no rows.
    """
    bounded_batches(pages.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["_id", "_uri", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return (pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{uri_col}`").alias("_uri"),
                         F.col(f"`{html_col}`").alias("_html"))
            .mapInArrow(of, f"_id {kinds[id_col]}, _uri {kinds[uri_col]}, text string, n_chars long")
            .withColumnsRenamed({"_id": id_col, "_uri": uri_col}))
