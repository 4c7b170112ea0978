"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped in one pass: comments, scripts, styles and tags go, and each block element begins a new
   line.  White space inside a line is one space.  The edges of containers leave an empty line.
2. A line has a weight: its characters outside links.  Lines inside menus,
   headers, footers, sidebars, notices, adverts, forms and comments (told by
   element, ``role``, or a whole part of a class name or id) have none and are
   never kept.  An ``article`` or ``main`` element bounds the text:
   lines outside it have no weight, and those inside get ``INSIDE`` more, so
   that the distribution can neither surge outside nor dive inside.
3. Weights are summed over windows of ``WINDOW`` lines.  The text surges
   where the sum first exceeds the threshold, a ``SHARE`` of its peak but at most ``SURGE``,
   and dives where it last does.  Lines from the first
   with weight in the surging window to the last in the diving one are kept,
   whatever their own length: a page loses no short paragraph inside its text.

Pages do not meet, so there is no shuffle, and the time is linear in the page.
An advert or notice that is never closed ends where an article begins or ends; a page
that is one big form is read again without taking the form as such.

Defined results: null, empty and text-less pages have an empty text.  Unclosed
comments, scripts and tags run to the end of the page.  A break (``br``) is white space.  Repeated pages are treated alike; extra
columns stay in ``row`` whatever their names.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from starlane.llm.text import annotate_rows

WINDOW = 3
SURGE = 80  # characters in a window, at most, that tell text from stray lines
SHARE = 0.2  # of the highest window
INSIDE = 1000  # more weight for each line inside an article

# Elements, and parts of class names and ids.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
CHROME = set(
    "head nav menu footer aside form button select option label input fieldset dialog template svg canvas audio video object script "
    "style textarea title noscript iframe xmp noembed noframes".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
TEXT = set("article main".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status".split())
CHROME_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe signup login share sharing social pagination pager "
    "toolbar copyright skip disclaimer werbung anzeige publicite publicidad".split()
)
#: Text of others, which an article element inside does not make the page's own.
FOREIGN_NAMES = set(
    "comment comments commentlist disqus respond replies reviews related recommended recommendations teaser teasers kommentar kommentare "
    "commentaire commentaires comentario comentarios".split()
)
#: A name with one of these says something about the page, not about its element.
ABOUT = set("has with no is without layout".split())
OWN_HEADS = set("article entry post story".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose edges part the lines by an empty one.
CONTAINERS = set("article aside center div dl fieldset footer form header main menu nav ol section table ul".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    barred: bool
    inside: bool  # inside an article or main element


def _named(name: str, attributes: str) -> str:
    """"foreign" or "chrome" if the attributes name such an element, else nothing."""
    found = ""
    if "=" not in attributes:
        return found
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role" and value.strip().lower() in CHROME_ROLES:
            found = found or "chrome"
        if key not in ("class", "id"):
            continue
        for one in value.split():
            parts = {p.lower() for p in _NAME_PART.findall(one)}
            if not ABOUT.isdisjoint(parts):
                continue
            if not FOREIGN_NAMES.isdisjoint(parts):
                return "foreign"
            own = name in HEADINGS or ("header" in parts and not OWN_HEADS.isdisjoint(parts))
            if not own and not CHROME_NAMES.isdisjoint(parts):
                found = "chrome"
    return found


def _kind(name: str, attributes: str, inside: int) -> str:
    """Why the text of an element is not the page's: "foreign", "chrome" or nothing."""
    if name in ("html", "body", "main") or name in VOID:
        return ""
    if name == "article":  # a comment or a teaser may be one
        return "foreign" if _named(name, attributes) == "foreign" else ""
    if name == "header":
        return "" if inside else "chrome"  # an article's own head is its title
    if name in CHROME:
        return "chrome"
    return _named(name, attributes)


class _Reader:
    """Lines of one page."""

    def __init__(self, forms: bool) -> None:
        self.forms = forms
        self.lines: list[Line] = []
        self.words: list[str] = []
        self.linked = 0  # characters of the line inside links
        self.in_link = False
        self.articles: list[str] = []
        self._free()

    def _free(self) -> None:
        """Nothing is barred from here on."""
        self.bar, self.barring = "", ""  # why text is barred, and by which element
        self.depth = 0  # open elements of that name, or within an inline one, open blocks
        self.lists, self.texts = 0, 0  # open lists and articles within

    def end_line(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.lines.append(Line(text, min(self.linked, len(text)), bool(self.bar), bool(self.articles)))
            self.words, self.linked = [], 0

    def _edge(self, name: str) -> None:
        """A block begins or ends here."""
        self.end_line()
        if name in CONTAINERS and self.lines:
            self.lines.append(Line("", 0, bool(self.bar), bool(self.articles)))

    def text(self, raw: str) -> None:
        if raw and (not self.bar or self.barring in BLOCKS):
            text = html.unescape(raw) if "&" in raw else raw
            self.words.append(text)
            if self.in_link:
                self.linked += len(" ".join(text.split()))

    def start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        kind = "" if name == "form" and not self.forms else _kind(name, attributes, len(self.articles))
        if block:
            self._edge(name)
        elif name in ("br", "td", "th"):
            self.words.append(" ")
        if self.bar:
            self._start_barred(name, kind, block)
        if not self.bar:
            if kind:
                self.bar, self.barring, self.depth = kind, name, int(block)
            elif name in TEXT:
                self.articles.append(name)
        if name == "a" and "href" in attributes.lower():
            self.in_link = True

    def _start_barred(self, name: str, kind: str, block: bool) -> None:
        if name == "body" or (name in TEXT and not kind and self.bar == "chrome"):
            self._free()
        elif self.barring == "p" and block:
            self._free()
        elif self.barring == "li" == name and not self.lists:
            self._free()
        elif name == self.barring or (block and self.barring not in BLOCKS):
            self.depth += 1
        self.lists += name in ("ul", "ol", "menu")
        self.texts += bool(self.bar) and name in TEXT

    def end(self, name: str) -> None:
        block = name in BLOCKS
        if block:
            self._edge(name)
            self.in_link = False
        elif name in ("br", "td", "th"):
            self.words.append(" ")
        elif name == "a":
            self.in_link = False
        if self.bar:
            self._end_barred(name, block)
        if not self.bar and name in self.articles:
            while self.articles.pop() != name:
                pass

    def _end_barred(self, name: str, block: bool) -> None:
        self.lists -= name in ("ul", "ol", "menu") and self.lists > 0
        if self.barring in BLOCKS:
            self.depth -= name == self.barring
            over = not self.depth
        else:  # an inline element ends with the block that it is in
            over = name == self.barring or (block and not self.depth)
            self.depth -= block and self.depth > 0
        if name in TEXT:
            over = over or not self.texts
            self.texts -= self.texts > 0
        if over:
            self._free()


def lines_of(page: str, forms: bool = True) -> list[Line]:
    """The lines of a page, in order, with what is known of each."""
    reader, at = _Reader(forms), 0
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            break
        reader.text(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            reader.end(name)
            continue
        reader.start(name, attributes)
        if name in RAW:  # its content is no markup
            over = _RAW_END[name].search(page, at)
            at = over.start() if over else len(page)
    reader.text(page[at:])
    reader.end_line()
    return reader.lines


def _bounded(lines: list[Line]) -> bool:
    """Whether an article or main element holds text of the page's own."""
    return any(line.inside and line.text and not line.barred for line in lines)


def weights(lines: list[Line]) -> list[int]:
    bounded = _bounded(lines)

    def weight(line: Line) -> int:
        if line.barred or not line.text or (bounded and not line.inside):
            return 0
        return len(line.text) - line.linked + (INSIDE if bounded else 0)

    return [weight(line) for line in lines]


def stretch(weight: list[int], window: int = WINDOW) -> tuple[int, int]:
    """First and last line (exclusive) between the surge and the dive of the
    sums over ``window`` lines."""
    sums, total = [], 0
    for k, w in enumerate(weight):
        total += w - (weight[k - window] if k >= window else 0)
        sums.append(total)  # over the lines that end at k
    peak = max(sums, default=0)
    if not peak:
        return 0, 0
    least = min(SURGE, SHARE * peak)
    high = [k for k, s in enumerate(sums) if s > least]
    first = next(k for k in range(max(0, high[0] - window + 1), high[0] + 1) if weight[k])
    last = next(k for k in range(high[-1], -1, -1) if weight[k])
    return first, last + 1


def _kept(lines: list[Line]) -> list[str]:
    weight = weights(lines)
    first, last = stretch(weight)
    bounded = _bounded(lines)
    return [line.text for line in lines[first:last] if line.text and not line.barred and (line.inside or not bounded)]


def extract(page: str) -> str:
    """The main text of a page: its blocks, two line ends between them."""
    kept = _kept(lines_of(page)) or _kept(lines_of(page, forms=False))
    return "\n\n".join(kept)


def main_text(pages: DataFrame, keep: list[str] | None = None, column: str = "html") -> DataFrame:
    """The kept columns as ``row``, and the ``text`` of every page."""

    def make():
        return lambda values: [pa.array([extract(v.as_py() or "") for v in values], pa.string())]

    return annotate_rows(pages, make, "text string", keep, column, rows=200)
