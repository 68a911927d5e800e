"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element starts a new line. A line weighs as many characters as it has outside links. Three
kinds of evidence change that, alike on every page: lines of an element that is boilerplate by its name, role or a whole word of its
class or id go, leaving one empty line; inside <article> (<main> on a page without one) linked text weighs too; outside it a line weighs an
OUTSIDE-th. The weights of WINDOW lines from each line on add up to its block length; an article's start and end are gaps of WINDOW
empty lines. A stretch runs from where the block length rises above nothing to the dive where it falls to nothing again. It surges if its block
length gets to a SHARE-th of the page's largest, and the main text is all lines of the stretches that surge.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SHARE = 8
OUTSIDE = 8

# Element names of HTML by what they mean for a line.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea svg annotation iframe title select"
BOILERPLATE = frozenset("nav header footer aside form menu button dialog fieldset search head".split())
CLOSED_BY = {
    "p": BLOCKS - {"br", "button", "audio", "video", "canvas"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
# Words of a class or id that mean boilerplate, as whole words.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle ad-banner banner-ad banner sponsored promo promotion nav navbar navigation menu main-menu site-nav "
    "breadcrumb breadcrumbs sidebar side-bar site-sidebar footer site-footer page-footer header site-header page-header masthead topbar comment comments comment-list "
    "commentlist comments-area comment-form disqus disqus_thread respond replies cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice newsletter subscribe "
    "signup sign-up popup modal overlay share sharing share-buttons social social-links social-share related-posts related-articles recommended recommendations widget "
    "widgets toolbar skip-link skip pagination pager login login-form search-form searchbox".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HOLDS_TEXT = frozenset("article main h1".split())  # an element around one of these isn't boilerplate by its class

# One token: a comment, a declaration, an element whose content isn't text (with its content, to the end if it isn't closed), or a
# tag. Atomic groups keep the time linear on broken attributes.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!(?>[^>]*)>?|<\?(?>[^>]*)>?|<({'|'.join(RAW.split())})\b(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")


def _unwanted(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate whatever it holds, and whether it is unless it holds the article."""
    if name in BOILERPLATE:
        return True, False
    if not TELLING.search(attributes) or name in ("html", "body", "article", "main"):
        return False, False
    named = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES or key == "style" and NOT_SHOWN.search(value):
            return True, False
        named |= key in ("class", "id") and not NAMES.isdisjoint(value.split())
    return False, named


class _Page:
    """The lines of one page as they are read, and the elements that are open."""

    def __init__(self, page: str):
        self.mark = "article" if re.search(r"<article[\s>]", page, re.I) else "main"
        self.text: list[str] = []
        self.weight: list[int] = []
        self.gap: list[bool] = []  # an article starts or ends before this line
        self.piece: list[str] = []
        self.linked = self.links = self.inside = self.bad = 0
        self.marked = self.edge = False
        self.open: list[tuple[str, bool, bool, int]] = []  # name, boilerplate, unless it holds the article, first line
        self.where: dict[str, list[int]] = {}  # places of open elements by name
        self.blocks: list[int] = []  # places of open block elements
        self.held: list[int] = []  # lines at which an article or its heading starts

    def end_line(self) -> None:
        if self.piece:
            text = SPACE.sub(" ", entities.unescape("".join(self.piece))).strip()
            self.piece.clear()
            if text and not self.bad:
                self.text.append(text)
                own = len(text) if self.inside else max(0, len(text) - self.linked)
                self.weight.append(own if self.inside else -own)  # outside: negative until it is known whether an article is marked
                self.gap.append(self.edge)
                self.edge = False
        self.linked = 0

    def start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block:
            self.end_line()
        while self.blocks and name in CLOSED_BY.get(self.open[self.blocks[-1]][0], ()):
            self.close(self.blocks[-1])
        if name in VOID:
            return
        always, named = _unwanted(name, attributes)
        if name == "header" and self.inside:
            always = False  # an article's own header holds its title
        if always or named:
            self.end_line()
        if name in HOLDS_TEXT and not self.bad:
            self.held.append(len(self.text))
        if name == self.mark:
            self.edge |= not self.inside
            self.inside += 1
            self.marked |= not self.bad
        self.bad += always
        self.links += name == "a" and "href" in attributes.lower()
        self.where.setdefault(name, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.open.append((name, always, named, len(self.text)))

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.end_line()
        at = self.where.get(name)
        if at and (name in BLOCKS or not self.blocks or at[-1] > self.blocks[-1]):
            self.close(at[-1])

    def close(self, place: int) -> None:
        """Close the element at a place and all that are open inside it."""
        while len(self.open) > place:
            name, always, named, first = self.open[-1]
            if always or named or name == self.mark:
                self.end_line()
            self.open.pop()
            self.where[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            if name == "a" and self.links:
                self.links -= 1
            self.bad -= always
            if always and not self.bad or named and not self.bad and not (self.held and self.held[-1] >= first):
                del self.text[first:], self.weight[first:], self.gap[first:]
                self.text.append("")
                self.weight.append(0)
                self.gap.append(self.edge)
                self.edge = False
            if name == self.mark:
                self.inside -= 1
                self.edge |= not self.inside


def lines(page: str) -> tuple[list[str], list[int]]:
    """A page's lines and their weights."""
    p, at = _Page(page), 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            p.piece.append(page[at : m.start()])
            if p.links:
                p.linked += m.start() - at
        at = m.end()
        name = m[3] or m[6]
        if name is not None:
            if m[2] or m[5]:
                p.end(name.lower())
            else:
                p.start(name.lower(), m[4] or m[7] or "")
        elif m[1] and m[1].lower() in BLOCKS:
            p.end_line()
    if at < len(page):
        p.piece.append(page[at:])
    p.end_line()
    p.close(0)
    text: list[str] = []
    weight: list[int] = []
    for t, w, gap in zip(p.text, p.weight, p.gap, strict=True):
        if gap:
            text += [""] * WINDOW
            weight += [0] * WINDOW
        text.append(t)
        weight.append(w if w >= 0 else -w // OUTSIDE if p.marked else -w)
    return text, weight


def block_lengths(weight: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the weights of `window` lines from each line on."""
    ahead = [0] * (len(weight) + 1)
    for i in range(len(weight) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + weight[i]
    return [ahead[i] - ahead[min(len(weight), i + window)] for i in range(len(weight))]


def main_text(page: str | None, window: int = WINDOW, share: int = SHARE) -> str:
    """All lines of the stretches that surge, joined by one space."""
    text, weight = lines(page or "")
    block = block_lengths(weight, window)
    peak = max(block, default=0)
    kept: list[str] = []
    i = 0
    while i < len(block):
        first = i
        while i < len(block) and block[i]:  # from the rise to the dive
            i += 1
        if i > first and max(block[first:i]) * share >= peak:
            while not weight[first]:  # links just ahead of the text
                first += 1
            kept += [t for t in text[first:i] if t]
        else:
            i = max(i, first + 1)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages = (batch.column(i) for i in range(3))
        text = [main_text(p.as_py()) for p in pages]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole markup; no exchange, one pass.

    A null, empty or textless page has an empty text. Ids and urls are passed on as they are, null or repeated; other columns
    aren't read.
    """
    kinds = dict(pages.dtypes)
    cols = pages.selectExpr(f"`{id_col}` as page_id", f"`{url_col}` as url", f"`{html_col}` as html")
    return cols.mapInArrow(_extract, f"page_id {kinds[id_col]}, url string, text string, n_chars long")


def extract_sql() -> str:
    """The same rows in DuckDB SQL for pages whose article is marked, as those of the table `pages` are."""
    body = "regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
    decoded = f"replace(replace(replace(replace({body}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
    return f"select page_id, url, text, length(text)::bigint as n_chars from (select page_id, url, trim(regexp_replace({decoded}, '\\s+', ' ', 'g')) as text from pages) x"
